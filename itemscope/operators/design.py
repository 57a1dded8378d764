"""Encoded item features: levels of the categorical columns and filled numbers."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from itemscope.operators.metadata import feature_frame
from itemscope.schema import CATEGORICAL, NUMERIC
from itemscope.session import written


class Encoding:
    """Levels per categorical column, and the layout of the design columns.

    Every categorical column owns one column per level and a last one for missing values; the
    numeric columns follow.
    """

    def __init__(self, cats, nums, levels):
        self.cats, self.nums, self.levels = cats, nums, levels
        self.offsets, width = [], 0
        for labels in levels:
            self.offsets.append(width)
            width += len(labels) + 1
        self.first_number = width
        self.width = width + len(nums)


_MISSING = "?"


def level_text(c):
    # a leading mark keeps '' and '?' apart from missing and makes every level a non-empty name
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(_MISSING))


def fit_encoding(features):
    cats = [c for c in CATEGORICAL if c in features.columns]
    nums = [c for c in NUMERIC if c in features.columns]
    if not cats:
        return Encoding(cats, nums, [])
    marked = features.select(*[level_text(c).alias(c) for c in cats])
    # The levels' names stand in the models of the encoding, so the driver has them.
    found = marked.unpivot([], cats, "name", "level").filter(F.col("level") != _MISSING).distinct().collect()
    levels = [sorted(r["level"] for r in found if r["name"] == c) for c in cats]
    return Encoding(cats, nums, levels)


def index_levels(features, encoding):
    """Replace each categorical column by its level number; a missing value has the last one."""
    marked = features.select("item_id", *[level_text(c).alias(c) for c in encoding.cats],
                             *encoding.nums)
    for c, labels in zip(encoding.cats, encoding.levels):
        marked = StringIndexerModel.from_labels(
            [*labels, _MISSING], c, f"{c}__index", "error").transform(marked)
    return marked


def encode_features(flat):
    """(encoded, encoding): per item the design positions that are 1 (`cat`) and the numbers.

    The encoded table is written, so that the models built on it start from a short plan.
    """
    features = feature_frame(flat)
    encoding = fit_encoding(features)
    indexed = index_levels(features, encoding)
    cat = F.array(*[(F.col(f"{c}__index").cast("int") + o)
                    for c, o in zip(encoding.cats, encoding.offsets)]).cast("array<int>")
    num = F.array(*[F.coalesce(c, F.lit(0.0)) for c in encoding.nums])
    encoded = indexed.select("item_id", cat.alias("cat"), num.cast("array<double>").alias("num"))
    return written(encoded, "encoded-items"), encoding


def design_entries(items, encoding):
    """Rows (item_id, test_splits, row) with the entries (i, a) of the item's design row.

    Numbers are centred and scaled over all of `items`; the last column, `encoding.width`, is 1.
    """
    ones = F.transform("cat", lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("a")))
    one = F.array(F.struct(F.lit(encoding.width).alias("i"), F.lit(1.0).alias("a")))
    numbers = range(len(encoding.nums))
    moments = items.agg(*[m(F.col("num")[j]) for j in numbers for m in (F.avg, F.var_pop)]).first() \
        if encoding.nums else []
    scaled = []
    for j in numbers:    # no items: no moments, and no row that needs them
        mean, var = (v or 0.0 for v in moments[2 * j:2 * j + 2])
        sd = deviation(var, mean)
        scaled.append(F.struct(F.lit(encoding.first_number + j).alias("i"),
                               ((F.col("num")[j] - F.lit(mean)) / F.lit(sd)).alias("a")))
    rows = F.concat(ones, F.array(*scaled), one) if scaled else F.concat(ones, one)
    return items.select("item_id", "test_splits", rows.alias("row"))


def deviation(var, mean):
    """Standard deviation of a column, 1 for a column that is constant but for rounding."""
    return var ** 0.5 if var > 1e-12 * max(1.0, mean * mean) else 1.0


def partial_rows(sums):
    for split, matrix in sums.items():
        n = len(matrix)
        yield pa.RecordBatch.from_pydict({
            "split": pa.array(np.full(n, split), pa.int32()),
            "i": pa.array(np.arange(n), pa.int32()),
            "row": pa.array(list(matrix), pa.list_(pa.float64()))})


def sum_rows(partials, keys):
    """Element-wise sum of the arrays `row` per key, combined on the map side first."""
    return partials.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row"))
