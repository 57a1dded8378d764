"""Construct validity: rank correlations of difficulty, and a cross-fitted label model."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from itemscope.functions.pvalues import correlation_p_udf
from itemscope.functions.scalar import ambiguity, clip, surprisal
from itemscope.operators.design import encode_features
from itemscope.operators.performance import binary_metrics
from itemscope.operators.ranks import average_ranks, hash_positions
from itemscope.session import local_table, written

# Labels and columns of the construct-validity variables.
VALIDITY_VARIABLES = [
    ("empirical difficulty", "empirical_difficulty"),
    ("feature label surprisal", "feature_label_surprisal"),
    ("simple cue-label conflict", "simple_cue_label_conflict"),
    ("feature ambiguity", "feature_ambiguity"),
    ("total severity score", "total_severity_score"),
    ("damage score", "damage_score"),
]


def difficulty_validity_correlations(item_table, difficulty="difficulty"):
    """Spearman correlation of difficulty with each variable present, over complete pairs."""
    present = [(label, c) for label, c in VALIDITY_VARIABLES if c in item_table.columns]
    spark = item_table.sparkSession
    names = local_table(
        spark, [(i, label, c) for i, (label, c) in enumerate(present)],
        {"pos": pa.int32(), "construct_validity_variable": pa.string(), "column": pa.string()})
    pairs = item_table.select(F.col(difficulty).alias("d"), *[
        F.col(c).cast("double").alias(c) for _, c in present]).unpivot(
        "d", [c for _, c in present], "column", "v").filter("d is not null and v is not null")
    # equal pairs collapse before ranks are looked up
    joint = written(pairs.groupBy("column", "d", "v").agg(F.count(F.lit(1)).alias("c")), "pairs")
    counts = lambda value: joint.groupBy("column", value).agg(F.sum("c").alias("cnt"))
    rank_d = average_ranks(counts("d"), ["column"], "d").select(
        "column", "d", F.col("rank").alias("rd"), "n")
    rank_v = average_ranks(counts("v"), ["column"], "v").select(
        "column", "v", F.col("rank").alias("rv"))
    x = F.col("rd") - (F.col("n") + 1) / 2
    y = F.col("rv") - (F.col("n") + 1) / 2
    c = F.col("c")
    # a value that many items share meets its rank as one row of sums
    by_value = joint.join(rank_d, ["column", "d"]).groupBy("column", "v").agg(
        F.sum("c").alias("c"), F.sum(c * x).alias("x"), F.sum(c * x * x).alias("xx"),
        F.max("n").alias("n"))
    sums = by_value.join(rank_v, ["column", "v"]).groupBy("column").agg(
        F.sum("c").alias("n"), F.sum(F.col("x") * y).alias("xy"), F.sum("xx").alias("xx"),
        F.sum(c * y * y).alias("yy"))
    rho = F.when(F.col("n") >= 3, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))))
    rho = clip(rho, -1.0, 1.0)
    out = names.join(sums, "column", "left").select(
        "pos", "construct_validity_variable", "column",
        rho.alias("spearman_corr_with_irt_difficulty"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("p_value", correlation_p_udf(
        "spearman_corr_with_irt_difficulty", "n")).orderBy("pos").select(
        "construct_validity_variable", "column", "spearman_corr_with_irt_difficulty", "p_value",
        "n")


def stratified_folds(flat, n_splits=5, seed=2026):
    """Add `fold`: items of each class are dealt to the folds in the order of a seeded hash."""
    key = F.concat(F.lit(f"{seed}:"), F.col("item_id"))
    return hash_positions(flat, ["true_long"], key).withColumn(
        "fold", (F.col("position") % n_splits).cast("int")).drop("position")


def _fold_scaling(coded, n_numbers, n_splits):
    """Mean and population sd of every number over each fold's train rows: {fold: (means, sds)}."""
    if not n_numbers:
        return {f: (np.zeros(0), np.ones(0)) for f in range(n_splits)}
    at = [F.col("num")[i] for i in range(n_numbers)]
    rows = coded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in at]).alias("s"),
        F.array(*[F.sum(c * c) for c in at]).alias("q")).collect()
    out = {}
    for fold in range(n_splits):
        train = [r for r in rows if r["fold"] != fold]
        n = sum(r["n"] for r in train)
        mean = np.sum([r["s"] for r in train], axis=0) / n
        var = np.sum([r["q"] for r in train], axis=0) / n - mean ** 2
        out[fold] = mean, np.sqrt(np.where(var > 1e-12 * np.maximum(1.0, mean ** 2), var, 1.0))
    return out


def _vectors(coded, encoding):
    """`coded` with the sparse vector `levels`: a one for each level that an item has."""
    columns = [f"cat{i}" for i in range(len(encoding.cats))]
    if not columns:
        return coded.withColumn("levels", array_to_vector(F.array().cast("array<double>")))
    numbered = coded.withColumns({c: F.col("cat")[i] - encoding.offsets[i] for i, c in enumerate(columns)})
    ones = [f"{c}_one" for c in columns]
    dealt = OneHotEncoder(inputCols=columns, outputCols=ones, dropLast=False).fit(numbered).transform(numbered)
    return VectorAssembler(inputCols=ones, outputCol="levels").transform(dealt).drop(*columns, *ones)


def _fold_features(coded, scaling):
    """`coded` with the vector `x`: levels, and numbers as this fold's train rows scale them."""
    means, sds = scaling
    numbers = F.array(*[(F.col("num")[j] - F.lit(float(m))) / F.lit(float(d))
                        for j, (m, d) in enumerate(zip(means, sds))])
    return VectorAssembler(inputCols=["levels", "numbers"], outputCol="x").transform(
        coded.withColumn("numbers", array_to_vector(numbers.cast("array<double>"))))


def _fold_scores(coded, fold, scaling, max_steps, tolerance):
    """Rows (item_id, p) of one fold, from a logistic model of the others with unit ridge penalty."""
    rows = _fold_features(coded, scaling)
    train = rows.where(F.col("fold") != fold)
    n, positive = train.agg(F.count("*"), F.sum("label")).first()
    test = rows.where(F.col("fold") == fold)
    if not n or positive in (0, n):    # one class: no odds to fit
        return test.select("item_id", F.lit(float(bool(positive))).alias("p"))
    model = LogisticRegression(
        featuresCol="x", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
        maxIter=max_steps, tol=tolerance).fit(train)
    if model.summary.totalIterations >= max_steps:
        raise ValueError(f"the label model of fold {fold} has not settled after {max_steps} steps")
    return model.transform(test).select("item_id", vector_to_array("probability")[1].alias("p"))


def feature_label_scores(flat, n_splits=5, seed=2026, encoded=None, max_steps=1000, tolerance=1e-12):
    """Out-of-fold probability of the long label from features alone, and what it says of items.

    Adds feature_p_long, feature_label_surprisal and feature_ambiguity to `flat`. Levels are
    numbered over all items: a level absent from a train fold has a zero coefficient there, as an
    unseen level would. `encoded`, the result of `encode_features(flat)`, spares encoding again.
    The models are fitted side by side on sparse vectors; only gradients, a number for each level,
    are added up. A fold whose model does not settle raises; one whose train rows are of one class
    predicts that class.
    """
    encoded, encoding = encoded or encode_features(flat)
    folds = stratified_folds(flat.select("item_id", "true_long"), n_splits, seed)
    coded = written(encoded.join(folds, "item_id").select(
        "item_id", "fold", F.col("true_long").cast("double").alias("label"), "cat", "num"),
        "label-rows")
    scaling = _fold_scaling(coded, len(encoding.nums), n_splits)
    coded = written(_vectors(coded, encoding), "label-vectors")
    with ThreadPoolExecutor(n_splits) as pool:
        parts = list(pool.map(inheritable_thread_target(coded.sparkSession)(
            lambda fold: _fold_scores(coded, fold, scaling[fold], max_steps, tolerance)), range(n_splits)))
    scores = written(reduce(DataFrame.unionByName, parts), "label-scores")
    scores = scores.select("item_id", clip("p", 1e-6, 1 - 1e-6).alias("feature_p_long"))
    return flat.join(scores, "item_id").withColumn(
        "feature_label_surprisal", surprisal("true_long", "feature_p_long")).withColumn(
        "feature_ambiguity", ambiguity("feature_p_long"))


def feature_label_metrics(scored):
    m = binary_metrics(scored, [], "true_long", "feature_p_long")
    return m.select(F.col("auc").alias("feature_label_auc"),
                    F.col("accuracy").alias("feature_label_accuracy_at_0p5"),
                    F.col("n").alias("n_items"))
