"""Response and decision tables: reshaping, alignment checks, subject rosters."""

from pyspark.sql import functions as F

from itemscope.functions.scalar import label_to_decision
from itemscope.schema import LONG, SHORT


def wide_to_long(matrix, value="y"):
    """Subject x item frame to rows (subject, item_id, value); missing cells give no row.

    A number other than 0 and 1 is an error. Older exports keep the subject in the first column under another name.
    """
    subject = "model" if "model" in matrix.columns else matrix.columns[0]
    items = [c for c in matrix.columns if c != subject]
    numeric = matrix.select(F.col(f"`{subject}`").cast("string").alias("subject"), *[
        F.col(f"`{c}`").try_cast("double").alias(c) for c in items])
    long = numeric.unpivot("subject", [f"`{c}`" for c in items], "item_id", value)
    refused = F.raise_error(F.concat(F.lit("the answer of "), F.col("subject"), F.lit(" to "), F.col("item_id"),
                                     F.lit(" is neither 0 nor 1: "), F.col(value).cast("string")))
    return long.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(
        value, F.when(F.col(value).isin(0.0, 1.0), F.col(value).cast("int")).otherwise(refused.cast("int")))


def prediction_columns(metadata):
    return [c for c in metadata.columns if c.endswith("_prediction")]


def decisions_from_metadata(metadata, subjects=None):
    """Rows (subject, item_id, decision) from the `<subject>_prediction` columns.

    Labels other than the two known ones are missing. `subjects`, a DataFrame with a `subject`
    column, keeps only those subjects.
    """
    _require(metadata, "item_id")
    columns = prediction_columns(metadata)
    if not columns:
        raise ValueError("no *_prediction columns in the item metadata")
    out = (
        metadata.unpivot(F.col("item_id").cast("string"), [f"`{c}`" for c in columns],
                         "subject", "label")
        .select(F.regexp_replace("subject", "_prediction$", "").alias("subject"), "item_id",
                label_to_decision("label", LONG, SHORT).alias("decision"))
        .filter(F.col("decision").isNotNull()))
    if subjects is not None:
        out = out.join(subjects.select("subject").distinct(), "subject", "left_semi")
    return out


def first_per_item(metadata, ordinal=None):
    """One row per item_id: the one with the smallest `ordinal`, else the smallest whole row."""
    row = F.struct(*[F.col(f"`{c}`") for c in metadata.columns])
    order = F.col(ordinal) if ordinal else row
    return metadata.groupBy("item_id").agg(F.min_by(row, order).alias("__row")).select("__row.*")


def missing_item_ids(responses, metadata):
    return responses.select("item_id").distinct().join(
        metadata.select("item_id"), "item_id", "left_anti")


def require_metadata(cells, metadata):
    """Raises if an item of `cells` has no row in `metadata`: a join would lose its cells."""
    missing = missing_item_ids(cells, metadata)
    examples = [r[0] for r in missing.orderBy("item_id").limit(5).collect()]
    if examples:
        raise ValueError(f"metadata lacks {missing.count()} item ids, e.g. {examples}")


def align_metadata(metadata, responses, ordinal=None):
    """Metadata restricted to the items that were answered; an answered item without metadata is
    an error."""
    _require(metadata, "item_id")
    md = first_per_item(metadata, ordinal)
    require_metadata(responses, md)
    return md.join(responses.select("item_id").distinct(), "item_id", "left_semi")


def unique_cells(responses):
    """One row per (subject, item_id); of repeated cells the smallest answer stays."""
    rest = [c for c in responses.columns if c not in ("subject", "item_id")]
    return responses.groupBy("item_id", "subject").agg(
        F.min(F.struct(*rest)).alias("__cell")).select("subject", "item_id", "__cell.*")


def observer_counts(responses):
    return responses.groupBy("item_id").agg(F.count("y").alias("n_observed"))


def eligible_items(responses, min_observed):
    return observer_counts(responses).filter(F.col("n_observed") >= min_observed)


def _require(df, column):
    if column not in df.columns:
        raise ValueError(f"a column {column} is needed")
