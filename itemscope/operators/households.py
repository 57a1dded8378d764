"""Household records: completeness, sampling, batch decisions and run accuracy."""

import time

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from itemscope.operators.ranks import hash_positions
from itemscope.schema import LONG, SHORT

# Fields a usable household must have.
REQUIRED = ["BuildingDamage", "DisplacementDuration", "WaterAccess", "PowerAccess", "FoodAccess",
            "UnsanitaryConditions", "DisasterType"]


def displaced(survey):
    return survey.filter(F.col("ND_DISPLACE") == 1)


def complete_households(households):
    """Households with all fields known and exactly one disaster type, which is unwrapped."""
    soc = households.schema["SocioEconomicParameters"].dataType.names
    known = F.size("DisasterType") == 1
    for field in REQUIRED:
        known = known & F.col(field).isNotNull()
    for field in soc:
        known = known & F.col(f"SocioEconomicParameters.`{field}`").isNotNull()
    return households.filter(known).withColumn("DisasterType", F.col("DisasterType")[0])


def duration_to_decision(c):
    """The label that an answered displacement duration stands for."""
    return F.when(F.contains(F.col(c), F.lit("Less than a week")), SHORT).when(
        F.col(c).isNotNull(), LONG)


def mock_decision(kind, duration):
    """Decision without a model: `actual` copies the truth, else the label given."""
    return duration_to_decision(duration) if kind == "actual" else F.lit(kind)


def select_households(households, key, sample_size="all", seed=42, start=0, limit=None):
    """A reproducible sample of exactly `sample_size` rows (or all), then rows start..start+limit.

    Rows are drawn, and numbered in `position`, in the order of a seeded hash of `key`, so the
    choice does not depend on how the table is partitioned.
    """
    if start < 0:
        raise ValueError(f"start must be non-negative, got {start}")
    if limit is not None and limit < 0:
        raise ValueError(f"limit must be non-negative, got {limit}")
    last = None
    if sample_size != "all":
        last = int(sample_size)
        available = households.count()
        if last < 0 or last > available:
            raise ValueError(f"sample_size={last} is not within the {available} households")
    if limit is not None:
        last = start + limit if last is None else min(last, start + limit)
    hashed = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    out = hash_positions(households, [], hashed, first=last)
    return out.filter(F.col("position") >= start) if start else out


_DECISION = [T.StructField("decision", T.StringType()), T.StructField("error_type", T.StringType()),
             T.StructField("error_message", T.StringType()),
             T.StructField("elapsed_s", T.DoubleType())]


def decide_households(households, decide, stop_on_error=False):
    """Apply the caller's `decide(record: dict) -> label` to every row.

    A failing row keeps its fields and gets the error's type and message instead of a decision.
    """
    schema = T.StructType(list(households.schema) + _DECISION)

    def run(batches):
        for batch in batches:
            found = []
            for record in batch.to_pylist():
                begun = time.perf_counter()
                try:
                    answer = (decide(record), None, None)
                except Exception as error:
                    if stop_on_error:
                        raise
                    answer = (None, type(error).__name__, str(error))
                found.append((*answer, time.perf_counter() - begun))
            kinds = [pa.string()] * 3 + [pa.float64()]
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in schema])

    return households.mapInArrow(run, schema)


def split_errors(decided):
    """(decisions, errors) of a decided table."""
    failed = F.col("error_type").isNotNull()
    return (decided.filter(~failed).drop("error_type", "error_message"),
            decided.filter(failed).drop("decision"))


def run_accuracy(decided, truth="truth"):
    """One row with the accuracy of the decisions and the run's totals."""
    ok = F.col("error_type").isNull()
    return decided.agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if(ok).alias("n_decided"),
        F.count_if(~ok).alias("n_errors"),
        F.count_if(ok & (F.col("decision") == F.col(truth))).alias("n_correct"),
        F.avg(F.when(ok, (F.col("decision") == F.col(truth)).cast("int"))).alias("accuracy"),
        F.sum("elapsed_s").alias("total_runtime_s"),
        F.avg("elapsed_s").alias("average_runtime_s"))
