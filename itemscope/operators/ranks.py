"""Running sums, ranks, quantiles and AUC without a one-task sort.

A window over a whole table would sort it in a single task. Here rows are first reduced to
distinct values with counts, range-partitioned on (group, value) and written once together with
their partition number. The window then runs inside (group, partition), and a table of partition
totals (one row per group and partition) supplies what lies before.
"""

from pyspark.sql import Window, functions as F

from itemscope.session import written


def running_sums(values, group, value, measures):
    """Add `<m>_before` (sum over smaller values of the group) and `<m>_total` for every measure.

    `values` must hold one row per (group, value).
    """
    ranged = (values.repartitionByRange(*group, value)
              .withColumn("__part", F.spark_partition_id()))
    ranged = written(ranged, "ranged")
    w_before = Window.partitionBy(*group).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "__part").agg(
        *[F.sum(m).alias(f"__{m}") for m in measures])
    totals = totals.select(
        *group, "__part",
        *[F.coalesce(F.sum(f"__{m}").over(w_before), F.lit(0)).alias(f"__{m}_offset")
          for m in measures],
        *[F.sum(f"__{m}").over(Window.partitionBy(*group)).alias(f"{m}_total")
          for m in measures])
    w_in = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    out = ranged.select(*values.columns, "__part", *[
        F.coalesce(F.sum(m).over(w_in), F.lit(0)).alias(f"__{m}_inside") for m in measures])
    out = _join_on(out, totals, [*group, "__part"])
    return out.select(
        *values.columns,
        *[(F.col(f"__{m}_offset") + F.col(f"__{m}_inside")).alias(f"{m}_before")
          for m in measures],
        *[f"{m}_total" for m in measures])


def _join_on(left, right, keys):
    """Inner join on null-safe keys; group columns may hold NULL."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond).drop(*[f"__r_{k}" for k in keys])


def value_counts(df, group, value):
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("cnt"))


def average_ranks(counts, group, value):
    """One row per (group, value) with `rank` (ties share the mean rank) and the group's size `n`.

    `counts` holds the number `cnt` of rows per (group, value).
    """
    sums = running_sums(counts, group, value, ["cnt"])
    return sums.select(*group, value, "cnt",
                       (F.col("cnt_before") + (F.col("cnt") + 1) / 2).alias("rank"),
                       F.col("cnt_total").alias("n"))


def with_min_ranks(df, ranks):
    """Add SQL RANK columns over the whole table, largest value first; NULL has a NULL rank.

    `ranks` maps a value column to the rank's name. The table is written once, since it is both
    counted and joined.
    """
    out = df = written(df, "to-rank")
    for value, name in ranks.items():
        sums = running_sums(value_counts(df, [], value), [], value, ["cnt"])
        rank = sums.select(
            F.col(value).alias("__value"),
            (F.col("cnt_total") - F.col("cnt_before") - F.col("cnt") + 1).cast("int").alias(name))
        out = out.join(rank, F.col(value) == F.col("__value"), "left").drop("__value")
    return out


def exact_quantiles(df, group, value, probabilities):
    """Quantiles with linear interpolation; one row per group with the array `edges`.

    The order statistics next to each quantile are picked from the running counts: a value leaves
    its task only where it is one of them, so no task ever holds all values of a group.
    """
    sums = running_sums(value_counts(df, group, value), group, value, ["cnt"])
    at = [(F.col("cnt_total") - 1) * F.lit(float(q)) for q in probabilities]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), side(h).alias("place"),
                                (h - F.floor(h)).alias("t"))
                       for i, h in enumerate(at) for end, side in (("lo", F.floor), ("hi", F.ceil))])
    # Few values cover a wanted place; only those become rows.
    held = F.filter(wanted, lambda w: (w["place"] >= F.col("cnt_before"))
                    & (w["place"] < F.col("cnt_before") + F.col("cnt")))
    hits = sums.select(*group, value, F.explode(held).alias("__w"))
    ends = hits.groupBy(*group, F.col("__w.i").alias("__i")).agg(
        F.max(F.when(F.col("__w.end") == "lo", F.col(value))).alias("__a"),
        F.max(F.when(F.col("__w.end") == "hi", F.col(value))).alias("__b"),
        F.max("__w.t").alias("__t"))
    point = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__t")
    return ends.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", point.alias("x")))),
                    lambda s: s["x"]).alias("edges"))


def outcome_counts(df, group, y, score):
    """Running counts of positive and negative outcomes per (group, score)."""
    counts = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*group, score).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    return running_sums(counts, group, score, ["pos", "neg"])


def auc_from_counts():
    """Aggregate over `outcome_counts`: ROC AUC, ties count one half, NULL for a single class."""
    return F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)),
                        F.max("pos_total").cast("double") * F.max("neg_total"))


# Rows are spread over 16**_HEX hash buckets for counting and ordering.
_HEX = 3


def hash_positions(df, group, key, first=None):
    """0-based `position` of each row of a group in the order of md5(key).

    Hashes are uniform, so bucket counts and their running sum stay small, and only rows of one
    bucket are sorted together. With `first`, buckets that start beyond it are dropped before
    that sort.
    """
    hashed = df.withColumn("__hash", F.md5(key)).withColumn(
        "__bucket", F.substring("__hash", 1, _HEX))
    w = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = hashed.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    buckets = buckets.select(*group, "__bucket",
                             F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    if first is not None:
        buckets = buckets.filter(F.col("__start") < first)
    joined = hashed.join(buckets, [*group, "__bucket"])
    order = Window.partitionBy(*group, "__bucket").orderBy("__hash", key)
    out = joined.withColumn("position", F.col("__start") + F.row_number().over(order) - 1)
    if first is not None:
        out = out.filter(F.col("position") < first)
    return out.drop("__hash", "__bucket", "__start")
