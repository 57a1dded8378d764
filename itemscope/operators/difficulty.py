"""Ability and difficulty tables and their summaries."""

from pyspark.sql import functions as F

from itemscope.functions.scalar import rasch_probability
from itemscope.operators.ranks import exact_quantiles

# Performance columns that replace those of an ability table.
PERFORMANCE_COLUMNS = ["accuracy", "coverage", "balanced_accuracy", "long_recall",
                       "short_specificity", "predicted_long_rate"]
# Columns averaged per decile where present.
DECILE_COLUMNS = ["empirical_accuracy", "empirical_difficulty", "simple_cue_label_conflict",
                  "feature_label_surprisal", "feature_ambiguity", "severe_cues_short",
                  "weak_cues_long", "damage_score", "total_severity_score"]


def ability_table(ability, performance=None):
    """Ability joined with performance, best ability first."""
    if performance is None:
        return ability.orderBy(F.desc_nulls_last("ability"))
    new = [c for c in PERFORMANCE_COLUMNS if c in performance.columns]
    return ability.drop(*new).join(performance.select("model", *new), "model", "left").orderBy(
        F.desc_nulls_last("ability"))


def top_by_ability(ability, n):
    return ability.orderBy(F.desc_nulls_last("ability"), "model").limit(n)


def item_difficulty_table(item_params, flat=None):
    """Item parameters joined with metadata; parameter columns win on equal names."""
    if flat is None:
        return item_params
    keep = ["item_id"] + [c for c in flat.columns if c not in item_params.columns]
    return item_params.join(flat.select(*keep), "item_id", "left")


def probability_by_difficulty(ability, difficulties):
    """Rasch probability of every subject at each listed difficulty."""
    grid = F.explode(F.array(*[F.lit(float(d)) for d in difficulties]))
    return ability.select("model", "ability", grid.alias("difficulty")).withColumn(
        "p_correct", rasch_probability("ability", "difficulty"))


def with_quantile_bin(df, column, q=10, out="difficulty_decile", digits=9):
    """Add the 1-based quantile bin of `column` to the rows where it is known.

    Edges are interpolated linearly, equal edges merge, bins are closed on the right. Values and
    edges are compared after rounding to `digits`, so that a value on an edge falls the same way
    however the edge was summed up.
    """
    known = df.filter(F.col(column).isNotNull())
    x = F.round(F.col(column), digits)
    row = exact_quantiles(known.select(x.alias("x")), [], "x", [i / q for i in range(q + 1)]).first()
    if row is None:
        return known.withColumn(out, F.lit(None).cast("int"))
    edges = sorted({round(e, digits) for e in row["edges"]})
    # bin number = how many inner edges lie below the value, plus one
    below = sum(((x > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(1))
    return known.withColumn(out, below)


def difficulty_decile_summary(item_table, difficulty="difficulty"):
    """Size, mean difficulty and mean item properties by difficulty decile."""
    present = [c for c in DECILE_COLUMNS if c in item_table.columns]
    return with_quantile_bin(item_table, difficulty).groupBy("difficulty_decile").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(difficulty).alias("mean_irt_difficulty"),
        *[F.avg(c).alias(c) for c in present]).orderBy("difficulty_decile")


def damage_label_difficulty(item_table):
    """Difficulty by damage answer and binary label, hardest first; an unknown damage answer is a
    group of its own."""
    if "true_long" not in item_table.columns:
        raise ValueError("a column true_long is needed; flatten the metadata first")
    conflict = ("simple_cue_label_conflict" if "simple_cue_label_conflict" in item_table.columns
                else "true_long")
    label = F.when(F.col("true_long") == 1, "MoreThanAWeek").otherwise("LessThanAWeek")
    return item_table.groupBy("BuildingDamage", label.alias("binary_label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("difficulty").alias("mean_irt_difficulty"),
        F.avg("empirical_accuracy").alias("empirical_accuracy"),
        F.avg("true_long").alias("true_long_rate"),
        F.avg(conflict).alias("conflict_rate")).orderBy(F.desc_nulls_last("mean_irt_difficulty"))


def damage_label_key(summary):
    """Display key `BuildingDamage | binary_label` of a damage/label summary."""
    return summary.withColumn("group", F.concat_ws(
        " | ", F.coalesce("BuildingDamage", F.lit("nan")), "binary_label"))
