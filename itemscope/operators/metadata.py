"""Item metadata: flattening, severity scores, feature frames."""

from pyspark.sql import functions as F

from itemscope.functions.nested import nested_dict, text_or_blank, with_parsed_dict
from itemscope.functions.scalar import first_match, to_number
from itemscope.operators.ranks import exact_quantiles
from itemscope.schema import CATEGORICAL, LONG, NUMERIC, SCORES

# Damage words and their scores.
DAMAGE_SCORES = {"No Damage": 0, "Some Damage": 1, "Moderate Damage": 2, "A lot of Damage": 3}
# Words looked for in shortage answers, first hit counts.
SHORTAGE_RULES = [("no ", 0), ("never", 0), ("some", 1), ("a lot", 2), ("lot", 2), ("always", 0)]
SHORTAGE_COLUMNS = {"WaterAccess": "water_score", "PowerAccess": "power_score",
                    "FoodAccess": "food_score", "UnsanitaryConditions": "unsanitary_score"}


def flatten_metadata(metadata):
    """Item table with the nested household record spread over plain columns, plus scores.

    The record is read from `feature_key`, or from `household_attributes` where that is empty.
    """
    df = metadata
    for name in ("feature_key", "household_attributes"):
        df = with_parsed_dict(df, name, f"__{name}") if name in metadata.columns else \
            df.withColumn(f"__{name}", F.create_map().cast("map<string,string>"))
    df = df.withColumn("__d", F.when(F.size("__feature_key") > 0, F.col("__feature_key"))
                       .otherwise(F.col("__household_attributes")))
    d, soc = F.col("__d"), F.col("__soc")
    df = df.withColumn("__soc", nested_dict(d, "SocioEconomicParameters"))
    has = set(metadata.columns)
    text = lambda m, *names: [text_or_blank(m, n).alias(n) for n in names]
    count = lambda key, name: to_number(soc[key]).alias(name)
    flat = df.select(
        "item_id",
        F.col("case_id" if "case_id" in has else "item_id").alias("case_id"),
        (F.col("ground_truth") if "ground_truth" in has
         else d["DisplacementDuration"]).alias("ground_truth"),
        "ground_truth_mapped",
        *text(soc, "State", "MSA", "Tenure", "Income"),
        count("Occupants", "Occupants"), count("Kids5years", "Kids5years"),
        count("Kids5-11years", "Kids5_11years"), count("Kids12-17years", "Kids12_17years"),
        *text(soc, "EmploymentStatus"),
        *text(d, "BuildingDamage", "DisasterType", "WaterAccess", "PowerAccess", "FoodAccess",
              "UnsanitaryConditions"),
        F.coalesce((F.col("ground_truth_mapped") == LONG).cast("int"), F.lit(0)).alias("true_long"))
    return add_severity_scores(flat)


def add_severity_scores(df):
    """Ordinal cue scores, their total, and flags where cues and label disagree."""
    text = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    damage = text("BuildingDamage")
    scale = None
    for word, score in DAMAGE_SCORES.items():
        scale = F.when(damage == word, score) if scale is None else scale.when(damage == word, score)
    out = df.withColumn("damage_score", F.coalesce(scale.cast("double"), F.lit(0.0)))
    for source, name in SHORTAGE_COLUMNS.items():
        out = out.withColumn(
            name, F.coalesce(first_match(text(source), SHORTAGE_RULES), F.lit(0.0)))
    total = sum((F.col(c) for c in SCORES[1:-1]), F.col(SCORES[0]))
    out = out.withColumn("total_severity_score", total)
    flag = lambda cond: cond.cast("int")
    out = out.withColumn("severe_cues", flag(
        (F.col("damage_score") >= 2) | (F.col("total_severity_score") >= 5)))
    out = out.withColumn("weak_cues", flag(
        (F.col("damage_score") <= 0) & (F.col("total_severity_score") <= 1)))
    if "true_long" in df.columns:
        out = out.withColumn("severe_cues_short", flag(
            (F.col("severe_cues") == 1) & (F.col("true_long") == 0)))
        out = out.withColumn("weak_cues_long", flag(
            (F.col("weak_cues") == 1) & (F.col("true_long") == 1)))
        out = out.withColumn("simple_cue_label_conflict", flag(
            (F.col("severe_cues_short") == 1) | (F.col("weak_cues_long") == 1)))
    return out


def numeric_medians(df, columns):
    """One row with the exact median of every column, under the column's name."""
    long = df.select(*[to_number(c).alias(c) for c in columns]).unpivot(
        [], list(columns), "name", "value")
    med = exact_quantiles(long, ["name"], "value", [0.5])
    return med.groupBy().agg(*[
        F.max(F.when(F.col("name") == c, F.col("edges")[0])).alias(c) for c in columns])


def feature_frame(flat, include_scores=True):
    """item_id and the label-free features; numbers are filled with the column's median.

    `include_scores=False` drops every numeric column, not only the scores.
    """
    cats = [c for c in CATEGORICAL if c in flat.columns]
    nums = [c for c in NUMERIC if c in flat.columns] if include_scores else []
    numbers = flat.select("item_id", *cats, *[to_number(c).alias(c) for c in nums])
    if not nums:
        return numbers
    fill = numeric_medians(numbers, nums).first()
    return numbers.select("item_id", *cats, *[
        F.coalesce(F.col(c), F.lit(fill[c]).cast("double")).alias(c) for c in nums])
