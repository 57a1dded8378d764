"""Subject performance, paired tests, vote calibration and probability metrics."""

import pyarrow as pa
from pyspark.sql import functions as F

from itemscope.operators.responses import first_per_item, require_metadata
from itemscope.functions.pvalues import fair_coin_p_udf
from itemscope.functions.scalar import clip, tenth_bin, tenth_label
from itemscope.operators.ranks import auc_from_counts, outcome_counts, with_min_ranks
from itemscope.schema import LONG
from itemscope.session import local_table

# The subject pairs compared when none are given.
DEFAULT_PAIRS = [
    ("baseline", "ruleset"), ("baseline", "5mini"), ("ruleset", "5mini"),
    ("deepseek_r1_14b_baseline", "deepseek_r1_14b_ruleset"),
    ("llama31_8b_baseline", "llama31_8b_ruleset"),
    ("phi4_baseline", "phi4_ruleset"),
    ("qwen253b_baseline", "qwen253b_ruleset"),
    ("qwen314b_baseline", "qwen314b_ruleset"),
]


def with_truth(cells, items):
    """Add `true_long`, from the label of the cell's item; of repeated items one row counts.

    A cell whose item is not among `items` is an error.
    """
    require_metadata(cells, items)
    truth = first_per_item(items.select("item_id", "ground_truth_mapped")).select(
        "item_id", F.coalesce((F.col("ground_truth_mapped") == LONG).cast("int"), F.lit(0))
        .alias("true_long"))
    return cells.join(truth, "item_id")


def observations(responses, items, decisions=None):
    """Rows (subject, item_id, y, decision, true_long); `decision` is NULL where unknown."""
    cells = responses.select("subject", "item_id", "y")
    if decisions is None:
        cells = cells.withColumn("decision", F.lit(None).cast("int"))
    else:
        cells = cells.join(decisions.select("item_id", "subject", "decision"),
                           ["item_id", "subject"], "left")
    return with_truth(cells, items)


def model_performance(obs, n_items, subjects=None):
    """Coverage, accuracy and class-wise performance of every subject, best first.

    `obs` comes from `observations`; `n_items` is the number of items asked. `subjects`, a
    DataFrame with a `subject` column, adds subjects that answered nothing.
    """
    both = F.col("y").isNotNull() & F.col("decision").isNotNull()
    cell = lambda truth, said: F.count_if(
        both & (F.col("true_long") == truth) & (F.col("decision") == said))
    agg = obs.groupBy("subject").agg(
        F.count("y").alias("observed_total"), F.avg("y").alias("accuracy"),
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    if subjects is not None:
        agg = subjects.select("subject").distinct().join(agg, "subject", "left").fillna(
            0, ["observed_total", "tp", "tn", "fp", "fn"])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    known = lambda c: F.when(n > 0, F.col(c)).alias(c)
    recall, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    out = agg.select(
        F.col("subject").alias("model"), "observed_total",
        (F.lit(n_items).cast("long") - F.col("observed_total")).alias("missing_total"),
        (F.col("observed_total") / F.lit(float(n_items))).alias("coverage"), "accuracy",
        # mean of the two rates, or the one that is defined
        F.coalesce((recall + specificity) / 2, recall, specificity).alias("balanced_accuracy"),
        recall.alias("long_recall"), specificity.alias("short_specificity"),
        F.try_divide(tp + fp, n).alias("predicted_long_rate"),
        F.try_divide(tp + fn, n).alias("true_long_rate_observed"),
        known("tp"), known("tn"), known("fp"), known("fn"))
    return with_min_ranks(out, {"accuracy": "accuracy_rank"}).orderBy(
        F.desc_nulls_last("accuracy"), F.desc_nulls_last("coverage"))


def subject_summary(responses, ability, n_items, irt_model="1pl"):
    """Ability table with totals and ranks, in the layout of the fitted ability artifacts."""
    totals = responses.groupBy("subject").agg(
        F.sum("y").cast("long").alias("correct"), F.count("y").alias("observed_total"))
    out = ability.select(F.col("subject").alias("model"), "ability").join(
        totals.withColumnRenamed("subject", "model"), "model", "left").fillna(
        0, ["correct", "observed_total"])
    out = out.select(
        F.lit(irt_model).alias("irt_model"), "model", "ability", "correct", "observed_total",
        (F.lit(n_items).cast("long") - F.col("observed_total")).alias("missing_total"),
        (F.col("observed_total") / F.lit(float(n_items))).alias("coverage"),
        F.try_divide("correct", "observed_total").alias("accuracy"))
    return with_min_ranks(out, {"ability": "ability_rank", "accuracy": "accuracy_rank"}).orderBy(
        F.desc("ability"))


def paired_comparisons(responses, pairs=None):
    """Accuracy difference, its 95% interval and the exact McNemar test for subject pairs.

    Cells of a pair meet on (item_id, subject): the first member's cells are tagged with the
    partner to look up, so a cell is only sent to the pairs it belongs to.
    """
    spark = responses.sparkSession
    pairs = DEFAULT_PAIRS if pairs is None else pairs
    listed = local_table(spark, dict.fromkeys(pairs),
                         {"model_a": pa.string(), "model_b": pa.string()})
    cells = responses.filter(F.col("y").isNotNull()).select("subject", "item_id", "y")
    first = cells.join(listed, F.col("subject") == F.col("model_a")).select(
        "model_a", "model_b", "item_id", F.col("y").alias("a"))
    second = cells.join(listed.select(F.col("model_b").alias("subject")).distinct(),
                        "subject", "left_semi").select(
        F.col("subject").alias("model_b"), "item_id", F.col("y").alias("b"))
    stats = first.join(second, ["item_id", "model_b"]).groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_overlap"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("a_correct_b_wrong"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("a_wrong_b_correct"))
    n, b10, b01 = F.col("n_overlap"), F.col("a_correct_b_wrong"), F.col("a_wrong_b_correct")
    delta = (b01 - b10) / n
    variance = F.try_divide((b10 + b01) - n * delta * delta, n - 1)
    half = 1.96 * F.sqrt(F.greatest(variance, F.lit(0.0)) / n)
    half = F.when(n > 1, half)
    return stats.select(
        "model_a", "model_b", "n_overlap",
        (F.col("sum_a") / n).alias("accuracy_a"), (F.col("sum_b") / n).alias("accuracy_b"),
        delta.alias("delta_b_minus_a"), (delta - half).alias("ci95_low"),
        (delta + half).alias("ci95_high"), "a_correct_b_wrong", "a_wrong_b_correct",
        (b10 + b01).alias("discordant"),
        fair_coin_p_udf(F.least(b10, b01), b10 + b01).alias("mcnemar_exact_p"))


def vote_fraction_summary(decisions, items):
    """Truth rate by tenth of the share of subjects that decide `long`."""
    votes = decisions.groupBy("item_id").agg(
        F.avg("decision").alias("share"), F.count("decision").alias("voters")).filter(
        F.col("voters") > 0)
    return (
        with_truth(votes, items).withColumn("bin", tenth_bin("share")).groupBy("bin").agg(
            F.count(F.lit(1)).alias("n_cases"),
            F.avg("share").alias("mean_long_vote_fraction"),
            F.avg("true_long").alias("empirical_true_long_rate"),
            F.avg("voters").alias("mean_observed_models"))
        .orderBy("bin")
        .select(tenth_label("bin").alias("vote_bin"), "n_cases", "mean_long_vote_fraction",
                "empirical_true_long_rate", "mean_observed_models"))


def binary_metrics(df, group, y, p, threshold=0.5, accuracy="accuracy", clip_auc=False):
    """n, accuracy, Brier score, log-loss and AUC of probability `p` for each group.

    Brier score and log-loss use `p` clipped to [1e-6, 1 - 1e-6]; the AUC does so only with
    `clip_auc`.
    """
    scored = df.select(*group, F.col(y).cast("int").alias("y"),
                       (clip(p, 1e-6, 1 - 1e-6) if clip_auc else F.col(p)).alias("p"))
    # everything follows from the counts per distinct probability, so the input is read once
    counts = outcome_counts(scored, group, "y", "p")
    pos, neg, n = F.col("pos"), F.col("neg"), F.sum(F.col("pos") + F.col("neg"))
    q = clip("p", 1e-6, 1 - 1e-6)
    return counts.groupBy(*group).agg(
        n.alias("n"),
        (F.sum(F.when(F.col("p") >= threshold, pos).otherwise(neg)) / n).alias(accuracy),
        (F.sum(pos * (1 - q) * (1 - q) + neg * q * q) / n).alias("brier"),
        (-F.sum(pos * F.log(q) + neg * F.log(1 - q)) / n).alias("logloss"),
        auc_from_counts().alias("auc"))
