"""Registered queries: every operator applied to response tables of the star-schema data.

A query takes (spark, sf_dir) and returns a DataFrame; numbers are rounded to six digits.
"""

import uuid

from pyspark.sql import functions as F

from itemscope.functions.scalar import rounded
from itemscope.operators import (
    coldstart, difficulty, fits, households, metadata, performance, residuals, responses, validity)
from itemscope.session import shared_dir, written
from itemscope.sources import runs, starschema, tables

PAIRS = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(24)]
DIFFICULTIES = [-2.0, -1.0, 0.0, 0.5, 1.0, 2.0]
SEEDS = (2026, 2027, 2028)
ALL_SEEDS = (2026, 2027, 2028, 2029, 2030)
KS = (0, 1, 2, 4, 8)
MIN_OBSERVED = 5


def _n_items(spark, sf_dir):
    return starschema.table(spark, sf_dir, "part").count()


def _test_size(spark, sf_dir):
    return max(20, _n_items(spark, sf_dir) // 10)


def _performance(spark, sf_dir):
    return performance.model_performance(
        starschema.observations(spark, sf_dir), _n_items(spark, sf_dir))


def _written_cells(spark, sf_dir):
    """The response rows as a table of their own, for queries that read them several times."""
    return written(starschema.responses(spark, sf_dir), "responses")


def model_performance(spark, sf_dir):
    return rounded(_performance(spark, sf_dir))


def paired_comparisons(spark, sf_dir):
    return rounded(performance.paired_comparisons(_written_cells(spark, sf_dir), PAIRS))


def decision_matrix_long(spark, sf_dir):
    return responses.decisions_from_metadata(starschema.wide_metadata(spark, sf_dir))


def vote_fraction_summary(spark, sf_dir):
    return rounded(performance.vote_fraction_summary(
        starschema.decisions(spark, sf_dir), starschema.items(spark, sf_dir)))


def flattened_metadata(spark, sf_dir):
    return rounded(metadata.flatten_metadata(starschema.case_metadata(spark, sf_dir)))


def severity_scores(spark, sf_dir):
    flat = starschema.flat_items(spark, sf_dir)
    return rounded(flat.select(
        "item_id", "true_long", "damage_score", "water_score", "power_score", "food_score",
        "unsanitary_score", "total_severity_score", "severe_cues", "weak_cues",
        "severe_cues_short", "weak_cues_long", "simple_cue_label_conflict"))


def feature_frame(spark, sf_dir):
    return rounded(metadata.feature_frame(starschema.flat_items(spark, sf_dir)))


def _ability(spark, sf_dir):
    return residuals.moment_abilities(starschema.responses(spark, sf_dir))


def ability_with_performance(spark, sf_dir):
    ability = _ability(spark, sf_dir).select(
        F.col("subject").alias("model"), "ability", F.lit(-1.0).alias("accuracy"))
    return rounded(difficulty.ability_table(ability, _performance(spark, sf_dir)))


def top_subjects_by_ability(spark, sf_dir):
    ability = _ability(spark, sf_dir).select(F.col("subject").alias("model"), "ability")
    return rounded(difficulty.top_by_ability(ability, 5))


def _item_table(spark, sf_dir):
    params = residuals.moment_difficulties(starschema.responses(spark, sf_dir))
    return difficulty.item_difficulty_table(params, starschema.flat_items(spark, sf_dir))


def item_difficulty_table(spark, sf_dir):
    return rounded(_item_table(spark, sf_dir).select(
        "item_id", "difficulty", "empirical_accuracy", "empirical_difficulty", "BuildingDamage",
        "WaterAccess", "true_long", "total_severity_score", "simple_cue_label_conflict"))


def difficulty_decile_summary(spark, sf_dir):
    table = written(_item_table(spark, sf_dir), "item-table")
    return rounded(difficulty.difficulty_decile_summary(table))


def damage_label_difficulty(spark, sf_dir):
    return rounded(difficulty.damage_label_key(
        difficulty.damage_label_difficulty(_item_table(spark, sf_dir))))


def _correlations(spark, sf_dir):
    table = _item_table(spark, sf_dir).withColumn("difficulty", F.round("difficulty", 9)) \
        .withColumn("empirical_difficulty", F.round("empirical_difficulty", 9))
    return validity.difficulty_validity_correlations(table)


def difficulty_validity_correlations(spark, sf_dir):
    return rounded(_correlations(spark, sf_dir).drop("p_value"))


def difficulty_validity_p_values(spark, sf_dir):
    return rounded(_correlations(spark, sf_dir).select("construct_validity_variable", "p_value"))


def rasch_probability_grid(spark, sf_dir):
    ability = _ability(spark, sf_dir).select(F.col("subject").alias("model"), "ability")
    return rounded(difficulty.probability_by_difficulty(ability, DIFFICULTIES))


def moment_1pl_items(spark, sf_dir):
    return rounded(residuals.moment_difficulties(starschema.responses(spark, sf_dir)))


def moment_1pl_subjects(spark, sf_dir):
    return rounded(_ability(spark, sf_dir))


def _residuals(cells):
    return residuals.residuals(cells, residuals.moment_abilities(cells),
                               residuals.moment_difficulties(cells))


def residual_long(spark, sf_dir):
    return rounded(_residuals(_written_cells(spark, sf_dir)).drop("split"))


def residual_gram(spark, sf_dir):
    cells = _written_cells(spark, sf_dir)
    return rounded(residuals.residual_gram(_residuals(cells)).drop("split"), 5)


def _factors(spark, sf_dir, name):
    cells = _written_cells(spark, sf_dir)
    return rounded(residuals.residual_factor_analysis(
        cells, residuals.moment_abilities(cells), residuals.moment_difficulties(cells))[name])


def residual_factor_subject(spark, sf_dir):
    return _factors(spark, sf_dir, "subject_factors")


def residual_factor_item(spark, sf_dir):
    return _factors(spark, sf_dir, "item_factors")


def residual_factor_variance(spark, sf_dir):
    return _factors(spark, sf_dir, "variance")


def _scored(spark, sf_dir):
    return validity.feature_label_scores(starschema.flat_items(spark, sf_dir))


def feature_label_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select(
        "item_id", "true_long", "feature_p_long", "feature_label_surprisal", "feature_ambiguity"))


def feature_label_metrics(spark, sf_dir):
    return rounded(validity.feature_label_metrics(_scored(spark, sf_dir)))


def label_folds(spark, sf_dir):
    flat = starschema.flat_items(spark, sf_dir).select("item_id", "true_long")
    return validity.stratified_folds(flat)


def binary_metrics(spark, sf_dir):
    """Each subject's decisions judged by the share of subjects that decided long."""
    seen = starschema.observations(spark, sf_dir)
    share = seen.groupBy("item_id").agg(F.avg("decision").alias("p"))
    return rounded(performance.binary_metrics(
        seen.join(share, "item_id"), ["subject"], "true_long", "p"))


def eligible_items(spark, sf_dir):
    return responses.eligible_items(starschema.responses(spark, sf_dir), 10)


def aligned_metadata(spark, sf_dir):
    """Repeated metadata rows reduced to the first one, and to items that were answered."""
    items = starschema.items(spark, sf_dir).select("item_id", "ground_truth_mapped", "State")
    repeated = items.withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "State", F.concat_ws("-", "State", F.col("ordinal").cast("string")))
    return responses.align_metadata(repeated, starschema.responses(spark, sf_dir), "ordinal")


def missing_item_ids(spark, sf_dir):
    known = starschema.items(spark, sf_dir).filter(F.col("State") != "Brand#11")
    return responses.missing_item_ids(starschema.responses(spark, sf_dir), known)


def coldstart_split(spark, sf_dir):
    observed = responses.observer_counts(starschema.responses(spark, sf_dir))
    return coldstart.held_out_items(observed, SEEDS, _test_size(spark, sf_dir), MIN_OBSERVED)


_runs = {}


def _cold_start(spark, sf_dir, target="y"):
    """The experiment behind the cold-start queries; its written tables are shared by them."""
    key = (spark.sparkContext.applicationId, sf_dir, target)
    if key not in _runs:
        cells = written(starschema.observations(spark, sf_dir).select(
            "subject", "item_id", F.col(target).alias("y")), "cells")
        _runs[key] = coldstart.run_cold_start(
            cells, starschema.flat_items(spark, sf_dir), ALL_SEEDS, KS,
            _test_size(spark, sf_dir), min_observed=MIN_OBSERVED)
    return _runs[key]


def forget_runs():
    _runs.clear()


def coldstart_baselines(spark, sf_dir):
    """The two baselines of the experiment, which need no metadata."""
    m = _cold_start(spark, sf_dir).metrics_by_split
    return rounded(m.filter(F.col("method").isin(
        coldstart.SUBJECT_MEAN, coldstart.ITEM_MEAN)).drop("factor_scale_c"))


def coldstart_predictions(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir).predictions(2026, 4))


def coldstart_by_split(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir).metrics_by_split)


def coldstart_summary(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir).summary)


def coldstart_diagnostics(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir).diagnostics_by_split)


def coldstart_diagnostics_summary(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir).diagnostics_summary)


def coldstart_decision_summary(spark, sf_dir):
    return rounded(_cold_start(spark, sf_dir, "decision").summary)


def household_complete(spark, sf_dir):
    whole = households.complete_households(starschema.households(spark, sf_dir))
    return whole.select("household_id", "DisasterType", "DisplacementDuration",
                        F.col("SocioEconomicParameters.State").alias("State"),
                        households.duration_to_decision("DisplacementDuration").alias("truth"))


def household_sample(spark, sf_dir):
    """Three quarters of the usable households in seeded order, without the first ten."""
    whole = household_complete(spark, sf_dir)
    return households.select_households(whole, "household_id", whole.count() * 3 // 4, 42, 10)


def _mock(record):
    if record["household_id"] % 10 == 3:
        raise RuntimeError("no answer")
    return "LeaveHomeForLessThanAWeek" if record["household_id"] % 5 == 1 else record["truth"]


def _decided(spark, sf_dir):
    return households.decide_households(household_complete(spark, sf_dir).select(
        "household_id", "truth"), _mock)


def agent_batch_decide(spark, sf_dir):
    return _decided(spark, sf_dir).drop("elapsed_s")


def run_accuracy(spark, sf_dir):
    return rounded(households.run_accuracy(_decided(spark, sf_dir)).select(
        "n_selected", "n_decided", "n_errors", "n_correct", "accuracy"))


def run_metadata(spark, sf_dir):
    found = runs.run_metadata(_decided(spark, sf_dir), {"Model": "mock", "Seed": 42})
    return rounded(found.drop("total_runtime_s", "average_runtime_s"))


def agent_decisions_round_trip(spark, sf_dir):
    """Decisions of a run that was written as files, as its reader gives them."""
    folder = f"{shared_dir(spark)}/itemscope/runs-{uuid.uuid4().hex}"
    decided = written(_decided(spark, sf_dir), "decided")
    runs.write_run(decided, runs.run_metadata(decided, {"Seed": 42}), f"{folder}/mock", "household_id")
    return runs.run_decisions(spark, folder, "household_id long, decision string, row_number int")


def subject_summary(spark, sf_dir):
    cells = _written_cells(spark, sf_dir)
    return rounded(performance.subject_summary(
        cells, residuals.moment_abilities(cells), _n_items(spark, sf_dir)))


def rasch_fit(spark, sf_dir):
    cells = _written_cells(spark, sf_dir)
    subjects, _ = fits.rasch_fit(cells)
    return rounded(performance.subject_summary(cells, subjects, _n_items(spark, sf_dir)))


def rasch_fit_items(spark, sf_dir):
    return rounded(fits.rasch_fit(starschema.responses(spark, sf_dir))[1])


def twopl_fit(spark, sf_dir):
    cells = _written_cells(spark, sf_dir)
    subjects, _ = fits.twopl_fit(cells)
    return rounded(performance.subject_summary(cells, subjects, _n_items(spark, sf_dir), "2pl"))


def kfactor_fit(spark, sf_dir):
    cells = _written_cells(spark, sf_dir)
    start = residuals.factor_subjects(written(_residuals(cells), "residual-cells"), 2, cells)
    subjects, _ = fits.kfactor_fit(cells, 2, start)
    return rounded(fits.factor_table(subjects, cells, _n_items(spark, sf_dir), 2))


def saved_table_read_back(spark, sf_dir):
    """Moment difficulties written as CSV and read with their schema."""
    folder = f"{shared_dir(spark)}/itemscope/saved-{uuid.uuid4().hex}"
    params = residuals.moment_difficulties(starschema.responses(spark, sf_dir)).select(
        "item_id", "difficulty")
    tables.save_tables({"item_params": params}, folder)
    return rounded(tables.read_csv(spark, f"{folder}/item_params", tables.ITEM_PARAMS))


def response_matrix_file(spark, sf_dir):
    """A wide matrix written as CSV, with the parts as its subjects and a comma in the names of its
    columns, and its rows as the reader gives them."""
    folder = f"{shared_dir(spark)}/itemscope/matrix-{uuid.uuid4().hex}"
    nations = [r[0] for r in starschema.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).orderBy("n_nationkey").collect()]
    wide = starschema.responses(spark, sf_dir).groupBy("item_id").pivot("subject", nations).agg(F.max("y"))
    wide.select(F.col("item_id").alias("model"), *[F.col(n).alias(f'{n}, "asked"') for n in nations]).write.csv(
        folder, header=True, escape='"')
    return tables.read_response_matrix(spark, folder)


ALL = {f.__name__: f for f in (
    model_performance, paired_comparisons, decision_matrix_long, vote_fraction_summary,
    flattened_metadata, severity_scores, feature_frame, ability_with_performance,
    top_subjects_by_ability, item_difficulty_table, difficulty_decile_summary,
    damage_label_difficulty, difficulty_validity_correlations, difficulty_validity_p_values,
    rasch_probability_grid, moment_1pl_items, moment_1pl_subjects, residual_long, residual_gram,
    residual_factor_subject, residual_factor_item, residual_factor_variance, feature_label_scores,
    feature_label_metrics, label_folds, binary_metrics, eligible_items, aligned_metadata,
    missing_item_ids, coldstart_split, coldstart_baselines, coldstart_predictions,
    coldstart_by_split, coldstart_summary, coldstart_diagnostics, coldstart_diagnostics_summary,
    coldstart_decision_summary, household_complete, household_sample, agent_batch_decide,
    run_accuracy, run_metadata, agent_decisions_round_trip, subject_summary, rasch_fit, rasch_fit_items, twopl_fit, kfactor_fit,
    saved_table_read_back, response_matrix_file)}
