"""The full analysis: from the core tables to all result tables."""

from itemscope.operators import coldstart, difficulty, metadata, performance, residuals, validity
from itemscope.operators.design import encode_features
from itemscope.operators.responses import decisions_from_metadata, first_per_item, require_metadata
from itemscope.session import written
from itemscope.sources.tables import load_core_tables, save_tables


def analysis_tables(core, seeds=(2026, 2027, 2028, 2029, 2030), ks=(0, 1, 2, 4, 8), test_size=500,
                    residual_factors=5, pairs=None, min_observed=10):
    """Dict of the result tables computed from the tables of `load_core_tables`.

    Tables that several results share are written once: later plans stay short and know the size
    of what they read. Items that nobody answered are described and scored like the others; only
    the cold start of the answers keeps to the items of the matrix. An item of the matrix without
    metadata is an error.
    """
    responses = written(core["responses"], "responses")
    asked = core["matrix_items"] if "matrix_items" in core else responses.select("item_id").distinct()
    meta = written(first_per_item(core["case_metadata"]), "metadata")
    require_metadata(asked.select("item_id").unionByName(responses.select("item_id")), meta)
    flat = written(metadata.flatten_metadata(meta), "flat-metadata")
    encoded = encode_features(flat)
    n_items = asked.count()
    in_matrix = written(flat.join(asked, "item_id", "left_semi"), "matrix-metadata")
    decisions = written(decisions_from_metadata(meta, responses.select("subject")), "decisions")

    obs = performance.observations(responses, meta, decisions)
    perf = performance.model_performance(obs, n_items)
    scored = validity.feature_label_scores(flat, encoded=encoded)
    item_table = written(difficulty.item_difficulty_table(core["item_params"], scored), "items")
    ability = core["subject_ability"].withColumnRenamed("model", "subject")
    factors = residuals.residual_factor_analysis(
        responses, ability, core["item_params"], residual_factors)
    tables = {
        "flattened_case_metadata": flat,
        "model_performance": perf,
        "irt_ability_with_performance": difficulty.ability_table(core["subject_ability"], perf),
        "paired_comparisons": performance.paired_comparisons(responses, pairs),
        "feature_label_model_metrics": validity.feature_label_metrics(scored),
        "item_table_with_validity_features": item_table,
        "difficulty_validity_correlations": validity.difficulty_validity_correlations(item_table),
        "difficulty_decile_summary": difficulty.difficulty_decile_summary(item_table),
        "damage_label_difficulty": difficulty.damage_label_difficulty(item_table),
        "vote_fraction_summary": performance.vote_fraction_summary(decisions, meta),
        "residual_factor_subject_loadings": factors["subject_factors"],
        "residual_factor_item_loadings": factors["item_factors"],
        "residual_factor_variance": factors["variance"],
    }
    for target, cells, items, coded in (
            ("correctness", responses, in_matrix, None),
            ("decision", decisions.withColumnRenamed("decision", "y"), flat, encoded)):
        run = coldstart.run_cold_start(cells, items, seeds, ks, test_size,
                                       min_observed=min_observed, encoded=coded)
        tables[f"kfactor_{target}_coldstart_summary"] = run.summary
        tables[f"kfactor_{target}_coldstart_by_split"] = run.metrics_by_split
        tables[f"kfactor_{target}_coldstart_diagnostics_summary"] = run.diagnostics_summary
        tables[f"kfactor_{target}_coldstart_diagnostics_by_split"] = run.diagnostics_by_split
    return tables


def run_analysis(spark, folder, out, fmt="csv", **options):
    """Read the core tables under `folder` and write every result table under `out`."""
    tables = analysis_tables(load_core_tables(spark, folder), **options)
    save_tables(tables, out, fmt)
    return tables
