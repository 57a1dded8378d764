import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemscope.operators import difficulty, metadata, validity
from itemscope.schema import LONG, SHORT
from tests.conftest import to_rows

RECORD = {"SocioEconomicParameters": {"State": "TX", "Occupants": 3, "Kids5-11years": "2",
                                      "Tenure": None},
          "BuildingDamage": "A lot of Damage", "WaterAccess": "A lot of shortage",
          "DisplacementDuration": "Less than a week"}


def test_flatten_metadata(spark):
    rows = [("i1", LONG, json.dumps(RECORD), None), ("i2", SHORT, "{}", repr(RECORD)),
            ("i3", None, "", "")]
    df = spark.createDataFrame(
        rows, "item_id string, ground_truth_mapped string, feature_key string, "
              "household_attributes string")
    a, b, c = metadata.flatten_metadata(df).orderBy("item_id").collect()
    for r in (a, b):
        assert (r["State"], r["MSA"], r["Tenure"]) == ("TX", "", None)
        assert (r["Occupants"], r["Kids5_11years"], r["Kids5years"]) == (3.0, 2.0, None)
        assert (r["damage_score"], r["water_score"], r["total_severity_score"]) == (3.0, 2.0, 5.0)
        assert (r["case_id"], r["ground_truth"]) == (r["item_id"], "Less than a week")
    assert (a["true_long"], a["severe_cues"], a["simple_cue_label_conflict"]) == (1, 1, 0)
    assert (b["true_long"], b["severe_cues_short"], b["simple_cue_label_conflict"]) == (0, 1, 1)
    assert (c["State"], c["ground_truth"], c["true_long"], c["weak_cues"]) == ("", None, 0, 1)


def test_present_columns_are_not_replaced_cell_by_cell(spark):
    df = spark.createDataFrame(
        [("i1", None, None, LONG, json.dumps(RECORD))],
        "item_id string, case_id string, ground_truth string, ground_truth_mapped string, "
        "feature_key string")
    r = metadata.flatten_metadata(df).first()
    assert r["case_id"] is None and r["ground_truth"] is None


def test_feature_frame(spark):
    df = spark.createDataFrame([("a", "TX", "4"), ("b", "", "x"), ("c", None, "1")],
                               "item_id string, State string, Occupants string")
    assert to_rows(metadata.feature_frame(df), "item_id") == [
        ("a", "TX", 4.0), ("b", "", 2.5), ("c", None, 1.0)]
    assert metadata.feature_frame(df, include_scores=False).columns == ["item_id", "State"]


def test_ability_and_difficulty_tables(spark):
    ability = spark.createDataFrame([("m", 0.1, 0.9), ("n", 0.5, 0.8)],
                                    "model string, ability double, accuracy double")
    perf = spark.createDataFrame([("m", 0.7, 5)], "model string, accuracy double, tp int")
    assert to_rows(difficulty.ability_table(ability, perf)) == [("n", 0.5, None), ("m", 0.1, 0.7)]
    assert to_rows(difficulty.ability_table(ability))[0] == ("n", 0.5, 0.8)
    assert to_rows(difficulty.top_by_ability(ability, 1)) == [("n", 0.5, 0.8)]
    params = spark.createDataFrame([("i", 1.0)], "item_id string, difficulty double")
    flat = spark.createDataFrame([("i", 9.0, "x")], "item_id string, difficulty double, State string")
    assert to_rows(difficulty.item_difficulty_table(params, flat)) == [("i", 1.0, "x")]
    assert difficulty.item_difficulty_table(params) is params


def test_damage_label_summary(spark):
    rows = [("a", None, 1, 2.0, 0.5), ("b", None, 1, 4.0, 0.7), ("c", "No Damage", 0, 1.0, 0.9)]
    table = spark.createDataFrame(rows, "item_id string, BuildingDamage string, true_long int, "
                                        "difficulty double, empirical_accuracy double")
    got = to_rows(difficulty.damage_label_key(difficulty.damage_label_difficulty(table)))
    assert got[0] == (None, "MoreThanAWeek", 2, 3.0, 0.6, 1.0, 1.0, "nan | MoreThanAWeek")
    assert got[1][:4] == ("No Damage", "LessThanAWeek", 1, 1.0)
    with pytest.raises(ValueError):
        difficulty.damage_label_difficulty(table.drop("true_long"))


def _spearman(x, y):
    a, b = pd.Series(x).rank(), pd.Series(y).rank()
    return np.corrcoef(a, b)[0, 1]


def test_validity_correlations(spark):
    rng = np.random.default_rng(5)
    n = 200
    d = rng.integers(0, 40, n) / 7.0
    damage = np.where(rng.random(n) < 0.5, 0.0, rng.integers(0, 4, n).astype(float))
    own = d + rng.normal(size=n)
    rows = [(float(a), float(b) if i % 3 else None, float(c), 1.0 if i < 2 else None)
            for i, (a, b, c) in enumerate(zip(d, damage, own))]
    table = spark.createDataFrame(rows, "difficulty double, damage_score double, "
                                        "empirical_difficulty double, feature_ambiguity double")
    got = {r["column"]: r for r in validity.difficulty_validity_correlations(table).collect()}
    assert list(got) == ["empirical_difficulty", "feature_ambiguity", "damage_score"]
    keep = np.arange(n) % 3 > 0
    r = got["damage_score"]
    assert r["n"] == keep.sum()
    assert r["spearman_corr_with_irt_difficulty"] == pytest.approx(
        _spearman(d[keep], damage[keep]))
    r = got["empirical_difficulty"]
    assert r["spearman_corr_with_irt_difficulty"] == pytest.approx(_spearman(d, own))
    assert 0 <= r["p_value"] < 1e-6
    r = got["feature_ambiguity"]
    assert (r["n"], r["spearman_corr_with_irt_difficulty"], r["p_value"]) == (2, None, None)


def test_label_model_against_numpy(spark):
    rng = np.random.default_rng(11)
    n, k = 120, 3
    state = rng.choice(["", "TX", "FL"], n)
    occ = rng.integers(1, 6, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(occ - 3 + (state == "TX"))))).astype(int)
    flat = spark.createDataFrame(
        [(f"i{i}", str(state[i]), float(occ[i]), int(y[i])) for i in range(n)],
        "item_id string, State string, Occupants double, true_long int")
    scored = validity.feature_label_scores(flat, n_splits=k, seed=1)
    got = {r["item_id"]: r for r in scored.collect()}
    folds = {r["item_id"]: r["fold"] for r in validity.stratified_folds(flat, k, 1).collect()}
    fold = np.array([folds[f"i{i}"] for i in range(n)])
    for c in (0, 1):
        sizes = np.bincount(fold[y == c], minlength=k)
        assert sizes.max() - sizes.min() <= 1
    for f in range(k):
        train = fold != f
        m, s = occ[train].mean(), occ[train].std()
        a = np.column_stack([state == v for v in ("", "FL", "TX")] + [(occ - m) / s, np.ones(n)])
        a = a.astype(float)
        w = np.zeros(5)
        pen = np.array([1, 1, 1, 1, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-a[train] @ w))
            h = (a[train] * (p * (1 - p))[:, None]).T @ a[train] + np.diag(pen)
            w -= np.linalg.solve(h, a[train].T @ (p - y[train]) + pen * w)
        for i in np.where(~train)[0]:
            p = 1 / (1 + np.exp(-a[i] @ w))
            r = got[f"i{i}"]
            assert r["feature_p_long"] == pytest.approx(p, abs=1e-6)
            assert r["feature_label_surprisal"] == pytest.approx(
                -np.log(p if y[i] else 1 - p), abs=1e-5)
            assert r["feature_ambiguity"] == pytest.approx(1 - abs(2 * p - 1), abs=1e-5)
    metrics = validity.feature_label_metrics(scored).first()
    assert metrics["n_items"] == n and metrics["feature_label_auc"] > 0.6


def test_label_model_of_many_levels(spark):
    rng = np.random.default_rng(4)
    n = 20_400
    flat = spark.createDataFrame(pd.DataFrame({
        "item_id": [f"i{j}" for j in range(n)], "State": [f"level {j % 20_000}" for j in range(n)],
        "Occupants": rng.integers(1, 6, n).astype(float)})).withColumn(
        "true_long", F.expr("cast(Occupants >= 3 as int)"))
    scored = validity.feature_label_scores(flat, n_splits=2)
    assert scored.count() == n
    assert validity.feature_label_metrics(scored).first()["feature_label_auc"] > 0.99


def test_label_model_that_does_not_settle_raises(spark):
    # without any categorical column
    flat = spark.createDataFrame([(f"i{j}", float(j % 7), j % 3 % 2) for j in range(60)],
                                 "item_id string, Occupants double, true_long int")
    with pytest.raises(ValueError):
        validity.feature_label_scores(flat, n_splits=2, max_steps=1)
