import math

import pytest
from pyspark.sql import functions as F

from itemscope.operators import coldstart, performance, responses
from itemscope.schema import LONG, SHORT
from tests.conftest import to_rows


@pytest.fixture(scope="module")
def micro(spark):
    """Three subjects, four items; truth long, long, short, short."""
    items = spark.createDataFrame(
        [("i1", LONG), ("i2", LONG), ("i3", SHORT), ("i4", SHORT)],
        "item_id string, ground_truth_mapped string")
    said = {"a": [1, 1, 0, 1], "b": [1, 0, None, None], "c": [None] * 4}
    truth = [1, 1, 0, 0]
    rows = [(s, f"i{i + 1}", d, int(d == truth[i])) for s, row in said.items()
            for i, d in enumerate(row) if d is not None]
    cells = spark.createDataFrame(rows, "subject string, item_id string, decision int, y int")
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "subject string")
    return items, cells, subjects


def test_model_performance(micro):
    items, cells, subjects = micro
    obs = performance.observations(cells.drop("decision"), items, cells.drop("y"))
    rows = performance.model_performance(obs, 4, subjects).collect()
    a, b, c = rows
    assert [r["model"] for r in rows] == ["a", "b", "c"]
    assert (a["observed_total"], a["missing_total"], a["coverage"], a["accuracy"]) == (4, 0, 1.0, .75)
    assert (a["tp"], a["tn"], a["fp"], a["fn"]) == (2, 1, 1, 0)
    assert (a["long_recall"], a["short_specificity"], a["balanced_accuracy"]) == (1.0, 0.5, 0.75)
    assert (a["predicted_long_rate"], a["true_long_rate_observed"]) == (0.75, 0.5)
    # only one class seen: the balanced accuracy is the rate that is defined
    assert (b["long_recall"], b["short_specificity"], b["balanced_accuracy"]) == (0.5, None, 0.5)
    assert (c["observed_total"], c["missing_total"], c["accuracy"], c["accuracy_rank"]) == (
        0, 4, None, None)
    assert c["tp"] is None and c["balanced_accuracy"] is None
    assert (a["accuracy_rank"], b["accuracy_rank"]) == (1, 2)


def test_performance_without_decisions(micro):
    items, cells, _ = micro
    row = performance.model_performance(
        performance.observations(cells.drop("decision"), items), 4).first()
    assert row["accuracy"] == 0.75 and row["tp"] is None and row["predicted_long_rate"] is None


def test_paired_comparisons(spark):
    data = {"a": "1110", "b": "1001", "c": "1", "d": "1110"}
    rows = [(s, f"i{i}", int(v)) for s, t in data.items() for i, v in enumerate(t)]
    rows.append(("e", "i9", 1))
    cells = spark.createDataFrame(rows, "subject string, item_id string, y int")
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "nobody")]
    got = {r["model_b"]: r for r in performance.paired_comparisons(cells, pairs).collect()}
    assert set(got) == {"b", "c", "d"}  # pairs without a common item are left out
    b = got["b"]
    assert (b["n_overlap"], b["accuracy_a"], b["accuracy_b"]) == (4, 0.75, 0.5)
    assert (b["a_correct_b_wrong"], b["a_wrong_b_correct"], b["discordant"]) == (2, 1, 3)
    assert b["delta_b_minus_a"] == -0.25 and b["mcnemar_exact_p"] == pytest.approx(1.0)
    diffs = [0, -1, -1, 1]
    sd = math.sqrt(sum((d + 0.25) ** 2 for d in diffs) / 3)
    assert b["ci95_low"] == pytest.approx(-0.25 - 1.96 * sd / 2)
    assert b["ci95_high"] == pytest.approx(-0.25 + 1.96 * sd / 2)
    assert got["c"]["n_overlap"] == 1 and got["c"]["ci95_low"] is None
    assert (got["d"]["discordant"], got["d"]["mcnemar_exact_p"]) == (0, 1.0)


def test_default_pairs_need_their_subjects(spark):
    cells = spark.createDataFrame(
        [("baseline", "i", 1), ("ruleset", "i", 0)], "subject string, item_id string, y int")
    got = performance.paired_comparisons(cells).collect()
    assert [(r["model_a"], r["model_b"]) for r in got] == [("baseline", "ruleset")]


def test_vote_fraction_summary(spark):
    votes = {"i1": [0, 0], "i2": [1] * 3 + [0] * 7, "i3": [1, 1], "i4": [1, 1], "i5": [None]}
    rows = [(f"s{n}", i, v) for i, vs in votes.items() for n, v in enumerate(vs)]
    decisions = spark.createDataFrame(rows, "subject string, item_id string, decision int")
    items = spark.createDataFrame([(f"i{n}", LONG if n in (3, 5) else SHORT) for n in range(1, 6)],
                                  "item_id string, ground_truth_mapped string")
    got = to_rows(performance.vote_fraction_summary(decisions, items))
    assert [r[0] for r in got] == ["(-0.001, 0.1]", "(0.2, 0.3]", "(0.9, 1.0]"]
    assert got[2][1:] == (2, 1.0, 0.5, 2.0) and got[1][1:] == (1, 0.3, 0.0, 10.0)


def test_subject_summary_identities(spark):
    # two fitted rows of 9,819 items
    rows = [("ruleset", 0.345, 6898, 9721), ("phi4_baseline", 0.2997, 4216, 5920)]
    cells = [(m, f"i{n}", int(n < c)) for m, _, c, o in rows for n in range(o)]
    responses_df = spark.createDataFrame(cells, "subject string, item_id string, y int")
    ability = spark.createDataFrame([(m, a) for m, a, _, _ in rows], "subject string, ability double")
    got = performance.subject_summary(responses_df, ability, 9819).collect()
    assert [r["model"] for r in got] == ["ruleset", "phi4_baseline"]
    assert got[0]["accuracy"] == 6898 / 9721 and got[0]["coverage"] == 9721 / 9819
    assert [r["missing_total"] for r in got] == [98, 3899]
    assert [(r["ability_rank"], r["accuracy_rank"]) for r in got] == [(1, 2), (2, 1)]


def test_decisions_from_metadata(spark):
    md = spark.createDataFrame([("i1", LONG, "x", 5), ("i2", SHORT, None, 6)],
                               "item_id string, a_prediction string, `b.c_prediction` string, z int")
    got = to_rows(responses.decisions_from_metadata(md), "subject", "item_id")
    assert got == [("a", "i1", 1), ("a", "i2", 0)]
    only = spark.createDataFrame([("b.c",)], "subject string")
    assert responses.decisions_from_metadata(md, only).count() == 0
    with pytest.raises(ValueError):
        responses.decisions_from_metadata(md.select("item_id", "z"))


def test_alignment(spark):
    md = spark.createDataFrame([("i1", "b", 2), ("i1", "a", 1), ("i2", "c", 3), ("i9", "d", 4)],
                               "item_id string, v string, n int")
    cells = spark.createDataFrame([("s", "i1", 1), ("s", "i2", 0)],
                                  "subject string, item_id string, y int")
    assert to_rows(responses.align_metadata(md, cells, "n"), "item_id") == [
        ("i1", "a", 1), ("i2", "c", 3)]
    extra = cells.union(spark.createDataFrame([("s", "i7", 1)], cells.schema))
    with pytest.raises(ValueError, match="1 item ids.*i7"):
        responses.align_metadata(md, extra)


def test_unique_cells_and_wide_table(spark):
    cells = spark.createDataFrame([("s", "i", 1), ("s", "i", 0), ("t", "i", 1)],
                                  "subject string, item_id string, y int")
    assert to_rows(responses.unique_cells(cells), "subject") == [("s", "i", 0), ("t", "i", 1)]
    wide = spark.createDataFrame([("s", 1.0, None), ("t", float("nan"), 0.0)],
                                 "who string, `i.1` double, i2 double")
    assert to_rows(responses.wide_to_long(wide), "subject") == [("s", "i.1", 1), ("t", "i2", 0)]


def test_answers_to_items_without_metadata(spark):
    cells = spark.createDataFrame([("a", "i1", 1), ("a", "i2", 0)], "subject string, item_id string, y int")
    items = spark.createDataFrame([("i1", LONG)], "item_id string, ground_truth_mapped string")
    votes = cells.withColumnRenamed("y", "decision")
    flat = items.withColumn("State", F.lit("TX"))
    for lost in (lambda: performance.observations(cells, items),
                 lambda: performance.vote_fraction_summary(votes, items),
                 lambda: coldstart.run_cold_start(cells, flat, (1,), (0,), 1)):
        with pytest.raises(ValueError, match="1 item ids.*i2"):
            lost()


def test_repeated_items_do_not_double_cells(spark):
    cells = spark.createDataFrame([("a", "i1", 1), ("a", "i2", 0)], "subject string, item_id string, y int")
    items = spark.createDataFrame([("i1", "x"), ("i1", "x"), ("i2", "y")],
                                  "item_id string, ground_truth_mapped string")
    assert performance.with_truth(cells, items).count() == 2
