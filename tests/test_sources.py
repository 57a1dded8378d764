import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from itemscope.operators import households, responses
from itemscope.plans.analysis import analysis_tables, run_analysis
from itemscope.schema import ITEM_PARAMS, LONG, SHORT, household
from itemscope.sources import runs, tables
from tests.conftest import to_rows


def test_response_matrix_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('model,i1,"i2",i3\nm1,1.0,,0\n"m2",nan,0.0,1\n')
    got = to_rows(tables.read_response_matrix(spark, str(tmp_path / "a.csv")), "subject", "item_id")
    assert got == [("m1", "i1", 1), ("m1", "i3", 0), ("m2", "i2", 0), ("m2", "i3", 1)]
    assert to_rows(tables.response_matrix_items(spark, str(tmp_path / "a.csv")), "item_id") == [
        ("i1",), ("i2",), ("i3",)]
    # older exports: the subject stands in an unnamed first column
    (tmp_path / "b.csv").write_text(",i1,i2\nm1,1,0\n")
    got = to_rows(tables.read_response_matrix(spark, str(tmp_path / "b.csv")), "item_id")
    assert got == [("m1", "i1", 1), ("m1", "i2", 0)]


def test_candidate_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="x.csv.*x\\(3\\).csv"):
        tables.first_existing(spark, str(tmp_path), ["x.csv", "x(3).csv"])
    assert tables.first_existing(spark, str(tmp_path), ["x.csv"], required=False) is None
    (tmp_path / "x(3).csv").write_text("item_id,difficulty,note\ni1,0.5,z\ni2,,\n")
    path = tables.first_existing(spark, str(tmp_path), ["x.csv", "x(3).csv"])
    assert path.endswith("x(3).csv")
    got = tables.read_csv(spark, path, ITEM_PARAMS)
    assert dict(got.dtypes)["difficulty"] == "double"
    assert to_rows(got, "item_id") == [("i1", 0.5, "z"), ("i2", None, None)]


def test_save_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    tables.save_tables({"t": df, "skipped": 3}, str(tmp_path))
    assert to_rows(tables.read_csv(spark, str(tmp_path / "t"))) == [("a", "1.5")]
    assert not (tmp_path / "skipped").exists()


def test_agent_decisions(spark, tmp_path):
    for folder, name, decisions in [
            ("one", "results_first_combined.json", [LONG, SHORT]),
            ("one", "aaa_combined.json", [SHORT]),
            ("two", "x_combined.json", [SHORT]), ("three", "other.json", [LONG]),
            ("four", "results_empty_combined.json", [])]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"AgentDecisions": decisions}, indent=1))
    got = to_rows(runs.agent_decisions(spark, str(tmp_path)), "model", "row_number")
    assert got == [("first", 0, LONG), ("first", 1, SHORT), ("two", 0, SHORT)]
    assert to_rows(runs.agent_decisions(spark, str(tmp_path), ["two"])) == [("two", 0, SHORT)]
    assert runs.agent_decisions(spark, str(tmp_path), ["none"]).count() == 0


def test_run_rows(spark, tmp_path):
    run = {"AgentDecisions": [LONG], "DisplacementDurationsMappedToDecisions": [SHORT],
           "DisplacementDurations": ["Less than a week"],
           "HouseholdInfo": [{"BuildingDamage": "No Damage"}], "Errors": []}
    (tmp_path / "r.json").write_text(json.dumps(run, indent=2))
    row = runs.run_rows(spark, str(tmp_path / "r.json")).first()
    assert (row["decision"], row["truth"], row["duration"]) == (LONG, SHORT, "Less than a week")
    assert row["household"]["BuildingDamage"] == "No Damage"


def _decide(record):
    if record["id"] == 3:
        raise KeyError("lost")
    return LONG if record["id"] % 2 else SHORT


def test_decisions_errors_and_accuracy(spark, tmp_path):
    df = spark.range(6).withColumn("truth", F.lit(LONG))
    decided = households.decide_households(df, _decide).persist()
    good, bad = households.split_errors(decided)
    assert good.count() == 5
    e = bad.first()
    assert (e["id"], e["error_type"], e["error_message"]) == (3, "KeyError", "'lost'")
    row = households.run_accuracy(decided).first()
    assert (row["n_selected"], row["n_decided"], row["n_errors"]) == (6, 5, 1)
    assert row["accuracy"] == pytest.approx(2 / 5)
    runs.write_run(decided, spark.createDataFrame([(42,)], "Seed int"), str(tmp_path / "run one"), "id")
    back = runs.run_decisions(spark, str(tmp_path), "decision string, row_number int, id long")
    assert to_rows(back, "row_number") == [
        ("run one", LONG if i % 2 else SHORT, n, i) for n, i in enumerate((0, 1, 2, 4, 5))]
    assert spark.read.json(str(tmp_path / "run one" / "decisions")).count() == 5
    with pytest.raises(Exception, match="lost"):
        households.decide_households(df, _decide, stop_on_error=True).collect()
    empty = households.run_accuracy(decided.filter("id < 0")).first()
    assert empty["accuracy"] is None and empty["average_runtime_s"] is None


def test_chunks_resume(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = spark.range(10)
    runs.decide_in_chunks(df.filter("id < 6"), "id", _decide, path, 4)
    out = runs.decide_in_chunks(df, "id", _decide, path, 4)
    assert sorted(r["id"] for r in out.collect()) == list(range(10))


def test_lost_run_goes_on_after_its_last_chunk(spark, tmp_path):
    path, marker = str(tmp_path / "chunks"), tmp_path / "calls"
    marker.mkdir()

    def counted(record, lost):
        if record["id"] in lost:
            raise KeyError("lost")
        with open(marker / str(record["id"]), "a") as f:
            f.write("x")
        return LONG
    df = spark.range(40).withColumn("n", F.when(F.col("id") % 2 == 0, F.col("id")))
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    with pytest.raises(Exception, match="lost"):
        runs.decide_in_chunks(df, "id", lambda r: counted(r, {order[25]}), path, 10, stop_on_error=True)
    assert spark.read.parquet(path).count() == 20    # two chunks were committed
    out = runs.decide_in_chunks(df, "id", lambda r: counted(r, ()), path, 10)
    assert sorted(r["id"] for r in out.collect()) == list(range(40))
    assert dict(out.dtypes)["n"] == "bigint" and out.where("n is null").count() == 20
    assert all((marker / str(i)).read_text() == "x" for i in order[:20])
    assert runs.decide_in_chunks(df.limit(0), "id", _decide, str(tmp_path / "none")).count() == 0


def test_select_households(spark):
    df = spark.range(50)
    pick = lambda *a, **k: [r["id"] for r in households.select_households(
        df.repartition(4), "id", *a, **k).orderBy("position").collect()]
    whole = pick()
    assert sorted(whole) == list(range(50)) and pick(20) == whole[:20]
    assert pick(20, start=5) == whole[5:20] and pick(20, start=15, limit=10) == whole[15:20]
    assert pick("all", start=2, limit=3) == whole[2:5] and pick(seed=7) != whole
    for bad in (dict(sample_size=51), dict(start=-1), dict(limit=-1)):
        with pytest.raises(ValueError):
            households.select_households(df, "id", **bad)


def test_complete_households(spark):
    soc = ["TX", "M", "Owned", "low", 2.0, 0.0, 0.0, 1.0, "Employed"]
    rest = ["Never", "Some", "No", "No", None]
    rows = [(soc, "No Damage", ["Fire"], "Less than a week", *rest),
            (soc, "No Damage", ["Fire", "Flood"], "x", *rest),
            (soc, "No Damage", [], "x", *rest), (soc, None, ["Fire"], "x", *rest),
            (soc, "No Damage", None, "x", *rest),
            (soc[:4] + [None] + soc[5:], "No Damage", ["Fire"], "x", *rest)]
    df = spark.createDataFrame([(tuple(r[0]), *r[1:]) for r in rows],
                               household(T.ArrayType(T.StringType())))
    got = households.complete_households(df).select(
        "DisasterType", households.duration_to_decision("DisplacementDuration").alias("d"),
        households.mock_decision("actual", "DisplacementDuration").alias("m"),
        households.mock_decision(LONG, "DisplacementDuration").alias("c")).collect()
    assert [tuple(r) for r in got] == [("Fire", SHORT, SHORT, LONG)]
    survey = spark.createDataFrame([(1,), (2,), (None,)], "ND_DISPLACE int")
    assert households.displaced(survey).count() == 1


def test_whole_analysis(spark, tmp_path):
    rng = np.random.default_rng(2)
    m, n = 10, 60
    y = rng.integers(0, 2, (m, n))
    items = [f"i{j:02d}" for j in range(n)]
    names = [f"m{k}" for k in range(m)]
    truth = rng.integers(0, 2, n)
    lines = ["model," + ",".join(items)]
    lines += [f"{s}," + ",".join("" if (k + j) % 9 == 0 else str(y[k, j]) for j in range(n))
              for k, s in enumerate(names)]
    (tmp_path / "response_matrix.csv").write_text("\n".join(lines) + "\n")
    meta = ["item_id,ground_truth_mapped,feature_key," + ",".join(f"{s}_prediction" for s in names)]
    for j in range(n):
        cell = repr({"SocioEconomicParameters": {"State": f"S{j % 3}", "Occupants": j % 5},
                     "BuildingDamage": "Some Damage" if j % 2 else "No Damage"})
        said = [LONG if (y[k, j] == truth[j]) else SHORT for k in range(m)]
        meta.append(f'{items[j]},{LONG if truth[j] else SHORT},"{cell}",' + ",".join(said))
    (tmp_path / "case_metadata.csv").write_text("\n".join(meta) + "\n")
    (tmp_path / "irt_1pl_item_parameters(3).csv").write_text("\n".join(
        ["item_id,difficulty,empirical_accuracy,empirical_difficulty"]
        + [f"{i},{j / 10 - 3},{0.5},{j / 20}" for j, i in enumerate(items)]) + "\n")
    (tmp_path / "irt_1pl_subject_ability.csv").write_text("\n".join(
        ["irt_model,model,ability,correct"]
        + [f"1pl,{s},{k / 10 - 0.45},3" for k, s in enumerate(names)]) + "\n")
    out = tmp_path / "out"
    found = run_analysis(spark, str(tmp_path), str(out), fmt="parquet", seeds=(1,), ks=(0, 1),
                         test_size=10, min_observed=5, pairs=[("m0", "m1")])
    assert len(found) == 21
    sizes = {name: spark.read.parquet(str(out / name)).count() for name in found}
    assert sizes["model_performance"] == m and sizes["flattened_case_metadata"] == n
    assert sizes["residual_factor_item_loadings"] == n and sizes["residual_factor_variance"] == 5
    assert sizes["kfactor_decision_coldstart_by_split"] == 6
    assert sizes["difficulty_decile_summary"] == 10 and sizes["paired_comparisons"] == 1


def test_analysis_of_items_without_answers_or_metadata(spark):
    rng = np.random.default_rng(3)
    m, n = 10, 60
    y, truth = rng.integers(0, 2, (m, n)), rng.integers(0, 2, n)
    items, names = [f"i{j:02d}" for j in range(n)], [f"m{k}" for k in range(m)]
    label = lambda long: LONG if long else SHORT
    key = lambda j: repr({"SocioEconomicParameters": {"State": f"S{j % 3}", "Occupants": j % 5},
                          "BuildingDamage": "Some Damage" if j % 2 else "No Damage"})
    meta = spark.createDataFrame(
        [(items[j], label(truth[j]), key(j), *[label(y[k, j] == truth[j]) for k in range(m)])
         for j in range(n)], ["item_id", "ground_truth_mapped", "feature_key",
                              *[f"{s}_prediction" for s in names]])
    core = {
        "responses": spark.createDataFrame(    # the last item has no answers
            [(names[k], items[j], int(y[k, j])) for k in range(m) for j in range(n - 1)],
            "subject string, item_id string, y int"),
        "case_metadata": meta,
        "item_params": spark.createDataFrame(
            [(i, j / 10 - 3, 0.5, j / 20) for j, i in enumerate(items)],
            "item_id string, difficulty double, empirical_accuracy double, empirical_difficulty double"),
        "subject_ability": spark.createDataFrame(
            [("1pl", s, k / 10 - 0.45, 3) for k, s in enumerate(names)],
            "irt_model string, model string, ability double, correct long")}
    options = dict(seeds=(1,), ks=(0, 1), test_size=10, min_observed=5, pairs=[("m0", "m1")])
    found = analysis_tables(core, **options)
    assert found["flattened_case_metadata"].count() == n
    assert sum(r.n_cases for r in found["vote_fraction_summary"].collect()) == n
    scored = found["item_table_with_validity_features"].where("feature_label_surprisal is not null")
    assert scored.count() == n
    assert found["model_performance"].first()["missing_total"] == 0
    with pytest.raises(ValueError, match="1 item ids.*i07"):
        analysis_tables(core | {"case_metadata": meta.where("item_id != 'i07'")}, **options)


def test_text_with_quotes_survives_csv(spark, tmp_path):
    rows = [("i1", 'say "hi", x', 1.5), ("i2", "plain", None)]
    df = spark.createDataFrame(rows, "item_id string, note string, v double")
    tables.save_tables({"t": df}, str(tmp_path))
    back = tables.read_csv(spark, f"{tmp_path}/t", df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_response_matrix_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '\ufeffmodel,"i,1","say ""x""",i3\r\n"m, 1",1,"0",\r\nmodel,"i,1","say ""x""",i3\r\n'.replace(
            '\r\nmodel,"i,1","say ""x""",i3', '\r\nmodel,NA, 1.0 ,0') + "\r\nm2,,,1\r\nshort,1\r\n")
    got = to_rows(tables.read_response_matrix(spark, str(tmp_path / "a.csv")), "subject", "item_id")
    assert got == [("m, 1", "i,1", 1), ("m, 1", 'say "x"', 0), ("m2", "i3", 1), ("model", "i3", 0),
                   ("model", 'say "x"', 1), ("short", "i,1", 1)]
    # a line that equals the header is a line of answers, and names are no answers
    for name, text, told in (("b", "model,i1\nm,0\nmodel,i1\n", "model to i1 is neither 0 nor 1: i1"),
                             ("c", "model,i1\nm,0.7\n", "m to i1 is neither 0 nor 1: 0.7"),
                             ("d", "model,i1\nm,0,1\n", "more cells than the header: m")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception, match=told):
            tables.read_response_matrix(spark, str(tmp_path / f"{name}.csv")).collect()
    wide = spark.createDataFrame([("s", 0.7)], "model string, i1 double")
    with pytest.raises(Exception, match="s to i1 is neither 0 nor 1: 0.7"):
        responses.wide_to_long(wide).collect()


def test_core_tables_in_parquet(spark, tmp_path):
    tables_of = {"response_matrix": spark.createDataFrame([("m", 1.0, None)], "model string, i1 double, `i.2` double"),
                 "case_metadata": spark.createDataFrame([("i1", "x")], "item_id string, ground_truth_mapped string"),
                 "irt_1pl_item_parameters": spark.createDataFrame([("i1", "0.5")], "item_id string, difficulty string")}
    for name, df in tables_of.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "irt_1pl_subject_ability.csv").write_text("model,ability\nm,1.5\n")
    core = tables.load_core_tables(spark, str(tmp_path))
    assert to_rows(core["responses"]) == [("m", "i1", 1)]
    assert to_rows(core["matrix_items"], "item_id") == [("i.2",), ("i1",)]
    assert to_rows(core["item_params"]) == [("i1", 0.5)]
    assert core["subject_ability"].first()["ability"] == 1.5


def test_factor_tables_of_several_sizes(spark, tmp_path):
    for k in (2, 3):
        names = ",".join(f"factor_{i + 1}" for i in range(k))
        (tmp_path / f"f{k}.csv").write_text(
            f"k_factors,model,bias,{names},correct,accuracy\n{k},m,0.5," + ",".join("123"[:k]) + ",7,0.25\n")
    got = tables.read_factors(spark, [f"{tmp_path}/f2.csv", f"{tmp_path}/f3.csv"])
    assert got.columns == ["k_factors", "model", "bias", "factor_1", "factor_2", "factor_3", "correct", "accuracy"]
    assert to_rows(got, "k_factors") == [(2, "m", 0.5, 1.0, 2.0, None, 7, 0.25), (3, "m", 0.5, 1.0, 2.0, 3.0, 7, 0.25)]
