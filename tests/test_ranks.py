import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemscope.operators import ranks
from itemscope.operators.difficulty import with_quantile_bin
from itemscope.operators.performance import binary_metrics


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    n = 400
    # one value holds more than a third of the rows
    v = np.where(rng.random(n) < 0.4, 0.5, rng.integers(0, 50, n) / 50)
    return pd.DataFrame({"g": rng.integers(0, 2, n), "v": v, "y": rng.integers(0, 2, n)})


@pytest.mark.parametrize("parts", [1, 7])
def test_average_and_min_ranks(spark, scores, parts):
    df = spark.createDataFrame(scores).repartition(parts)
    got = ranks.average_ranks(ranks.value_counts(df, ["g"], "v"), ["g"], "v").toPandas()
    want = scores.assign(r=scores.groupby("g")["v"].rank()).drop_duplicates(["g", "v"])
    merged = got.merge(want, on=["g", "v"])
    assert len(merged) == len(got) == len(want)
    assert np.allclose(merged["rank"], merged["r"])
    ranked = ranks.with_min_ranks(df, {"v": "pos"}).toPandas()
    assert (ranked["v"].rank(ascending=False, method="min") == ranked["pos"]).all()


def test_min_rank_leaves_null_unranked(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "k string, v double")
    got = {r["k"]: r["p"] for r in ranks.with_min_ranks(df, {"v": "p"}).collect()}
    assert got == {"a": 2, "b": None, "c": 1}


def test_exact_quantiles(spark, scores):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = ranks.exact_quantiles(spark.createDataFrame(scores), ["g"], "v", probs).collect()
    for r in rows:
        assert np.allclose(r["edges"], np.quantile(scores[scores.g == r["g"]]["v"], probs))


def test_quantile_bins_merge_equal_edges(spark, scores):
    got = with_quantile_bin(spark.createDataFrame(scores), "v").toPandas()
    edges = np.unique(np.quantile(scores["v"], np.arange(11) / 10))
    want = np.maximum(np.searchsorted(edges, got["v"], side="left"), 1)
    assert (got["difficulty_decile"] == want).all()
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["difficulty_decile"] for r in with_quantile_bin(same, "v").collect()] == [1, 1]


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def test_binary_metrics(spark, scores):
    got = binary_metrics(spark.createDataFrame(scores), ["g"], "y", "v").toPandas()
    for _, r in got.iterrows():
        part = scores[scores.g == r["g"]]
        y, p = part["y"].to_numpy(), part["v"].to_numpy()
        q = np.clip(p, 1e-6, 1 - 1e-6)
        assert r["n"] == len(part)
        assert r["accuracy"] == pytest.approx(((p >= 0.5) == y).mean())
        assert r["brier"] == pytest.approx(((q - y) ** 2).mean())
        assert r["logloss"] == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
        assert r["auc"] == pytest.approx(_auc(y, p))


def test_auc_flips_with_labels_and_needs_two_classes(spark, scores):
    df = spark.createDataFrame(scores)
    a = binary_metrics(df, [], "y", "v").first()["auc"]
    b = binary_metrics(df.withColumn("y", 1 - F.col("y")), [], "y", "v").first()["auc"]
    assert a + b == pytest.approx(1.0)
    assert binary_metrics(df.filter("y = 1"), [], "y", "v").first()["auc"] is None


@pytest.mark.parametrize("first", [None, 25])
def test_hash_positions(spark, first):
    ids = [f"x{i}" for i in range(300)]
    df = spark.createDataFrame([(g, i) for g in (0, 1) for i in ids], "g int, id string")
    key = F.concat(F.col("g").cast("string"), F.lit(":"), F.col("id"))
    got = ranks.hash_positions(df.repartition(5), ["g"], key, first).collect()
    for g in (0, 1):
        want = sorted(ids, key=lambda i: hashlib.md5(f"{g}:{i}".encode()).hexdigest())[:first]
        have = sorted((r["position"], r["id"]) for r in got if r["g"] == g)
        assert have == list(enumerate(want))
