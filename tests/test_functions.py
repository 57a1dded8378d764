import math

import pytest
from pyspark.sql import functions as F

from itemscope.functions import pvalues, scalar
from itemscope.functions.nested import nested_dict, text_or_blank, with_parsed_dict


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(0.0, 1), (0.3, 0), (1.0, 1), (None, 0)], "p double, y int")
    r = df.select(scalar.safe_logit("p").alias("l"), scalar.tenth_label(
        scalar.tenth_bin("p")).alias("b"), scalar.log_loss("y", "p").alias("s"),
        scalar.ambiguity("p").alias("a")).collect()
    assert r[0]["l"] == pytest.approx(math.log(1e-4 / (1 - 1e-4)))
    assert [x["b"] for x in r] == ["(-0.001, 0.1]", "(0.2, 0.3]", "(0.9, 1.0]", None]
    assert r[0]["s"] == pytest.approx(-math.log(1e-6))
    assert r[1]["s"] == pytest.approx(-math.log(0.7))
    assert r[1]["a"] == pytest.approx(0.6)
    assert r[3]["l"] is None and r[3]["s"] is None


def test_logistic_loss_is_stable(spark):
    df = spark.createDataFrame([(1, 800.0), (0, 800.0), (1, -1.5)], "y int, eta double")
    got = [r[0] for r in df.select(scalar.logistic_loss("y", "eta")).collect()]
    assert got == pytest.approx([0.0, 800.0, math.log(1 + math.exp(1.5))])


def test_first_match_order(spark):
    from itemscope.operators.metadata import SHORTAGE_RULES
    words = ["No shortage", "NEVER", "some lot", "A lot", "lots", "Always", "No", "", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(scalar.first_match("w", SHORTAGE_RULES)).collect()]
    assert got == [0.0, 0.0, 1.0, 2.0, 2.0, 0.0, None, None, None]


def test_to_number_and_labels(spark):
    df = spark.createDataFrame([("3",), ("x",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(scalar.to_number("t")).collect()] == [3.0, None, None, None]
    df = spark.createDataFrame([("L",), ("S",), ("?",), (None,)], "t string")
    got = [r[0] for r in df.select(scalar.label_to_decision("t", "L", "S")).collect()]
    assert got == [1, 0, None, None]


def test_parsed_dict_forms(spark):
    cells = ['{"a": 1, "in": {"b": null}}', "{'a': 'it', 'in': {'b': \"it's\"}}",
             "{'a': None, 'b': True}", "[1, 2]", "junk", "  ", None, "{'a': (1, 2)}"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    out = with_parsed_dict(df, "c", "d").orderBy("i")
    rows = out.select("d", text_or_blank(F.col("d"), "a").alias("a"),
                      nested_dict(F.col("d"), "in").alias("n")).collect()
    assert [r["a"] for r in rows] == ["1", "it", None, "", "", "", "", "[1,2]"]
    assert rows[0]["n"] == {"b": None} and rows[1]["n"] == {"b": "it's"}
    assert rows[2]["d"] == {"a": None, "b": "true"} and rows[2]["n"] == {}
    assert all(rows[i]["d"] == {} for i in (3, 4, 5, 6))


@pytest.mark.parametrize("k,n", [(0, 1), (0, 5), (2, 5), (3, 6), (40, 100), (1400, 3000)])
def test_fair_coin_p_against_exact_integers(k, n):
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
    assert pvalues.fair_coin_p(k, n) == pytest.approx(exact, rel=1e-9)


def test_fair_coin_p_without_throws():
    assert pvalues.fair_coin_p(0, 0) == 1.0


def test_correlation_p():
    # t distribution with 1 and 2 degrees of freedom has closed forms
    r = 0.6
    t = r / math.sqrt(1 - r * r)
    assert pvalues.correlation_p(r, 3) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
    t = r * math.sqrt(2 / (1 - r * r))
    assert pvalues.correlation_p(r, 4) == pytest.approx(1 - t / math.sqrt(2 + t * t))
    assert pvalues.correlation_p(0.5, 2) is None
    assert pvalues.correlation_p(1.0, 10) == 0.0
