import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
FILTERS = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def odd(spark):
    """Real documents, odd rows, and columns with every sort of name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = [(1000, None), (1001, ""), (1001, ""), (None, "of no id"), (None, "of no id"), (1002, " \n "),
            (1003, "w " * 60_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.length("text").cast("int").alias("n_chars"))
    every = docs.select(*more.columns).unionByName(more)
    return every.withColumns({"a.b": F.lit(1), "__row": F.lit("mine"), "row": F.col("doc_id"),
                              "st": F.struct(F.lit(2).alias("of it `s`")), "score": F.lit("s")})


@pytest.mark.parametrize("name, stage", FILTERS, ids=[n for n, _ in FILTERS])
def test_filters_keep_columns_whatever_their_names(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert {r["__row"] for r in got.collect()} == {"mine"} and got.where("`a.b` = 1").count() == got.count()
    given = [tuple(map(str, r)) for r in odd.collect()]
    kept = [tuple(map(str, r)) for r in got.collect()]
    assert 30 < len(kept) <= len(given) and set(kept) <= set(given)
    copies = sum(1 for r in got.collect() if r["text"] == "of no id")
    assert copies == (1 if "dedup" in name else 2)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_packing_stage_on_odd_rows(spark, odd):
    got = corpus_pipeline.pack(spark, odd, SF)
    assert got.agg(F.count_distinct("doc_id")).first()[0] == odd.agg(F.count_distinct("doc_id")).first()[0]
    least = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.min("n")).first()
    assert 0 < least[1] <= least[0] <= 1024
