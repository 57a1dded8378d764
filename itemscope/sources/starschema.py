"""Response tables derived from a star-schema data set (lineitem, supplier, part).

A subject is a supplier nation, an item a part, and the answer is the earliest order line of that
cell; cells without an order line are missing.
"""

from pyspark.sql import functions as F

from itemscope.operators.metadata import add_severity_scores
from itemscope.schema import LONG, SHORT


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_id(key):
    return F.concat(F.lit("item_"), F.lpad(F.col(key).cast("string"), 8, "0"))


def _true_long():
    return (F.col("p_size") + (F.col("p_partkey") * 7919) % 40) > 45


def _cells(spark, sf_dir):
    """(s_nationkey, l_partkey, decision); the earliest line is a partial aggregate, no window."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    first = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "l_partkey", "s_nationkey").agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("line"))
    q = F.col("line.l_quantity")
    return first.select("s_nationkey", "l_partkey",
                        F.when(q > 30, 1).when(q >= 3, 0).cast("int").alias("decision"))


def _subject():
    return F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))


def decisions(spark, sf_dir):
    return _cells(spark, sf_dir).select(
        _subject().alias("subject"), item_id("l_partkey").alias("item_id"), "decision")


def items(spark, sf_dir):
    """Flat item metadata, with blanks and unknowns on purpose."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, words, rest: _choose(key % n, words, rest)
    return table(spark, sf_dir, "part").select(
        item_id("p_partkey").alias("item_id"),
        F.when(_true_long(), LONG).otherwise(SHORT).alias("ground_truth_mapped"),
        F.col("p_brand").alias("State"), F.col("p_type").alias("Tenure"),
        F.when(key % 17 != 0, size).alias("Occupants"),
        pick(4, ["No Damage", "Some Damage", "Moderate Damage"], "A lot of Damage")
        .alias("BuildingDamage"),
        pick(5, ["No shortage", "Some shortage", "A lot of shortage", "Never"], "No")
        .alias("WaterAccess"),
        _choose(size % 3, ["", "Always"], "Some").alias("PowerAccess"))


def _choose(number, words, rest):
    out = F.when(number == 0, words[0])
    for i, w in enumerate(words[1:], start=1):
        out = out.when(number == i, w)
    return out.otherwise(rest)


def observations(spark, sf_dir):
    """Rows (subject, item_id, y, decision, true_long) of the known cells."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", _true_long().cast("int").alias("true_long"))
    cells = _cells(spark, sf_dir).filter(F.col("decision").isNotNull())
    return cells.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        _subject().alias("subject"), item_id("l_partkey").alias("item_id"),
        (F.col("decision") == F.col("true_long")).cast("int").alias("y"), "decision", "true_long")


def responses(spark, sf_dir):
    return observations(spark, sf_dir).select("subject", "item_id", "y")


def flat_items(spark, sf_dir):
    """Flat metadata with label and severity scores."""
    return add_severity_scores(items(spark, sf_dir).withColumn(
        "true_long", (F.col("ground_truth_mapped") == LONG).cast("int")))


def case_metadata(spark, sf_dir):
    """Item metadata whose household record is a text cell, written in five ways by part key:
    JSON, Python literal with None, JSON in the fallback column, single quotes there, nothing."""
    key = F.col("p_partkey")
    kind = key % 5
    damage = _choose(key % 4, ["No Damage", "Some Damage", "Moderate Damage"], "A lot of Damage")
    json = F.to_json(F.struct(
        F.struct(F.col("p_brand").alias("State"), F.col("p_type").alias("Tenure"),
                 F.when(key % 17 != 0, F.col("p_size")).alias("Occupants"))
        .alias("SocioEconomicParameters"),
        damage.alias("BuildingDamage"), F.lit("Never").alias("WaterAccess"),
        F.lit("Less than a week").alias("DisplacementDuration")))
    literal = lambda msa: F.concat(
        F.lit("{'SocioEconomicParameters': {'State': '"), "p_brand", F.lit("', 'Tenure': '"),
        "p_type", F.lit(msa), F.col("p_size").cast("string"), F.lit("}, 'BuildingDamage': '"),
        damage, F.lit("', 'WaterAccess': 'A lot'}"))
    return table(spark, sf_dir, "part").select(
        item_id("p_partkey").alias("item_id"),
        F.when(_true_long(), LONG).otherwise(SHORT).alias("ground_truth_mapped"),
        F.when(kind == 0, json).when(kind == 1, literal("', 'MSA': None, 'Occupants': "))
        .when(kind == 3, "not a dict").otherwise("").alias("feature_key"),
        F.when(kind == 2, json).when(kind == 3, literal("', 'Occupants': "))
        .alias("household_attributes"))


def wide_metadata(spark, sf_dir):
    """Item rows with one `<subject>_prediction` text column per nation."""
    cells = _cells(spark, sf_dir)
    label = F.when(F.col("decision") == 1, LONG).when(F.col("decision") == 0, SHORT).otherwise("?")
    keys = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey")
            .distinct().orderBy("n_nationkey").collect()]
    return cells.groupBy(item_id("l_partkey").alias("item_id")).agg(*[
        F.max(F.when(F.col("s_nationkey") == n, label)).alias(f"n{n:02d}_prediction")
        for n in keys])


def households(spark, sf_dir):
    """Household records from orders and customers, with unknown fields and odd disaster counts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    key = F.col("o_orderkey")
    unless = lambda n, c: F.when(key % n != 0, c)
    disasters = F.when(key % 7 == 0, F.array().cast("array<string>")).when(
        key % 7 == 1, F.array(F.lit("Flood"), F.lit("Fire"))).when(
        key % 7 != 2, F.array(_choose(key % 3, ["Hurricane", "Flood"], "Tornado")))
    socio = F.struct(
        F.col("c_mktsegment").alias("State"),
        F.concat(F.lit("MSA-"), F.col("c_nationkey").cast("string")).alias("MSA"),
        F.lit("Owned").alias("Tenure"),
        F.when(F.col("c_acctbal") >= 0, "positive").alias("Income"),
        (key % 6).cast("double").alias("Occupants"), F.lit(0.0).alias("Kids5years"),
        F.lit(0.0).alias("Kids5-11years"), F.lit(1.0).alias("Kids12-17years"),
        F.lit("Employed").alias("EmploymentStatus"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("household_id"), socio.alias("SocioEconomicParameters"),
        unless(11, F.lit("Some Damage")).alias("BuildingDamage"), disasters.alias("DisasterType"),
        unless(13, _choose(key % 2, ["Less than a week"], "More than a month"))
        .alias("DisplacementDuration"),
        F.lit("Never").alias("WaterAccess"), F.lit("Some").alias("PowerAccess"),
        F.lit("No shortage").alias("FoodAccess"), F.col("o_orderpriority").alias(
            "UnsanitaryConditions"), F.lit(None).cast("string").alias("InformGPTMethod"))
