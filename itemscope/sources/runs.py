"""Result files of decision runs: reading combined files, writing runs in resumable chunks."""

from pyspark.sql import functions as F

from itemscope.operators.households import decide_households, run_accuracy, split_errors
from itemscope.operators.ranks import hash_positions, running_sums
from itemscope.schema import RUN_RESULT
from itemscope.session import written


def subject_from_path(path):
    """`results_<name>_combined.json` names the subject, else the folder does."""
    stem = F.regexp_extract(path, r"results_(.*)_combined\.[^./]*$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.coalesce(F.nullif(stem, F.lit("")), folder)


def combined_files(spark, folder, subjects=None):
    """One combined file per sub-folder: `results_*_combined.json` before other names."""
    files = spark.read.format("binaryFile").option(
        "pathGlobFilter", "*_combined.json").load(f"{folder.rstrip('/')}/*/").select("path")
    files = files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    if subjects is not None:
        files = files.filter(F.col("folder").isin(list(subjects)))
    named = F.col("path").rlike(r"/results_[^/]*_combined\.json$")
    return files.groupBy("folder").agg(F.min_by(
        "path", F.struct((~named).alias("other"), "path")).alias("path"))


def agent_decisions(spark, folder, subjects=None):
    """Rows (model, row_number, AgentDecision) of every sub-folder's combined run file."""
    chosen = [r["path"] for r in combined_files(spark, folder, subjects).collect()]
    if not chosen:
        return spark.createDataFrame([], "model string, row_number int, AgentDecision string")
    runs = spark.read.schema(RUN_RESULT).json(chosen, multiLine=True)
    return runs.select(subject_from_path(F.col("_metadata.file_path")).alias("model"),
                       F.posexplode("AgentDecisions").alias("row_number", "AgentDecision"))


def run_rows(spark, paths):
    """One row per decision of run files, with its truth, duration and household."""
    runs = spark.read.schema(RUN_RESULT).json(paths, multiLine=True)
    arrays = F.arrays_zip("AgentDecisions", "DisplacementDurationsMappedToDecisions",
                          "DisplacementDurations", "HouseholdInfo")
    return runs.select(F.col("_metadata.file_path").alias("path"),
                       F.posexplode(arrays).alias("row_number", "r")).select(
        "path", "row_number", F.col("r.AgentDecisions").alias("decision"),
        F.col("r.DisplacementDurationsMappedToDecisions").alias("truth"),
        F.col("r.DisplacementDurations").alias("duration"),
        F.col("r.HouseholdInfo").alias("household"))


def decide_in_chunks(households, key, decide, path, chunk_size=10000, stop_on_error=False):
    """Decide all households not yet in `path`, one written chunk after the other.

    What is left to decide is laid out by chunk once; every chunk then reads its own part and is
    committed as a whole, so the table is read once however many chunks there are, and a lost run
    goes on after its last chunk. Returns the table of all decided households.
    """
    spark = households.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        households = households.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    numbered = hash_positions(households, [], F.col(key).cast("string")).withColumn(
        "chunk", F.floor(F.col("position") / chunk_size).cast("long")).drop("position")
    staged = written(numbered.repartition("chunk"), "run-chunks", "chunk")
    sizes = staged.select("chunk").distinct().orderBy("chunk")
    for (chunk,) in sizes.collect():    # a row for each of the caller's chunks
        decide_households(staged.where(F.col("chunk") == chunk), decide, stop_on_error).write.mode(
            "append").parquet(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        decide_households(staged, decide).write.parquet(path)
    return spark.read.parquet(path)


def numbered_by(df, key):
    """`df` with `row_number`, from 0 in the order of its unique `key`."""
    places = running_sums(df.select(key).withColumn("one", F.lit(1)), [], key, ["one"])
    return df.join(places.select(key, F.col("one_before").cast("int").alias("row_number")), key)


def write_run(decided, metadata, path, key):
    """Write a run as JSON lines under `decisions`, `errors` and `metadata`.

    Decisions carry `row_number`, their place by `key` among the decisions, as the positions of an
    array would. The writers' commit makes each of the three appear as a whole or not at all.
    """
    decisions, errors = split_errors(decided)
    for name, df in (("decisions", numbered_by(decisions, key)), ("errors", errors), ("metadata", metadata)):
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def run_decisions(spark, folder, schema="decision string, row_number int"):
    """Rows (model, then `schema`) of the runs that `write_run` put into sub-folders of `folder`."""
    rows = spark.read.schema(schema).json(f"{folder.rstrip('/')}/*/decisions")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/decisions/[^/]*$", 1)
    return rows.select(F.url_decode(name).alias("model"), *rows.columns)


def run_metadata(decided, settings, truth="truth"):
    """One row: the run's settings (a dict of plain values) and its totals."""
    return run_accuracy(decided, truth).select(
        *[F.lit(v).alias(k) for k, v in settings.items()], "*")
