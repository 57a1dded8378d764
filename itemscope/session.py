"""Session settings and written intermediate tables."""

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession


def build_session(master=None, app="itemscope", **conf):
    """A session with the settings the jobs are written for; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped = set()


def ship_package(spark):
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="itemscope-"), "itemscope"), "zip",
            os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def shared_dir(spark):
    """The shared folder for written intermediates, as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="itemscope-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def local_table(spark, rows, columns):
    """Driver rows as a local relation. `columns` maps names to Arrow types.

    Unlike a DataFrame built from Python objects, its size is known to the planner, which then
    broadcasts it when it is small and shuffles when it is not.
    """
    rows = list(rows)
    return spark.createDataFrame(pa.table({
        name: pa.array([r[i] for r in rows], kind)
        for i, (name, kind) in enumerate(columns.items())}))


def written(df, name, *partitions):
    """Write `df` once, in folders by `partitions` if any are named, and read it back.

    This cuts lineage, survives the loss of executors, and gives the planner the true size of the
    table, so that joins with it are broadcast exactly when it is small enough.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/itemscope/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
