"""Helpers shared by the corpus operators."""

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from itemscope.session import written

#: UTF-8 bytes of text handled at once inside a task, so that its memory does not follow the
#: length of the texts in an Arrow batch. A single longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the Arrow batches that tasks hand to Python and back.
BATCH_BYTES = 16 << 20


def bounded_batches(df):
    """`df`, after its session was told to keep Arrow batches small: both sides hold them twice."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def texts(docs, *more):
    """`doc_id`, `text` (NULL as empty) and the columns named, all others pruned."""
    return bounded_batches(docs).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def slices(batches, column="text", limit=SLICE_BYTES):
    """Cut record batches into runs of rows of about `limit` bytes of `column`."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)


def arrow(**columns):
    """A record batch of named arrays or (values, Arrow type) pairs."""
    return pa.RecordBatch.from_arrays(
        [pa.array(*v) if isinstance(v, tuple) else v for v in columns.values()],
        names=list(columns))


def prefix(key, bits):
    """The first `bits` (at most 63) of a 64-bit hash as a non-negative number."""
    return F.shiftrightunsigned(key, 64 - bits)


def _placed(docs):
    """Whether every row of `docs` is one row of a file, and reading again gives the same rows.

    So it is for projections and filters of files under one path; a join, a sample or a path that
    is given twice may repeat a row.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().location().rootPaths().size() == 1


def unused(docs, name):
    """`name`, with as many underscores before it as set it apart from the columns of `docs`."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def whole_row(docs):
    """All columns of `docs` in a struct `row`, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def numbered(docs, name="__row"):
    """`docs` with a unique key `name` that stays the same when the rows are read again.

    Rows straight from files have their place as the key: the hash of the file's path and the row's
    index in the file, which do not depend on how a read is cut into tasks. Others are numbered and
    written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        path, index = place["file_path"], place["row_index"]
        files = docs.select(path.alias("path"), index.alias("index")).select("path").distinct()
    except AnalysisException:
        files = None
    if files is None or not _placed(docs) or not files.groupBy(F.xxhash64("path")).count() \
            .where("count > 1").isEmpty():
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return docs.withColumn(name, F.struct(F.xxhash64(path).alias("file"), index.alias("index")))


def byte_characters():
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def release():
    """Give memory that is no longer used back to the system.

    Idle Python workers live on beside the executor's heap; what their allocators hold back counts
    against the executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):    # another C library
        pass
