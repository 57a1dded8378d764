"""Exact deduplication with an extendible-hash index on shared files.

The index has one entry per distinct hash of a normalised text. A bucket is a range of hashes,
named by their first bits. The directory is a table on shared files that leads from the first
bits of a hash to its bucket; while a bucket has more entries than it may hold, it is split by one
more bit, which doubles the directory. Texts whose hash several rows share go to the task that owns their
bucket. It compares their bytes, chains different texts under one hash, and counts the rows of each;
which rows are copies, and which of them stays, is read from that index.
"""

from pyspark.sql import Window, functions as F

from itemscope.llm.common import numbered, prefix, texts, unused
from itemscope.session import written

#: Entries that a bucket may hold. An entry is some 100 bytes, so an owner task stays small.
BUCKET_ENTRIES = 16_384
#: Bits of a hash that one counting pass over the index tells apart.
PASS_BITS = 12
#: Rows of one text that may reach its owner, however many copies there are.
COMBINED = 32


def normalised(text):
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def directory(entries, capacity=BUCKET_ENTRIES):
    """(cell, bits, bucket) of an index with column `h`, and the bits of a cell.

    A cell is a directory slot, the first bits of a hash; bucket is its first `bits` bits.
    """
    deep = PASS_BITS
    while True:
        cells = written(entries.groupBy(prefix("h", deep).alias("cell"))
                        .agg(F.count("*").alias("n")), "directory-cells")
        if deep == 60 or cells.where(F.col("n") > capacity).isEmpty():
            break
        deep += PASS_BITS
    leaves = None
    for bits in range(deep + 1):
        cells = cells.withColumn("bucket", F.shiftright("cell", deep - bits))
        sized = written(cells.join(cells.groupBy("bucket").agg(F.sum("n").alias("held")),
                                   "bucket"), "directory-level")
        overfull = (F.col("held") > capacity) & F.lit(bits < deep)
        done = sized.where(~overfull).select("cell", F.lit(bits).alias("bits"), "bucket")
        leaves = done if leaves is None else leaves.unionByName(done)
        cells = sized.where(overfull).select("cell", "n")
        if cells.isEmpty():
            return leaves, deep


def dedup_index(docs, capacity=BUCKET_ENTRIES, row=None, hashed=F.xxhash64):
    """Rows of `docs` and the index of those texts whose hash several rows have.

    Rows: doc_id, row (tells rows apart, also those that repeat a doc_id), h, sha (binary SHA-256
    of the normalised text). `row` names a column of unique keys, if there is one. Index: bits,
    bucket, h, link (place in the chain of the hash), sha, group_size, keep_id, keep_row. `hashed`
    gives the 64-bit hash of a column.
    """
    if row is None:    # texts are read twice, so a row's key must not depend on the read
        row = unused(docs, "__row")
        docs = numbered(docs, row)
    base = texts(docs, F.col(row).alias("row")).withColumn("norm", normalised(F.col("text"))) \
        .withColumn("h", hashed("norm"))
    rows = written(base.select("doc_id", "row", "h",
                               F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")
    entries = written(rows.groupBy("h").agg(F.count("*").alias("n")), "dedup-entries")
    slots, deep = directory(entries, capacity)
    shared = entries.where("n > 1").withColumn("cell", prefix("h", deep)).join(slots, "cell")
    shared = written(shared.select("h", "bits", "bucket"), "dedup-shared")
    # The smallest doc_id, NULL last; of rows that repeat it, the first.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # A large group of copies leaves each task as one row, and the exchange as COMBINED at most.
    some = F.pmod(F.spark_partition_id(), F.lit(COMBINED)).alias("some")
    combined = base.join(shared, "h").select(
        "bits", "bucket", "h", "norm", first.alias("first"), some).groupBy(
        "bits", "bucket", "h", "norm", "some").agg(
        F.count("*").alias("copies"), F.min("first").alias("first"))
    owned = combined.repartition("bits", "bucket").groupBy("bits", "bucket", "h", "norm").agg(
        F.sum("copies").alias("group_size"), F.min("first").alias("first"))
    owned = owned.withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm")
    chain = Window.partitionBy("bits", "bucket", "h").orderBy("sha")
    index = owned.withColumn("link", F.row_number().over(chain)).select(
        "bits", "bucket", "h", "link", "sha", "group_size",
        F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    return rows, written(index, "dedup-index")


def exact_duplicates(docs, capacity=BUCKET_ENTRIES, row=None, hashed=F.xxhash64):
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after each run of ASCII white space became one space; NULL is
    the empty text. The row with the smallest doc_id of a group is kept (a NULL doc_id only in a
    group without others; of rows that repeat the doc_id, exactly one). An empty table gives no
    rows. Further columns are dropped, whatever their names. Whole texts are compared.
    """
    rows, index = dedup_index(docs, capacity, row, hashed)
    found = index.where("group_size > 1").select("h", "sha", "group_size", "keep_id", "keep_row")
    return rows.join(found, ["h", "sha"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        .alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "row")


def without_copies(docs, capacity=BUCKET_ENTRIES):
    """`docs` with one row of each group of equal texts, all its columns unchanged.

    Of rows that repeat the smallest doc_id of a group exactly one stays, and of those without one
    too. NULL is the empty text; an empty table stays empty; columns may have any names.
    """
    key = unused(docs, "__row")
    rows = numbered(docs, key)
    named = exact_duplicates(rows.select("doc_id", "text", key), capacity, row=key)
    # Written, so that its size is known: texts move only where it is too large to be broadcast.
    dropped = written(named.where("not kept").select(F.col("row").alias(key)), "dedup-dropped")
    return rows.join(dropped, key, "left_anti").drop(key)
