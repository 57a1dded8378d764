"""Shards of near-equal bytes by histogram sort.

Rows are ordered by the hash of their text and then by doc_id, so that equal texts lie together.
The splitters between shards are found by counting the exact bytes below candidate boundaries in
all partitions. Each round refines the candidates only in the cells where a splitter still has to
be found. When all splitters meet the tolerance, the rows are exchanged once.
"""

from pyspark.sql import Window, functions as F

from itemscope.llm.common import prefix, texts
from itemscope.session import written

#: A cell that holds a splitter is cut into two to this power in a counting round.
ROUND_BITS = 12
#: A splitter may be off by this share of a mean shard.
TOLERANCE = 0.01
#: Rows of a shard are numbered in parts: by the first bits of the hash, and by this many salts,
#: since copies share a hash.
PART_BITS, SALTS = 12, 16

_TOP = 1 << 63


def _find(rows, column, targets, tolerance):
    """Where `targets`, numbers of bytes, fall in the unsigned order of a 64-bit key.

    Returns {target: (key, below, held)}: rows with smaller keys have `below` bytes. `held` is 0
    if the key is a boundary within the tolerance; else the key itself has `held` bytes and spans
    the target. A round brings at most 2**ROUND_BITS sums per target to the driver, whatever the
    size of the table.
    """
    found, searched, width = {}, {t: (0, 0) for t in targets}, 64
    while searched:
        step = min(ROUND_BITS, width)
        inside = rows
        if width < 64:
            inside = rows.where(F.shiftrightunsigned(column, width).isin(
                sorted({cell for cell, _ in searched.values()})))
        width -= step
        cell = F.shiftrightunsigned(column, width) if width else F.col(column)
        sums = sorted((r["cell"] % (1 << 64), r["held"]) for r in inside.groupBy(
            cell.alias("cell")).agg(F.sum("size").alias("held")).collect())
        by_parent = {}
        for at, held in sums:
            by_parent.setdefault(at >> step, []).append((at, held))
        finer = {}
        for target, (parent, below) in searched.items():
            for at, held in by_parent[parent]:
                if below + held >= target:
                    break
                below += held
            if target - below <= tolerance:
                found[target] = (at << width, below, 0)
            elif below + held - target <= tolerance:
                found[target] = ((at + 1) << width, below + held, 0)
            elif width:
                finer[target] = (at, below)
            else:
                found[target] = (at, below, held)
        searched = finer
    return found


def splitters(rows, shards, tolerance=TOLERANCE):
    """Splitters as (h, tie) keys in unsigned order: rows at or above one belong to a later shard.

    `rows` has the keys `h` and `tie` and the column `size`. A run of equal texts is cut, by its
    ties, only if neither end of it is within the tolerance.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    off = tolerance * total / shards
    bounds = _find(rows, "h", [total * i / shards for i in range(1, shards)], off)
    cut = {}
    for target, (key, below, held) in bounds.items():
        if held:
            cut.setdefault(key, []).append((target, below))
    keys = {t: (key, 0) for t, (key, _, held) in bounds.items() if not held}
    for key, inside in cut.items():
        signed = key - 2 * _TOP if key >= _TOP else key
        within = {target - below: target for target, below in inside}
        run = rows.where(F.col("h") == signed)
        for rest, (tie, below, held) in _find(run, "tie", list(within), off).items():
            nearer = held and rest - below > below + held - rest
            keys[within[rest]] = (key, tie + 1 if nearer else tie)
    return [keys[t] for t in sorted(keys)]


def _not_below(key):
    h, tie = key
    if h >= 2 * _TOP:
        return F.lit(False)
    mine = F.col("h").bitwiseXOR(F.lit(-_TOP))
    later = mine > F.lit(h - _TOP)
    same = mine == F.lit(h - _TOP)
    if tie >= 2 * _TOP:
        return later
    return later | same & (F.col("tie").bitwiseXOR(F.lit(-_TOP)) >= F.lit(tie - _TOP))


def histogram_shards(docs, shards=24, tolerance=TOLERANCE):
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Size is the UTF-8 length of the text plus 8; the CRC-32 is unsigned; both take NULL as empty.
    Law `bytes`: shards are equal in bytes up to twice the tolerance and one row. grown_shard is
    NULL. Slots number the rows of a shard without gaps, in the order of hash cells. A NULL doc_id
    sorts as the smallest. Rows that repeat a doc_id and text are interchangeable and get slots of
    their own. An empty table gives no rows; further columns are dropped.
    """
    rows = written(texts(docs).select(
        "doc_id", F.xxhash64("text").alias("h"),
        F.coalesce("doc_id", F.lit(-_TOP)).bitwiseXOR(F.lit(-_TOP)).alias("tie"),
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32")), "shard-rows")
    shard = sum((_not_below(k).cast("int") for k in splitters(rows, shards, tolerance)), F.lit(0))
    placed = rows.withColumn("shard", shard).withColumn("cell", prefix("h", PART_BITS)) \
        .withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS)))
    part = ["shard", "cell", "salt"]
    before = Window.partitionBy("shard").orderBy("cell", "salt") \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*part).agg(F.count("*").alias("n")).select(
        *part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("h", "tie"))
    return placed.withColumn("place", place).join(starts, part).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs, path, shards=24, tolerance=TOLERANCE):
    """Write whole rows of `docs` below `path`, one folder shard=N for each shard."""
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(
        "tie", F.coalesce("doc_id", F.lit(-_TOP)).bitwiseXOR(F.lit(-_TOP)))
    rows = written(keyed.select("h", "tie", (F.octet_length(F.coalesce("text", F.lit(""))) + 8)
                                .cast("long").alias("size")), "shard-keys")
    keys = splitters(rows, shards, tolerance)
    shard = sum((_not_below(k).cast("int") for k in keys), F.lit(0))
    keyed.withColumn("shard", shard).withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(SALTS))) \
        .repartition("shard", "salt").drop("h", "tie", "salt") \
        .write.partitionBy("shard").parquet(path)
