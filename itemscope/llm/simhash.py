"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. If two fingerprints differ in at most two bits,
either the upper segments differ in at most one bit, or both differing bits are in the upper
segment and the lower ones are equal. The upper segment is therefore indexed by its one-wildcard
variants (one bit cleared) and as it is, the lower segment as it is. Fingerprints that share an
index key are candidates, and are verified on all bits. Keys are joined by equality only.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from itemscope.llm.common import arrow, numbered, slices, texts, unused
from itemscope.llm.components import components
from itemscope.session import written

HALF = 32
#: Fingerprints under one index key up to which they are compared with each other. Larger keys
#: are split by wildcard variants of the other segment, which leaves four under a key at most.
COMPARED = 64
_LOW = (1 << HALF) - 1


def _fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [digest(b" ".join(words), 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *ends[:-3].tolist()]
        line = b" ".join(words)
        hashes = [digest(line[i:j], 42) for i, j in zip(begins, (ends[2:] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i:i + 65_536], np.uint64)
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(hashes))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs):
    """doc_id and the fingerprint `fp` (64 bits in a signed long) of every text."""
    def run(batches):
        for part in slices(batches):
            fps = np.array([_fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield arrow(doc_id=part.column("doc_id"), fp=(fps.view(np.int64), pa.int64()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def _keys(fps):
    """Index keys of fingerprints: kind, key, side.

    Kinds 0 to 31 are the upper segment with that bit cleared; side is the bit, and only
    fingerprints of different sides are candidates. Kinds 32 and 33 are the whole upper and lower
    segment.
    """
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(_LOW)
    variants = [F.struct(F.lit(i).alias("kind"), upper.bitwiseAND(F.lit(_LOW ^ (1 << i))).alias("key"),
                         F.shiftrightunsigned("fp", HALF + i).bitwiseAND(1).alias("side"))
                for i in range(HALF)]
    whole = [F.struct(F.lit(kind).alias("kind"), segment.alias("key"), F.lit(0).cast("long").alias("side"))
             for kind, segment in ((HALF, upper), (HALF + 1, lower))]
    return fps.select("fp", F.explode(F.array(*variants, *whole)).alias("at")).select("fp", "at.*")


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def _split(large):
    """Keys with many fingerprints, made finer by wildcards in the other segment.

    One bit may differ there if one differs in the indexed segment, else two. The variants keep
    every pair within the distance together, and hold at most four fingerprints.
    """
    masks = {}
    for kind, bits, shift in ((0, 1, 0), (HALF, 2, 0), (HALF + 1, 2, HALF)):
        if bits == 1:
            cleared = [1 << i for i in range(HALF)]
        else:
            cleared = [1 << i | 1 << j for i in range(HALF) for j in range(i)]
        # The complement of m << shift as a signed long.
        masks[kind] = F.array([F.lit(~(m - (1 << HALF) if shift and m >> (HALF - 1) else m) << shift
                                     | ((1 << shift) - 1)) for m in cleared])
    kind = F.least("kind", F.lit(HALF + 1))
    wild = F.when(kind < HALF, masks[0]).when(kind == HALF, masks[HALF]).otherwise(masks[HALF + 1])
    one_wild = F.when(F.col("kind") < HALF, F.expr(f"~shiftleft(1L, kind + {HALF})")) \
        .otherwise(F.lit(-1))
    return large.select("fp", F.explode(wild).alias("mask"), one_wild.alias("own")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).bitwiseAND(F.col("own")).alias("key"),
        F.col("own"))


def links(fps):
    """Pairs (a, b) that connect all distinct fingerprints `fp` at most two bits apart.

    Every pair at distance two or less is connected by them, directly or by others.
    """
    keyed = _keys(fps)
    sizes = written(keyed.groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
        F.min("side").alias("s"), F.max("side").alias("t"))
        .where((F.col("n") > 1) & ((F.col("kind") >= HALF) | (F.col("s") < F.col("t")))), "variants")
    pairs = sizes.where("n = 2").select("a", "b")
    more = sizes.where("n > 2").select("kind", "key", "n")
    members = written(keyed.join(more, ["kind", "key"]), "members")
    few = members.where(F.col("n") <= COMPARED)
    left = few.select("kind", "key", F.col("fp").alias("a"), F.col("side").alias("s"))
    right = few.select("kind", "key", F.col("fp").alias("b"), F.col("side").alias("t"))
    met = left.join(right, ["kind", "key"]).where(
        F.when(F.col("kind") < HALF, F.col("s") < F.col("t")).otherwise(F.col("a") < F.col("b")))
    split = _split(members.where(F.col("n") > COMPARED)).groupBy("mask", "own", "key").agg(
        F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1) \
        .select("a", F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(met.select("a", "b")).unionByName(split).where(_near("a", "b"))


def near_duplicates(docs):
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Texts link at two or fewer differing bits of the fingerprint of their three-word shingles;
    component_id is the smallest doc_id that links lead to. NULL, empty and blank texts have
    fingerprint zero and link like any other. Rows that repeat a doc_id get a result each; a NULL
    doc_id is never a component_id unless the whole component has none. An empty table gives no
    rows; further columns are dropped. Whole texts are read; nothing is capped.
    """
    rows = written(fingerprints(docs), "fingerprints")
    # Copies collapse to one fingerprint before any link is looked for.
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = components(links(distinct.select("fp")))
    joined = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    names = joined.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs):
    """One row of `docs` of each component, the one with the smallest doc_id; columns unchanged.

    Of rows that repeat the smallest doc_id exactly one stays. Texts without words, NULL too, are
    one component with whatever links to fingerprint zero; an empty table stays empty; columns may
    have any names.
    """
    key = unused(docs, "__row")
    rows = numbered(docs, key)
    marked = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    ids = rows.select(F.col(key).alias("row"), "doc_id").join(
        marked.select(F.col("doc_id").alias("row"), "component_id"), "row")
    ids = written(ids, "near-rows")
    first = ids.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"),
        F.count("*").alias("n")).where("n > 1")
    # Written, so that its size is known: texts move only where it is too large to be broadcast.
    dropped = written(ids.join(first, "component_id").where("row != first.row")
                      .select(F.col("row").alias(key)), "near-dropped")
    return rows.join(dropped, key, "left_anti").drop(key)
