"""Benchmark decontamination by winnowing.

Of each sliding window of six 5-gram hashes the smallest is kept as a fingerprint, on both sides.
A shared span of ten words holds a whole window, so it always shares a fingerprint. Documents and
items that share one are compared word by word, and hits are extended to the spans they cover.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from itemscope.llm.common import arrow, bounded_batches, slices, texts, whole_row
from itemscope.session import written

WINDOW, GRAM = 10, 5
_KEEP = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32
              for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text):
    """Words of a text: runs of digits, letters (A-Z in lower case) and non-ASCII characters."""
    return text.encode().translate(_KEEP).split()


def _grams(hashes, length):
    """Hashes of all runs of `length` words that lie end to end in `hashes`."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = (out ^ hashes[j:j + n]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def _hashes(lists):
    flat = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    return known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def _fingerprints(hashes, short):
    """Distinct fingerprints of a text: winnowed 5-grams, and all runs of the lengths `short`."""
    parts = [_grams(hashes, n) for n in short]
    if len(hashes) >= WINDOW:
        grams = _grams(hashes, GRAM)
        span = WINDOW - GRAM + 1
        n = len(grams) - span + 1
        least = grams[:n].copy()
        for j in range(1, span):
            np.minimum(least, grams[j:j + n], out=least)
        parts.append(least[np.flatnonzero(np.diff(least, prepend=~least[:1]))])
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _fingerprint_table(table, key, short):
    """(key, fp) of distinct fingerprints; `short` None takes the whole run of short texts."""
    def run(batches):
        for part in slices(batches):
            lists = [words(t) for t in part.column("text").to_pylist()]
            flat, keys, found = _hashes(lists), [], []
            begin = 0
            for ws in lists:
                mine = flat[begin:begin + len(ws)]
                begin += len(ws)
                own = short if short is not None else [len(ws)] if 0 < len(ws) < WINDOW else []
                found.append(_fingerprints(mine, own))
            sizes = [len(f) for f in found]
            fps = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield arrow(key=part.column(key), fps=pa.ListArray.from_arrays(offsets, pa.array(fps)))
    kind = dict(table.dtypes)[key]
    return table.select(key, "text").mapInArrow(run, f"key {kind}, fps array<long>") \
        .select("key", F.explode("fps").alias("fp"))


def _hits(own, items):
    """(number of words hit, ids of items that occur) for the words of a text."""
    hit, ids = np.zeros(len(own) + 1, np.int64), set()
    flat = _hashes([own])
    grams = {}
    for item in items:
        theirs = words(item["text"])
        length = min(WINDOW, len(theirs))
        if not length or length > len(own):
            continue
        if length not in grams:
            grams[length] = _grams(flat, length)
        windows = {}
        for q, g in enumerate(_grams(_hashes([theirs]), length).tolist()):
            windows.setdefault(g, []).append(theirs[q:q + length])
        for p in np.flatnonzero(np.isin(grams[length], np.array(list(windows), np.uint64))).tolist():
            if own[p:p + length] in windows[int(grams[length][p])]:
                hit[p] += 1
                hit[p + length] -= 1
                ids.add(item["item_id"])
    return int((np.cumsum(hit)[:-1] > 0).sum()), ids


def _judged(docs, benchmark):
    """The columns of `docs` in a struct `row`, and the hits of benchmark items in each text."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"),
                             F.xxhash64(F.coalesce("text", F.lit(""))).alias("item"))
    # Equal texts have one key, so copies meet the items once.
    docs = bounded_batches(docs).select(whole_row(docs), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("text"))
    theirs = written(_fingerprint_table(items, "item", None)
                     .withColumnRenamed("key", "item"), "item-fingerprints")
    mine = _fingerprint_table(docs, "key", _short_lengths(items))
    pairs = mine.join(theirs, "fp").select("key", "item").distinct()
    candidates = written(pairs.join(items, "item").groupBy("key").agg(
        F.collect_set(F.struct("item_id", "text")).alias("items")), "candidates")

    def run(batches):
        for part in slices(batches):
            rows = []
            for text, found in zip(part.column("text").to_pylist(),
                                   part.column("items").to_pylist()):
                own = words(text)
                n_hit, ids = _hits(own, found) if found else (0, set())
                names = sorted(str(i) for i in ids if i is not None)
                rows.append((len(own), n_hit, len(names),
                             hashlib.sha256(",".join(names).encode()).hexdigest()))
            n_words, n_hit, n_items, digest = zip(*rows)
            yield arrow(row=part.column("row"), n_words=(n_words, pa.int64()),
                        n_hit=(n_hit, pa.int64()), n_items=(n_items, pa.int64()),
                        items_sha256=(digest, pa.string()))

    shape = T.StructType([docs.schema["row"], *(T.StructField(n, T.LongType()) for n in (
        "n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType())])
    return docs.join(candidates, "key", "left").select("row", "text", "items").mapInArrow(
        run, shape) \
        .withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs, benchmark):
    """Hits of benchmark items in every text.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated. A window is ten
    consecutive words of an item, or a whole item of fewer words. NULL and empty texts have no
    words. Items without words never occur. Rows that repeat an item_id are one item with the
    windows of all of them; a NULL item_id marks words but is not listed. Rows that repeat a
    doc_id have results of their own. An empty table on either side gives no hits or no rows.
    Further columns are dropped. Whole texts are read.
    """
    judged = _judged(docs.select("doc_id", "text"), benchmark)
    return judged.select("row.doc_id", *judged.columns[1:])


def without_contaminated(docs, benchmark):
    """`docs` without the rows in which a benchmark window occurs, all columns unchanged.

    NULL and empty texts stay, as they have no words; rows that repeat are judged each; an empty
    table on either side loses nothing. Columns may have any names.
    """
    return _judged(docs, benchmark).where("not contaminated").select("row.*")


def _short_lengths(items):
    """Lengths of items below a window: at most nine numbers."""
    def run(batches):
        for part in slices(batches):
            found = {len(words(t)) for t in part.column("text").to_pylist()}
            yield arrow(n=(sorted(n for n in found if 0 < n < WINDOW), pa.int32()))
    return sorted(r["n"] for r in items.select("text").mapInArrow(run, "n int").distinct().collect())
