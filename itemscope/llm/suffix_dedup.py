"""Removal of byte strings that repeat, by suffix arrays of shards that are merged over shards.

A shard is a run of texts that one task holds. Its suffix array is refined by Larsson and
Sadakane's doubling, Kasai's rule gives the common prefixes, and runs of `length` common bytes are
the strings that start several times in the shard.

Shards are merged without moving their texts. Every window of `length` bytes has an anchor: the
first `GRAM` bytes of least hash in it, which are the same bytes wherever the window occurs, and
every window belongs to one anchor. A shard names its anchors by hashes; only windows of anchors
that two shards share can be equal. The bytes of those windows are brought together and ordered by
what follows the anchor and by what precedes it. Common prefixes of neighbours in both orders give
each window the number of its class, and a binary search in the classes that occur twice tells
which windows repeat. Where too many rows meet at one anchor, the windows' places around it are
bisected, in which each half is keyed by the bytes that all its windows share. That needs no caps,
since at the end of it a key is a whole window, and rows of equal bytes always become one first.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from itemscope.llm.common import arrow, bounded_batches, numbered, release, slices
from itemscope.session import written

#: Bytes of text in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes at which longer texts are cut into pieces; window starts are dealt, so none is lost.
PIECE_BYTES = 1 << 20
#: Bytes of an anchor.
GRAM = 32
#: Bytes that may meet at one anchor before its windows are bisected.
GROUP_BYTES = 8 << 20
#: Pairs of suffixes that are compared one by one rather than all at once.
FEW = 48
#: Bits of a place in a shard.
PLACE_BITS = 22


def words(text):
    """The eight bytes from each place on as one number; zeros follow the text."""
    n, padded = len(text), text.tobytes() + bytes(15)
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r::8] = np.frombuffer(padded, ">u8", count=count, offset=r)
    return out


def suffix_array(text, word=None):
    """Places of the suffixes of a byte array in order, by Larsson and Sadakane's refinement.

    Suffixes are grouped by eight bytes. A group's rank is its last slot; groups of one are done,
    and every round sorts the members of the others by the rank of the suffix `depth` bytes later,
    which doubles the bytes that groups agree in.
    """
    n = len(text)
    key = words(text) if word is None else word
    order = np.argsort(key)
    key = key[order]
    order = order.astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    rank, depth = np.empty(n, np.int32), 8
    members = order
    while True:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        rank[members] = np.repeat(slots[first + size - 1], size)
        again = np.repeat(size > 1, size)
        slots, members = slots[again], members[again]
        if not len(slots):
            return order
        after = members.astype(np.int64) + depth
        inside = after < n
        # Past the end, the shorter suffix comes first.
        low = np.where(inside, rank[np.minimum(after, n - 1)], n - 1 - after) + depth
        key = (rank[members].astype(np.int64) << 32) | low
        by = np.argsort(key)
        key, members = key[by], members[by]
        order[slots] = members
        depth *= 2


def _agree(a, b, step=4096):
    """Bytes in which two byte arrays begin alike."""
    n = min(len(a), len(b))
    for at in range(0, n, step):
        differ = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
    return n


def common_prefixes(text, order, word=None, exact=0):
    """Bytes that each suffix shares with the one before it in `order` (0 for the first).

    Numbers below `exact` need not be right, only below it.

    By Kasai's rule the suffix one byte later shares one byte less, if the bytes before the two
    agree. So strings are compared only where they do not, all of these at once, eight bytes a step.
    """
    n = len(text)
    word = words(text) if word is None else word
    before = np.empty(n, np.int32)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    fresh = (at == 0) | (before <= 0)
    fresh[1:] |= text[:-1] != text[before[1:] - 1]
    shared = np.zeros(n, np.int32)
    p = at[fresh & (before >= 0)]
    q, done = before[p], 0
    while len(p) > FEW:
        differ = word[np.minimum(p + done, n - 1)] ^ word[np.minimum(q + done, n - 1)]
        room = n - done - np.maximum(p, q)
        going = (differ == 0) & (room > 8)
        ends = ~going
        if done + 8 < exact:
            shared[p[ends]] = done
        else:
            last, equal = differ[ends], np.zeros(np.count_nonzero(ends), np.int32)
            for k in range(1, 8):
                equal += last < np.uint64(1 << 64 - 8 * k)
            equal += last == 0
            shared[p[ends]] = done + np.minimum(equal, np.maximum(room[ends], 0))
        p, q, done = p[going], q[going], done + 8
    for a, b in zip(p.tolist(), q.tolist()):
        shared[a] = done + _agree(text[a + done:], text[b + done:])
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    return (shared[source] - (at - source))[order]


def repeated_starts(text, valid, length):
    """Whether the `length` bytes from each place on start at another place as well.

    Only `valid` places count.
    """
    out = np.zeros(len(text), bool)
    if np.count_nonzero(valid) < 2:
        return out
    word = words(text)
    order = suffix_array(text, word)
    same = common_prefixes(text, order, word, exact=length) >= length
    held = same.copy()
    held[:-1] |= same[1:]
    run, same = order[held], same[held]
    keep = valid[run]
    run, group = run[keep], np.cumsum(~same)[keep]
    if len(run):
        several = np.bincount(group) > 1
        out[run] = several[group]
    return out


def _sliding_minimum(values, width):
    """The least of each `width` values on from a place; of fewer at the end."""
    n = len(values)
    rows = np.full((n // width + 2) * width, np.iinfo(values.dtype).max, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def gram_hashes(text):
    """A hash of the GRAM bytes from each place on."""
    word = np.concatenate((words(text), np.zeros(GRAM, np.uint64)))
    n = len(text)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out = (out ^ word[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ (out >> np.uint64(32))


def anchors(text, valid, length):
    """(place, first and last start of its windows, hash) of each anchor of windows at `valid` starts."""
    hashes = gram_hashes(text)
    spare = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (hashes & ~spare) | np.arange(len(text), dtype=np.uint64)
    starts = np.flatnonzero(valid)
    at = (_sliding_minimum(keyed, length - GRAM + 1)[starts] & spare).astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    last = np.append(first[1:], len(at))[:len(first)] - 1
    return at[first], starts[first], starts[last], hashes[at[first]]


def runs(starts, length):
    """[a, z) of the bytes that strings of `length` at sorted `starts` cover."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    begin = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    end = np.concatenate((begin[1:], [True]))
    return np.stack((starts[begin], starts[end] + length), 1).astype(np.int64)


def _layout(parts):
    """The bytes of all `parts` in one array, and where each begins (and the last ends)."""
    return (np.frombuffer(b"".join(parts), np.uint8),
            np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


def _whole_windows(bounds, length):
    """Places from which `length` bytes lie within one part."""
    valid = np.zeros(bounds[-1], bool)
    for a, z in zip(bounds[:-1], bounds[1:]):
        valid[a:max(a, z - length + 1)] = True
    return valid


PIECES = ("piece long, row {}, begin long, shard long, spans array<struct<a:int,z:int>>, anchors array<"
          "struct<gram:long,ctx:binary,pos:int,left:int,right:int,asks:boolean>>")
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
_ANCHORS = pa.list_(pa.struct([("gram", pa.int64()), ("ctx", pa.binary()), ("pos", pa.int32()),
                               ("left", pa.int32()), ("right", pa.int32()), ("asks", pa.bool_())]))


def _shard(parts, length):
    """Of each part: covered runs, and the anchors that the shard sends out.

    An anchor's windows reach from `left` bytes before it to `right` bytes on. Anchors whose windows
    hold equal bytes are sent once a shard. `asks` says that some window is not known to repeat, so
    that other shards have to be asked.
    """
    text, bounds = _layout(parts)
    valid = _whole_windows(bounds, length)
    repeated = repeated_starts(text, valid, length)
    at, first, last, hashes = anchors(text, valid, length)
    owner = np.searchsorted(bounds, at, "right") - 1
    open_before = np.concatenate(([0], np.cumsum(valid & ~repeated)))
    asks = open_before[last + 1] > open_before[first]
    raw, sent = text.tobytes(), [[] for _ in parts]
    seen = set()
    for p, o, lo, hi, ask, gram in zip(
            at.tolist(), owner.tolist(), (at - first).tolist(), (last + length - at).tolist(),
            asks.tolist(), hashes.astype(np.int64).tolist()):
        ctx = xxhash.xxh3_128_digest(raw[p - lo:p + hi], seed=lo)
        if ctx not in seen:
            seen.add(ctx)
            sent[o].append({"gram": gram, "ctx": ctx, "pos": p - int(bounds[o]), "left": lo,
                            "right": hi, "asks": ask})
    starts = np.flatnonzero(repeated)
    cut = np.searchsorted(starts, bounds)
    spans = [[{"a": a, "z": z} for a, z in runs(starts[cut[i]:cut[i + 1]] - bounds[i], length).tolist()]
             for i in range(len(parts))]
    return spans, sent


def _sharder(length, shard_bytes):
    def work(batches):
        task, number, shards = TaskContext.get().partitionId(), 0, 0
        parts, keys, begins, held = [], [], [], 0

        def flush():
            nonlocal number, shards, parts, keys, begins, held
            spans, sent = _shard(parts, length)
            n = len(parts)
            batch = arrow(
                piece=pa.array([(task << 22) + number + i for i in range(n)], pa.int64()),
                row=pa.concat_arrays(keys), begin=pa.array(begins, pa.int64()),
                shard=pa.array([(task << 32) + shards] * n, pa.int64()),
                spans=pa.array(spans, _SPANS), anchors=pa.array(sent, _ANCHORS))
            number, shards = number + n, shards + 1
            parts, keys, begins, held = [], [], [], 0
            return batch

        for batch in slices(batches):
            for i, value in enumerate(batch.column("text")):
                whole = value.as_buffer() if value.is_valid else b""
                for begin in range(0, len(whole) - length + 1, PIECE_BYTES):
                    part = bytes(whole[begin:begin + PIECE_BYTES + length - 1])
                    if held and held + len(part) > shard_bytes:
                        yield flush()
                    parts.append(part)
                    keys.append(batch.column("row").slice(i, 1))
                    begins.append(begin)
                    held += len(part)
        if parts:
            yield flush()
        release()
    return work


def _packed(batches):
    """Texts as zstd frames, which travel at half the size."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        texts = pa.array([pack(t.as_buffer() if t.is_valid else b"") for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)


def _cut(batches):
    """The bytes of each asked anchor's windows, out of its text."""
    for batch in slices(batches):
        out = {name: [] for name in ("key", "piece", "pos", "left", "asks", "bytes")}
        for text, begin, piece, asked in zip(batch.column("text"), batch.column("begin").to_pylist(),
                                             batch.column("piece").to_pylist(),
                                             batch.column("asked").to_pylist()):
            whole = zstandard.decompress(text.as_buffer())
            for r in asked:
                at = begin + r["pos"]
                for name in ("key", "pos", "left", "asks"):
                    out[name].append(r[name])
                out["piece"].append(piece)
                out["bytes"].append(whole[at - r["left"]:at + r["right"]])
        yield arrow(key=(out["key"], pa.int64()), piece=(out["piece"], pa.int64()),
                    pos=(out["pos"], pa.int32()), left=(out["left"], pa.int32()),
                    asks=(out["asks"], pa.bool_()), bytes=(out["bytes"], pa.binary()))


def _classes(keys, sides, depths):
    """[depth, row]: rows of one key whose `sides` agree in so many first bytes have one number."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i], sides[i]))
    sizes = np.array([len(s) for s in sides])
    width = max(1, int(sizes.max()))
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in sides), np.uint8).reshape(-1, width)[order]
    equal = table[1:] == table[:-1]
    shared = np.where(equal.all(1), width, equal.argmin(1))
    sizes, key = sizes[order], np.array(keys)[order]
    shared = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))
    shared[key[1:] != key[:-1]] = -1
    out = np.empty((len(depths), len(keys)), np.int64)
    out[:, order] = np.cumsum(np.concatenate(([-1], shared))[None, :] < depths[:, None], axis=1)
    return out


def shared_windows(keys, lefts, rows, length):
    """For each row, the windows, by their start in it, whose bytes another row of its key has.

    A row has the bytes around an anchor, `lefts` of them before it. All windows in it hold the
    anchor, and those of another row can only be equal at the same distance before the anchor.
    """
    lefts = np.array(lefts)
    sizes = np.array([len(r) for r in rows])
    before = np.arange(int(lefts.max()) + 1)
    ahead = _classes(keys, [r[n:] for r, n in zip(rows, lefts)], length - before)
    behind = _classes(keys, [r[:n][::-1] for r, n in zip(rows, lefts)], before)
    count = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    away = lefts[row] - start
    n = len(rows) + 1
    code = (away * n + ahead[away, row]) * n + behind[away, row]
    ranked = np.sort(code)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    place = np.searchsorted(twice, code)
    found = np.zeros(len(code), bool)
    inside = place < len(twice)
    found[inside] = twice[place[inside]] == code[inside]
    return row[found], start[found]


def _merger(length, full):
    """Covered runs of rows that meet at their anchors; batches are sorted by key."""
    def work(batches):
        names = ("key", "piece", "pos", "left", "asks", "bytes")
        held, last, kept = 0, None, {name: [] for name in names}

        def flush():
            row, start = shared_windows(kept["key"], kept["left"], kept["bytes"], length)
            cut = np.searchsorted(row, np.arange(len(kept["key"]) + 1))
            found = [(kept["piece"][i], a, z) for i in range(len(kept["key"])) if kept["asks"][i]
                     for a, z in runs(start[cut[i]:cut[i + 1]] + kept["pos"][i] - kept["left"][i],
                                      length).tolist()]
            for values in kept.values():
                values.clear()
            return arrow(piece=pa.array([p for p, _, _ in found], pa.int64()),
                         a=pa.array([a for _, a, _ in found], pa.int32()),
                         z=pa.array([z for _, _, z in found], pa.int32()))

        for batch in slices(batches, "bytes"):
            for values in zip(*(batch.column(name).to_pylist() for name in names)):
                if held >= full and values[0] != last:
                    yield flush()
                    held = 0
                for name, value in zip(names, values):
                    kept[name].append(value)
                held, last = held + len(values[-1]), values[0]
        if held:
            yield flush()
        release()
    return work


def _bisected(rows, low, high, length, spans):
    """Rows of a large key, dealt to two keys by where a window starts before the anchor.

    `rows` have windows that start `low` to `high` bytes before the anchor. A half is keyed by the
    bytes that all its windows share, and its rows keep the bytes that its windows cover. Rows with
    equal such bytes answer each other: they go to `spans`, and one of them stays.
    """
    right = F.length("bytes") - F.col("left")
    halves, middle = [], (low + high) // 2
    for a, z in ((low, middle), (middle + 1, high)):
        lead = F.least(F.col("left"), F.lit(z))
        tail = F.least(right, F.lit(length - a))
        core = F.col("bytes").substr(F.col("left") - a + 1, F.lit(length - z + a))
        halves.append(rows.where((F.col("left") >= a) & (right >= length - z) & (lead + tail >= length))
                      .select(F.xxhash64("key", F.lit(a), core).alias("key"), "piece", "pos",
                              lead.alias("left"), "asks",
                              F.col("bytes").substr(F.col("left") - lead + 1, lead + tail).alias("bytes"),
                              F.lit(a).alias("low"), F.lit(z).alias("high")))
    dealt = written(halves[0].unionByName(halves[1]), "suffix-halves")
    one = written(dealt.groupBy("low", "high", "key", "left", "bytes").agg(
        F.count("*").alias("n"), F.min(F.struct("piece", "pos")).alias("of"),
        F.max("asks").alias("asks")), "suffix-distinct")
    equal = one.where("n > 1 and asks").select("low", "high", "key", "left", "bytes")
    spans.append(dealt.where("asks").join(equal, ["low", "high", "key", "left", "bytes"], "left_semi").select(
        "piece", (F.col("pos") - F.col("left")).alias("a"),
        (F.col("pos") - F.col("left") + F.length("bytes")).alias("z")))
    return one.select("key", "of.piece", "of.pos", "left", (F.col("asks") & (F.col("n") == 1)).alias("asks"),
                      "bytes", "low", "high")


def _across(pieces, docs, length, shard_bytes, group_bytes):
    """(piece, a, z) of bytes that other shards hold as well, by merging at shared anchors."""
    sent = pieces.select("piece", "shard", F.inline("anchors"))
    shared = written(sent.groupBy("gram").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
                     .where("lo < hi").select("gram"), "suffix-shared")
    sent = written(sent.join(shared, "gram", "left_semi"), "suffix-sent")
    classes = written(sent.groupBy("gram", "ctx").agg(
        F.count("*").alias("n"), F.min(F.struct("piece", "pos", "left", "right")).alias("of"),
        F.max("asks").alias("asks")), "suffix-classes")
    equal = sent.where("asks").join(classes.where("n > 1 and asks").select("gram", "ctx"),
                                    ["gram", "ctx"], "left_semi")
    spans = [equal.select("piece", (F.col("pos") - F.col("left")).alias("a"),
                          (F.col("pos") + F.col("right")).alias("z"))]
    asked = classes.groupBy("gram").agg(
        F.count("*").alias("n"), F.max(F.expr("n = 1 and asks")).alias("open"),
        F.sum(F.col("of.left") + F.col("of.right")).alias("held")) \
        .where("n > 1 and open").select("gram", (F.col("held") > group_bytes).alias("large"))
    wanted = written(classes.join(asked, "gram").select(
        "large", "of.piece", F.struct(F.col("gram").alias("key"), "of.pos", "of.left", "of.right",
                                      (F.col("asks") & (F.col("n") == 1)).alias("asks")).alias("r")),
        "suffix-wanted")

    def cut(wanted):
        placed = wanted.groupBy("piece").agg(F.collect_list("r").alias("asked")) \
            .join(pieces.select("piece", "row", "begin"), "piece")
        packed = docs.select("row", "text").mapInArrow(_packed, f"row {_kind(docs, 'row')}, text binary")
        return placed.join(packed, "row").select("text", "begin", "piece", "asked").mapInArrow(
            _cut, "key long, piece long, pos int, left int, asks boolean, bytes binary")

    ready = [cut(wanted.where("not large"))]
    if not wanted.where("large").isEmpty():
        rows = written(cut(wanted.where("large")), "suffix-rows").withColumns(
            {"low": F.lit(0), "high": F.lit(length - GRAM)})
        ranges = [(0, length - GRAM)]
        while ranges:    # at most 2 * length of them
            halves = [_bisected(rows.where((F.col("low") == a) & (F.col("high") == z)), a, z, length, spans)
                      for a, z in ranges]
            rows = written(reduce(DataFrame.unionByName, halves), "suffix-rows")
            sizes = rows.groupBy("low", "high", "key").agg(
                F.count("*").alias("n"), F.sum(F.length("bytes")).alias("held"), F.max("asks").alias("asks")) \
                .where("n > 1 and asks")
            rows = written(rows.join(sizes.select(
                "low", "high", "key", (F.col("held") > group_bytes).alias("large")), ["low", "high", "key"]),
                "suffix-rows")
            ready.append(rows.where("not large").select("key", "piece", "pos", "left", "asks", "bytes"))
            rows = rows.where("large").drop("large")
            ranges = [tuple(r) for r in rows.select("low", "high").distinct().collect()]
    merged = reduce(DataFrame.unionByName, ready).repartition("key").sortWithinPartitions("key")
    spans.append(merged.mapInArrow(_merger(length, shard_bytes), "piece long, a int, z int"))
    return reduce(DataFrame.unionByName, spans)


def _keep(batches):
    """Merge the spans of each text and cut them out."""
    for batch in slices(batches):
        found, size, kept = [], [], []
        for text, covers in zip(batch.column("text"), batch.column("covers").to_pylist()):
            whole = zstandard.decompress(text.as_buffer())
            merged, at, rest = [], 0, []
            for a, z in sorted((c["begin"] + s["a"], c["begin"] + s["z"])
                               for c in covers or () for s in c["spans"]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            for a, z in merged:
                rest.append(whole[at:a])
                at = z
            rest.append(whole[at:])
            found.append([{"start": a, "end": z} for a, z in merged])
            size.append(len(whole))
            kept.append(b"".join(rest))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield arrow(doc_id=batch.column("doc_id"), n_bytes=(size, pa.int64()), spans=(found, spans),
                    kept=(kept, pa.binary()))


def _kind(df, name):
    return df.schema[name].dataType.simpleString()


def without_repeats(docs, length=400, shard_bytes=SHARD_BYTES, group_bytes=GROUP_BYTES):
    """doc_id, n_bytes, spans (start, end of the maximal removed runs of bytes) and kept (binary).

    Of each whole text of `docs`, as UTF-8, every byte is removed that a string of `length` bytes
    covers which also starts elsewhere, in another row or in the same one, overlaps included;
    strings are judged on the input. NULL is the empty text. Rows that repeat a doc_id are rows of
    their own, so both lose what they share. Texts shorter than `length` lose nothing, an empty
    table gives no rows, and further columns are dropped, whatever their names. Surroundings of an
    anchor are told apart by 128 bits of hash.
    """
    if length < 2 * GRAM or shard_bytes > 1 << PLACE_BITS - 1 or PIECE_BYTES + length > 1 << PLACE_BITS - 1:
        raise ValueError(f"strings have at least {2 * GRAM} bytes, and shards at most {1 << PLACE_BITS - 1}")
    docs = numbered(bounded_batches(docs).select("doc_id", "text")).withColumnRenamed("__row", "row")
    kind = _kind(docs, "row")
    pieces = written(docs.select("row", "text").mapInArrow(_sharder(length, shard_bytes), PIECES.format(kind)),
                     "suffix-pieces")
    across = written(_across(pieces, docs, length, shard_bytes, group_bytes), "suffix-spans")
    found = pieces.select("piece", F.inline("spans")).unionByName(across)
    found = found.groupBy("piece").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    covers = written(found.join(pieces.select("piece", "row", "begin"), "piece").groupBy("row")
                     .agg(F.collect_list(F.struct("begin", "spans")).alias("covers")), "suffix-covers")
    packed = docs.select("row", "doc_id", "text").mapInArrow(
        _packed, f"row {kind}, doc_id {_kind(docs, 'doc_id')}, text binary")
    return packed.join(covers, "row", "left").select("doc_id", "text", "covers").mapInArrow(
        _keep, f"doc_id {_kind(docs, 'doc_id')}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
