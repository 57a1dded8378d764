"""A Katz backoff bigram model of a corpus, and the scores of all its texts.

Counts are discounted by Good-Turing up to MAX_DISCOUNTED. What a history's seen words lose goes to
its unseen words, in proportion to their unigram probabilities, by a backoff weight that makes each
distribution sum to one. Words are known by 64-bit hashes. Unknown words are one class.

Tasks work on slices of documents and exchange packed arrays with buckets of n-grams, since a row
per token would be several times as large as the text:

1. Unigram counts: totals, counts of counts, and the few words that are frequent in the corpus.
2. Every (history, word) of every slice goes to the bucket of its word, frequent words by short
   numbers; a frequent word is dealt over the buckets by its history. A bucket knows the counts of its words and pairs. It writes
   the sums of each document's seen tokens, each history's share of the backoff weight, and the
   unseen tokens, which ask for the weight of their history.
3. Shares and questions meet in the bucket of the history, and answers go back to the slices.

Logarithms of discounts are added at the end, once the counts of counts of all pairs are known.
"""

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from itemscope.llm.common import arrow, release, slices, texts
from itemscope.session import written

MAX_DISCOUNTED = 5
#: Counts above that lose this little, so that every history leaves some mass to unseen words.
LEAST_DISCOUNT = 0.01
#: Bytes of text of a slice, and of a bucket on average; a bucket is worked on in PARTS by hash.
SLICE, BUCKET, PARTS = 16 << 20, 12 << 20, 2
#: Bytes of text that are words as Python objects at once; these take ten times as much.
SPLIT = 2 << 20
#: A word is frequent if it occurs once in this many bytes of the corpus. A token and its space
#: take two bytes at least, so there are at most 2**18 frequent words and the end.
FREQUENT = 1 << 19
END, START = (np.uint64(xxhash.xxh64_intdigest(w)) for w in (b"\n", b"\n\n"))

_RANKS = np.arange(1, MAX_DISCOUNTED + 1)
_DOCS, _SUMS, _SHARES, _QUESTIONS, _COUNTS = range(5)
_PAIRS = 8    # and the number of the part
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PACKED = "kind int, at long, slice long, packed binary"


def _pack(**arrays):
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpack(data):
    return pickle.loads(zstandard.decompress(data))


def _rows(rows):
    """A record batch of (kind, at, slice, packed) rows."""
    kind, at, part, data = zip(*rows)
    return arrow(kind=(kind, pa.int32()), at=(at, pa.int64()), slice=(part, pa.int64()),
                 packed=(data, pa.binary()))


def _planes(numbers):
    """Bytes of small numbers, all lowest first; high bytes of frequent codes pack to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _joined(planes):
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _word_end(raw, at):
    """The first place from `at` on where no word of `raw` is cut."""
    space = _SPACE.search(raw, at)
    return space.start() if space else len(raw)


def _tokens(batch):
    """(hashes of distinct words, code of each token, tokens of each text), an end after each."""
    chunks, sizes, held = [], [], []
    for text in batch:
        n, begin, raw = 1, 0, text.encode().lower()
        while begin < len(raw):
            end = _word_end(raw, begin + SPLIT)
            found = raw[begin:end].split()
            n, begin = n + len(found), end
            held += found
            if len(held) * 8 >= SPLIT:
                chunks.append(pa.array(held, pa.binary()).dictionary_encode())
                held = []
        sizes.append(n)
    chunks.append(pa.array(held, pa.binary()).dictionary_encode())
    del held
    coded = pa.chunked_array(chunks).unify_dictionaries()
    hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.chunk(0).dictionary]
                      + [END], np.uint64)
    sizes = np.array(sizes, np.int64)
    codes = np.full(sizes.sum(), len(hashes) - 1, np.int32)
    words = np.ones(len(codes), bool)
    words[np.cumsum(sizes) - 1] = False
    codes[words] = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    # Codes in order of frequency are small numbers for most tokens.
    order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
    code = np.empty(len(order), np.int32)
    code[order] = np.arange(len(order))
    return hashes[order], code[codes], sizes


def _bucket(hashes, n):
    return ((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _pair(first, second):
    with np.errstate(over="ignore"):
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(29))


def _split(at):
    """(value, positions) for each distinct value of `at`."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for where in np.split(order, cuts):
        if len(where):
            yield int(at[where[0]]), where


def _slice_batches(batches):
    task = TaskContext.get().partitionId()
    for i, part in enumerate(slices(batches, limit=SLICE)):
        yield task << 20 | i, part
        del part
        release()


def _discounts(counts):
    """Good-Turing factors of counts 1 to MAX_DISCOUNTED, given counts of counts 1, 2, ...

    Where counts of counts are too few to give factors between 0 and 1, half a count is taken off.
    """
    n, k = np.asarray(counts, float), MAX_DISCOUNTED
    plain = (_RANKS - 0.5) / _RANKS
    if (n[:k + 1] <= 0).any():
        return plain
    common = (k + 1) * n[k] / n[0]
    factors = ((_RANKS + 1) * n[1:k + 1] / (_RANKS * n[:k]) - common) / (1 - common)
    good = np.isfinite(factors) & (factors > 0) & (factors < 1)
    return np.where(good, factors, plain)


class Unigrams:
    """What tasks need to know of unigrams: totals, discounts, frequent words with their counts."""

    def __init__(self, n, types, counts, large, frequent):
        self.n, self.types = n, types
        self.factors = _discounts(counts)
        words = np.array(sorted(frequent), np.uint64)
        self.words, self.counts = words, np.array([frequent[int(w)] for w in words], np.int64)
        left = ((1 - self.factors) * _RANKS * np.asarray(counts[:MAX_DISCOUNTED])).sum() \
            + LEAST_DISCOUNT * large
        self.unknown = left / n if n else 1.0

    def frequent(self, hashes):
        """(which hashes are frequent words, their counts)."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        return hit, np.where(hit, self.counts[at], 0)

    def numbers(self, hashes, often):
        """Short names of the frequent words among `hashes`, from 1 on; 0 for the others."""
        return np.where(often, np.searchsorted(self.words, hashes) + 1, 0)

    def hashes(self, numbers, rare):
        """The hashes that `numbers` and the hashes of the others, in their order, stand for."""
        out = np.empty(len(numbers), np.uint64)
        out[numbers == 0] = rare
        out[numbers > 0] = self.words[numbers[numbers > 0] - 1]
        return out

    def probability(self, counts):
        return np.where(counts > 0, _discounted(counts, self.factors) / max(self.n, 1), self.unknown)


def _discounted(counts, factors):
    small = np.clip(counts, 1, MAX_DISCOUNTED)
    return np.where(counts > MAX_DISCOUNTED, counts - LEAST_DISCOUNT, small * factors[small - 1])


def _count_of_counts(counts):
    return np.bincount(np.minimum(counts, MAX_DISCOUNTED + 2), minlength=MAX_DISCOUNTED + 3)


def _unigrams(docs, n_buckets, n_bytes):
    def count(batches):
        for number, part in _slice_batches(batches):
            hashes, codes, sizes = _tokens(part.column("text").to_pylist())
            learn = np.repeat(np.array(part.column("learn").to_pylist(), bool), sizes)
            counts = np.bincount(codes[learn], minlength=len(hashes))
            own = np.flatnonzero(counts)
            yield from (_rows([(_COUNTS, at, number, _pack(
                hashes=hashes[own[where]], counts=counts[own[where]].astype(np.int32)))])
                for at, where in _split(_bucket(hashes[own], n_buckets)))
            release()

    def total(table):
        parts = [_unpack(b) for b in table.column("packed").to_pylist()]
        hashes, at = np.unique(np.concatenate([p["hashes"] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p["counts"] for p in parts]),
                             len(hashes)).astype(np.int64)
        often = counts * FREQUENT >= n_bytes
        return pa.table({
            "n": pa.array([int(counts.sum())]), "types": pa.array([len(hashes)]),
            "counts": pa.array([_count_of_counts(counts).tolist()]),
            "words": pa.array([hashes[often].view(np.int64).tolist()], pa.list_(pa.int64())),
            "often": pa.array([counts[often].tolist()], pa.list_(pa.int64()))})

    found = docs.select("text", "learn").mapInArrow(count, _PACKED).groupBy("at").applyInArrow(
        total, "n long, types long, counts array<long>, words array<long>, often array<long>") \
        .collect()
    counts = np.sum([r["counts"] for r in found] or [[0] * (MAX_DISCOUNTED + 3)], axis=0)
    frequent = {w % (1 << 64): c for r in found for w, c in zip(r["words"], r["often"])}
    return Unigrams(sum(r["n"] for r in found), sum(r["types"] for r in found), counts[1:],
                    int(counts[MAX_DISCOUNTED + 1:].sum()), frequent)


def _pairs(docs, n_buckets, unigrams):
    """Packed (history, word) pairs of each slice, by bucket, and the documents of each slice."""
    def deal(batches):
        for number, part in _slice_batches(batches):
            hashes, codes, sizes = _tokens(part.column("text").to_pylist())
            learn = np.array(part.column("learn").to_pylist(), bool)
            yield _rows([(_DOCS, number % n_buckets, number, _pack(
                doc_id=part.column("doc_id").to_pylist(), sizes=sizes, learn=learn))])
            before = np.empty_like(codes)
            before[1:] = codes[:-1]
            begins = np.cumsum(sizes) - sizes
            hashes = np.append(hashes, START)
            before[begins] = len(hashes) - 1
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            often, _ = unigrams.frequent(hashes)
            numbers = unigrams.numbers(hashes, often)
            at = _bucket(hashes, n_buckets * PARTS).astype(np.int32)[codes]
            dealt = often[codes]
            at[dealt] = _bucket(_pair(hashes[before[dealt]], hashes[codes[dealt]]),
                                n_buckets * PARTS)
            for to, where in _split(at):
                used = np.zeros(len(hashes), bool)
                used[before[where]] = used[codes[where]] = True
                code = np.cumsum(used) - 1
                own, in_own = np.unique(doc[where], return_counts=True)
                yield _rows([(_PAIRS + to % PARTS, to // PARTS, number, _pack(
                    numbers=_planes(numbers[used]), rare=hashes[used & ~often],
                    history=_planes(code[before[where]]), word=_planes(code[codes[where]]),
                    doc=_planes(np.diff(own, prepend=0)), in_doc=_planes(in_own),
                    learn=learn[own]))])
            release()
    return docs.mapInArrow(deal, _PACKED)


def _part(parts, numbers, unigrams):
    """What the pairs of one part come to: sums of documents, shares, questions, counts of counts.

    `parts` are packed pairs of slices with `numbers`. A document is named slice << 24 | place.
    """
    own = [unigrams.hashes(_joined(p["numbers"]), p["rare"]) for p in parts]
    history = np.concatenate([h[_joined(p["history"])] for p, h in zip(parts, own)])
    word = np.concatenate([h[_joined(p["word"])] for p, h in zip(parts, own)])
    del own
    names = np.concatenate([(n << 24) + np.cumsum(_joined(p["doc"]), dtype=np.int64)
                            for p, n in zip(parts, numbers)])
    doc = np.repeat(np.arange(len(names)), np.concatenate([_joined(p["in_doc"]) for p in parts]))
    learn = np.concatenate([p["learn"] for p in parts])[doc]
    words, at_word = np.unique(word, return_inverse=True)
    counts = np.bincount(at_word, learn, len(words)).astype(np.int64)
    often, known = unigrams.frequent(words)
    counts = np.where(often, known, counts)
    below = unigrams.probability(counts)
    pairs, one, at_pair = np.unique(_pair(history, word), return_index=True, return_inverse=True)
    del word
    seen = np.bincount(at_pair, learn, len(pairs)).astype(np.int64)

    # Each token, without the factors of Good-Turing: its own part, and its part as a history.
    large = np.where(seen > MAX_DISCOUNTED, seen - LEAST_DISCOUNT, np.maximum(seen, 1))
    own = np.log10(np.where(seen > 0, large, below[at_word[one]]))
    later = np.where((counts > 0) & (words != END), -np.log10(np.maximum(counts, 1)), 0)
    n = len(names)
    rank = np.where(seen <= MAX_DISCOUNTED, seen, 0)[at_pair]
    sums = (names, np.bincount(doc, own[at_pair] + later[at_word], n),
            np.bincount(doc, np.log10(counts + 1.0)[at_word], n),
            np.bincount(doc, (counts > 0)[at_word], n),
            np.bincount(doc * (MAX_DISCOUNTED + 1) + rank, minlength=n * (MAX_DISCOUNTED + 1))
            .reshape(n, -1)[:, 1:].astype(np.int32))

    # Shares of backoff weights: sums over the distinct seen pairs of each history.
    types = np.flatnonzero(seen)
    heads, at = np.unique(history[one[types]], return_inverse=True)
    small = np.minimum(seen[types], MAX_DISCOUNTED + 1) - 1
    shares = (heads, np.bincount(at, below[at_word[one[types]]], len(heads)),
              np.bincount(at * (MAX_DISCOUNTED + 1) + small,
                          minlength=len(heads) * (MAX_DISCOUNTED + 1))
              .reshape(len(heads), -1).astype(np.int32))
    asked = np.flatnonzero(seen[at_pair] == 0)
    return sums, shares, (history[asked], names[doc[asked]]), _count_of_counts(seen)


def _counted(unigrams, n_buckets):
    """What a bucket makes of its pairs."""
    def run(table):
        out, by_part, counts = [], {}, 0
        for row in zip(*(table.column(c) for c in ("kind", "slice", "packed"))):
            kind = row[0].as_py()
            if kind == _DOCS:
                out.append((_DOCS, 0, row[1].as_py(), row[2].as_py()))
            else:
                by_part.setdefault(kind, []).append(row[1:])
        all_sums = []
        for part in sorted(by_part):
            rows = by_part.pop(part)
            # Packed bytes are read where they lie in the table.
            sums, (heads, mass, ranks), (asked, docs), found = _part(
                [_unpack(p.as_buffer()) for _, p in rows], [n.as_py() for n, _ in rows], unigrams)
            all_sums.append(sums)
            counts = counts + found
            for to, where in _split(_bucket(heads, n_buckets)):
                out.append((_SHARES, to, 0, _pack(names=heads[where], mass=mass[where],
                                                  ranks=np.ascontiguousarray(ranks[where].T))))
            for to, where in _split(_bucket(asked, n_buckets)):
                out.append((_QUESTIONS, to, 0, _pack(names=asked[where], doc=docs[where])))
            release()
        if all_sums:
            out.append((_COUNTS, 0, 0, _pack(counts=counts)))
            named, score, base, known, ranks = (np.concatenate(c) for c in zip(*all_sums))
            names, at = np.unique(named, return_inverse=True)
            n = len(names)
            score, base, known = (np.bincount(at, x, n) for x in (score, base, known))
            ranks = np.array([np.bincount(at, r, n) for r in ranks.T]).astype(np.int32)
            for number, here in _split(names >> 24):
                out.append((_SUMS, 0, number, _pack(
                    doc=(names[here] & 0xFFFFFF).astype(np.int32), score=score[here],
                    base=base[here], known=known[here].astype(np.int32), ranks=ranks[:, here])))
        result = pa.Table.from_batches([_rows(out[i:i + 8]) for i in range(0, len(out), 8)])
        release()
        return result
    return run


def _answered(factors):
    """Backoff weights of the histories of a bucket, and the answers to each slice."""
    lost = np.append((1 - factors) * _RANKS, LEAST_DISCOUNT)

    def run(table):
        shares, questions = [], []
        for kind, packed in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist()):
            (shares if kind == _SHARES else questions).append(_unpack(packed))
        if not questions or not shares:
            return pa.Table.from_batches([], schema=_rows([(0, 0, 0, b"")]).schema)
        names, at = np.unique(np.concatenate([s["names"] for s in shares]), return_inverse=True)
        mass = np.bincount(at, np.concatenate([s["mass"] for s in shares]), len(names))
        left = np.bincount(at, np.concatenate([lost @ s["ranks"] for s in shares]), len(names))
        weight = np.log10(left) - np.log10(1 - mass)
        asked = np.concatenate([q["names"] for q in questions])
        where = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        # A history that was never seen has no words of its own: all mass is the unigrams'.
        answer = np.where(names[where] == asked, weight[where], 0.0)
        docs, at = np.unique(np.concatenate([q["doc"] for q in questions]), return_inverse=True)
        score = np.bincount(at, answer, len(docs))
        result = pa.Table.from_batches([_rows([
            (_QUESTIONS, 0, to, _pack(doc=(docs[mine] & 0xFFFFFF).astype(np.int32),
                                      score=score[mine])) for to, mine in _split(docs >> 24)])])
        release()
        return result
    return run


def _assembled(unigrams, factors, n_learned):
    """Scores of the documents of a slice."""
    def run(table):
        rows = list(zip(table.column("kind").to_pylist(), table.column("packed").to_pylist()))
        docs = _unpack(next(p for k, p in rows if k == _DOCS))
        sizes, n = docs["sizes"], len(docs["sizes"])
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if n_learned:
            score -= np.log10(n_learned)
        for kind, packed in rows:
            if kind == _SUMS:
                part = _unpack(packed)
                score[part["doc"]] += part["score"] + np.log10(factors) @ part["ranks"]
                base[part["doc"]] += part["base"]
                known[part["doc"]] += part["known"]
            elif kind == _QUESTIONS:
                part = _unpack(packed)
                score[part["doc"]] += part["score"]
        base -= sizes * np.log10(unigrams.n + unigrams.types + 1)
        return pa.table({
            "doc_id": pa.array(docs["doc_id"], pa.int64()), "held_out": pa.array(~docs["learn"]),
            "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(n, unigrams.n), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(score)})
    return run


def katz_scores(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from rows whose crc32 of the doc_id as text has a remainder by 7 other than
    2. base_score is the add-one unigram score, score that of the Katz bigram model; both are
    log10 probabilities, an unknown word being one class. NULL and empty texts are the end alone.
    A NULL doc_id counts as the empty text in the CRC; rows that repeat a doc_id are scored (and
    learned) each. Without training rows all mass is the unknown class and both scores are 0. An
    empty table gives no rows; further columns are dropped. Whole texts are read and scored.
    """
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    docs = texts(docs).withColumn("learn", learn)
    size = docs.agg(F.sum(F.octet_length("text") + 2).alias("n"),
                    F.sum(F.col("learn").cast("long")).alias("learned")).first()
    n_bytes, n_learned = size["n"] or 0, size["learned"] or 0
    n_buckets = max(1, -(-n_bytes // BUCKET))
    unigrams = _unigrams(docs, n_buckets, n_bytes)
    counted = written(_pairs(docs, n_buckets, unigrams).groupBy("at").applyInArrow(
        _counted(unigrams, n_buckets), _PACKED), "katz-counted")
    counts = sum((_unpack(r["packed"])["counts"] for r in counted.where(F.col("kind") == _COUNTS)
                  .select("packed").collect()), np.zeros(MAX_DISCOUNTED + 3, np.int64))
    factors = _discounts(counts[1:])
    answers = counted.where(F.col("kind").isin(_SHARES, _QUESTIONS)).groupBy("at").applyInArrow(
        _answered(factors), _PACKED)
    sums = counted.where(F.col("kind").isin(_DOCS, _SUMS)).unionByName(answers)
    return sums.groupBy("slice").applyInArrow(
        _assembled(unigrams, factors, n_learned),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
