"""Token counts of a word-end BPE tokenizer by rank-synchronous merging of ragged arrays."""

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F

from itemscope.llm.common import arrow, byte_characters, slices, texts

_NEVER = np.iinfo(np.int32).max
#: Distinct white-space-free chunks whose counts a Python worker remembers; then it starts anew.
REMEMBERED = 1_000_000
#: Characters that str.split() takes for white space and the tokenizer does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(
    r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class MergeTable:
    """Merges of a tokenizer file as sorted arrays, and the counting of surviving symbols."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(pieces[0]["pattern"]["Regex"])
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.final = np.array([vocab[c + end] for c in characters], np.int32)
        left, right = (np.array([vocab[m[i]] for m in model["merges"]], np.int64) for i in (0, 1))
        made = np.array([vocab["".join(m)] for m in model["merges"]], np.int32)
        self.width = max(vocab.values()) + 1
        rank_of = np.full(self.width, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        order = np.arange(len(made))
        # All pairs of the lowest rank may be merged at once only if no merge can bring forth a
        # pair of a lower rank than its own.
        if len(np.unique(made)) < len(made) or (rank_of[left] >= order).any() \
                or (rank_of[right] >= order).any():
            raise ValueError("the merges of this tokenizer depend on their order in a word")
        keys = left * self.width + right
        self.by_key = np.argsort(keys)
        self.keys, self.made = keys[self.by_key], made

    def ranks(self, left, right):
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.by_key[at], _NEVER).astype(np.int32)

    def surviving(self, words):
        """Symbols left of each word (non-empty bytes) when no pair can be merged any more.

        The words lie end to end in one array. In each round every word merges all places of its
        own lowest-ranked pair; words without a pair leave the arrays.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[flat]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[flat[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), _NEVER, np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        while len(symbol):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(starts, append=len(owner))
            best = np.minimum.reduceat(rank, starts)
            counts[owner[starts]] = lengths
            going = best != _NEVER
            if not going.all():
                kept = np.repeat(going, lengths)
                symbol, owner, rank = symbol[kept], owner[kept], rank[kept]
                best, lengths = best[going], lengths[going]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            # Places next to each other are a pair of equal symbols: every other one merges.
            place = np.arange(len(at))
            begins = np.diff(at, prepend=-2) != 1
            since = place - np.maximum.accumulate(np.where(begins, place, 0))
            at = at[since % 2 == 0]
            symbol[at] = self.made[rank[at]]
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            symbol, owner, rank, changed = symbol[kept], owner[kept], rank[kept], changed[kept]
            redo = np.flatnonzero(changed)
            rank[redo] = _NEVER
            redo = redo[redo < len(owner) - 1]
            redo = redo[owner[redo] == owner[redo + 1]]
            rank[redo] = self.ranks(symbol[redo], symbol[redo + 1])
        return counts


class Counter:
    """Token counts of texts; remembers counts of chunks between white space."""

    def __init__(self, path):
        self.merges, self.known = MergeTable(path), {}
        self.split_special = regex.compile("|".join(map(regex.escape, self.merges.special)))

    def chunks(self, text):
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def learn(self, chunks):
        pieces = [[p.encode() for p in self.merges.pieces.findall(
            unicodedata.normalize("NFC", c).replace("Σ", "σ").lower())] for c in chunks]
        distinct = list({p for ps in pieces for p in ps})
        left = dict(zip(distinct, self.merges.surviving(distinct).tolist())) if distinct else {}
        self.known.update((c, sum(left[p] for p in ps)) for c, ps in zip(chunks, pieces))

    def counts(self, batch):
        """Token counts of a list of texts."""
        special, parts = [0] * len(batch), []
        for i, text in enumerate(batch):
            if self.merges.special and any(s in text for s in self.merges.special):
                cut = self.split_special.split(text)
                special[i] = len(cut) - 1
                parts.append([c for part in cut for c in self.chunks(part)])
            else:
                parts.append(self.chunks(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*parts).difference(self.known)
        if new:
            self.learn(list(new))
        known = self.known
        return [n + sum([known[c] for c in cs]) for n, cs in zip(special, parts)]


_counters = {}


def token_counts(docs, tokenizer_path, limit=2048):
    """Byte and token counts of every text.

    `tokenizer_path` is a byte-level BPE file with a word-end suffix that every executor can open.
    Special strings inside a text count as one token each, no other special token is added. NULL
    counts as the empty text (0 bytes, 0 tokens). Rows are kept as they are: repeated rows give
    repeated results, a NULL doc_id stays NULL, an empty table gives no rows, further columns are
    dropped. Texts of any length are counted whole. One narrow pass without a shuffle.
    """
    def run(batches):
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = Counter(tokenizer_path)
        counter = _counters[tokenizer_path]
        for part in slices(batches):
            text = part.column("text")
            yield arrow(doc_id=part.column("doc_id"),
                        n_bytes=pc.binary_length(text).cast(pa.int64()),
                        n_tokens=(counter.counts(text.to_pylist()), pa.int64()))

    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
