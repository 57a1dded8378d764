"""Packing of tokenised documents along a space-filling curve.

Each document gets a vector: its token ids, hashed to signs and averaged, in few dimensions. The
Hilbert index of that vector is its place on a curve along which near vectors lie together.
Documents in curve order form one stream of token ids, cut at every multiple of the sequence
length, so that neighbours on the curve share sequences and only the very last one is padded.
"""

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemscope.llm.common import arrow, byte_characters, release, slices, texts
from itemscope.operators.ranks import running_sums
from itemscope.session import written

DIMENSIONS, LEVELS = 4, 15
END = 0
#: Chunks that a worker remembers; more of them spare hardly any time.
REMEMBERED = 500_000
#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NUMBERS = [struct.Struct(f"<{n}H").pack for n in range(32)]
_SPACE = re.compile(r"\s")


class _Chunks(dict):
    """Ids of chunks behind `lead` as little-endian 16-bit numbers; None for white space inside."""

    def __init__(self, encoder, lead):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk):
        if not chunk or _SPACE.search(chunk):
            self[chunk] = None
            return None
        if chunk.isalpha():
            ids = self.encoder.encode_single_piece((self.lead + chunk).encode())
        else:
            ids = self.encoder.encode_ordinary(self.lead + chunk)
        found = _NUMBERS[len(ids)](*ids) if len(ids) < 32 else np.array(ids, "<u2").tobytes()
        self[chunk] = found
        return found


class TokenIds:
    """Token ids of texts as little-endian 16-bit numbers; remembers chunks between spaces.

    In byte-level BPE a single space or line end between other characters always begins a new
    piece, so chunks between them have ids of their own. Texts with other white space and with
    special strings are encoded whole by the tokenizer.
    """

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: i for i, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()
                 if all(c in byte for c in token)}
        merged = [model["vocab"]["".join(m)] for m in model["merges"]]
        if len(ranks) > 1 << 16 or merged != sorted(merged):
            raise ValueError("ids must have 16 bits and follow the order of the merges")
        # New chunks are many and short; this encoder has the same vocabulary and less to do.
        encoder = tiktoken.Encoding("chunks", pat_str=PIECES, mergeable_ranks=ranks,
                                    special_tokens={})._core_bpe
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.spaced = _Chunks(encoder, ""), _Chunks(encoder, " ")
        self.line_end = self._whole("\n")

    def _whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _one(self, text):
        first, spaced = self.first, self.spaced
        if any(s in text for s in self.special):
            return self._whole(text)
        try:
            return self.line_end.join([
                b"".join([first[c[0]], *[spaced[w] for w in c[1:]]])
                for c in [line.split(" ") for line in text.split("\n")]])
        except TypeError:    # a chunk is None
            return self._whole(text)

    def ids(self, batch):
        out = []
        for text in batch:
            if len(self.first) + len(self.spaced) > REMEMBERED:
                self.forget()
            out.append(self._one(text))
        return out

    def forget(self):
        self.first.clear()
        self.spaced.clear()


def _signs(size):
    """Hashed directions of token ids: +1 or -1 in each dimension."""
    ids = np.arange(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    bits = (h[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)
    return 2.0 * bits.astype(np.float32) - 1


def hilbert(points, levels=LEVELS):
    """Hilbert indices of integer points (rows) with `levels` bits in each dimension."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (levels - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> level) & 1
    return index


def _curve(ids, signs):
    """Places on the curve of documents, given as arrays of token ids."""
    sizes = np.array([len(i) for i in ids])
    total = np.add.reduceat(signs[np.concatenate(ids)], np.cumsum(sizes) - sizes, axis=0)
    mean = total / sizes[:, None]
    unit = 1 / (1 + np.exp(-8 * mean))
    return hilbert(np.minimum(unit * (1 << LEVELS), (1 << LEVELS) - 1).astype(np.int64))


_tokenizers = {}


def tokenised(docs, tokenizer_path):
    """doc_id, curve (Hilbert index), n, crc and ids (16-bit) of every text, NULL as the empty one.

    Rows that repeat a doc_id have rows of their own; an empty table gives none; further columns
    are dropped.
    """
    def run(batches):
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = TokenIds(tokenizer_path)
        known = _tokenizers[tokenizer_path]
        signs = _signs(known.tokenizer.get_vocab_size())
        end = np.array([END], "<u2").tobytes()
        for part in slices(batches, limit=4 << 20):
            found = [i + end for i in known.ids(part.column("text").to_pylist())]
            arrays = [np.frombuffer(i, "<u2") for i in found]
            yield arrow(doc_id=part.column("doc_id"), curve=(_curve(arrays, signs), pa.int64()),
                        n=([len(a) for a in arrays], pa.int64()),
                        crc=([zlib.crc32(i) for i in found], pa.int64()), ids=(found, pa.binary()))
    return texts(docs).mapInArrow(run, "doc_id long, curve long, n long, crc long, ids binary")


def packed(docs, tokenizer_path, length=1024):
    """Pieces of documents in sequences of `length` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Documents follow
    their whole Hilbert index, equal ones their doc_id (NULL first). A document is its token ids and one END, a NULL or empty text END alone. Special strings inside a text are the
    tokenizer's special tokens. All sequences are full but the last. Rows that repeat a doc_id are
    documents of their own, a NULL doc_id stays NULL, an empty table gives no rows, further
    columns are dropped. Texts of any length are packed whole.
    """
    rows = written(tokenised(docs, tokenizer_path).withColumn("row", F.monotonically_increasing_id()),
                   "tokenised")
    # Only keys and lengths are sorted. Copies share a curve, so doc_id and contents go on from there.
    places = rows.select(F.struct("curve", "doc_id", "crc", "row").alias("place"), "n")
    places = written(running_sums(places, [], "place", ["n"]).select(
        F.col("place.row").alias("row"), F.col("n_before").alias("at")), "places")
    placed = rows.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "ids", "at")

    def cut(batches):
        for known in _tokenizers.values():    # of a worker that tokenised before
            known.forget()
        release()
        for part in slices(batches, "ids"):
            out = []
            for doc_id, ids, at in zip(*(part.column(c).to_pylist() for c in ("doc_id", "ids", "at"))):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                edges = [0, *range(length - at % length, len(wide), length), len(wide)]
                for begin, end in zip(edges, edges[1:]):
                    out.append((doc_id, begin, end - begin, zlib.crc32(wide[begin:end].tobytes()),
                                len(wide), (at + begin) // length, (at + begin) % length))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield arrow(**{n: (v, pa.int64()) for n, v in zip(names, zip(*out))})

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, "
                                  "doc_tokens long, sequence_id long, offset long")
