"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; a sample of all labelled rows, whatever their label, is the
unlabelled side. The class prior corrects the risk: negatives are estimated as the unlabelled risk
less the prior's share of positives, and where that estimate falls below zero the step goes back.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from itemscope.llm.common import arrow, bounded_batches, slices, whole_row
from itemscope.llm.decontamination import words
from itemscope.session import written

#: Bounds of the sample a model is fitted on, and of its features. Rows come in hash order.
POSITIVES, UNLABELLED, FEATURES = 6_000, 12_000, 4_096
#: Tasks over the sample, whose size is bounded.
SAMPLE_PARTS = 24
#: Beginnings of words, in bytes, that are features beside the whole word.
STEMS = (4, 5, 6)
#: A feature's share among positives exceeds its share among all by this factor.
LIFT = 2.5
STEPS, RATE, DECAY = 600, 0.05, 1e-4
REMEMBERED = 1_000_000


def _features(word):
    digest = xxhash.xxh64_intdigest
    out = [digest(word, 1)]
    out += [digest(word[:n], 1 + n) for n in STEMS if len(word) >= n]
    return np.array(out, np.uint64).view(np.int64).tolist()


def _sample(docs, labels, learn):
    """Rows to fit on: text and side, 1 for at most POSITIVES toxic rows, 0 for at most UNLABELLED.

    Rows are chosen by id alone. Their ids, of a number these bounds prove, are broadcast, so that
    no other text moves.
    """
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id").where(learn).distinct().join(marked, "doc_id")
    order = F.xxhash64("doc_id")
    chosen = written(rows.where("toxic = 1").orderBy(order, "doc_id").limit(POSITIVES)
                     .withColumn("side", F.lit(1)).unionByName(
                         rows.orderBy(order, "doc_id").limit(UNLABELLED)
                         .withColumn("side", F.lit(0))).select("doc_id", "side"), "toxicity-ids")
    texts_of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(texts_of.join(F.broadcast(chosen), "doc_id").select("text", "side"),
                   "toxicity-sample").repartition(SAMPLE_PARTS)


def _counted(batches):
    """(feature, pos, any): in how many positive and unlabelled rows of the task it occurs."""
    for part in slices(batches):
        side = np.array(part.column("side").to_pylist())
        found = [{f for w in set(words(t)) for f in _features(w)}
                 for t in part.column("text").to_pylist()]
        flat = np.fromiter((f for fs in found for f in fs), np.int64)
        owner = np.repeat(side, [len(fs) for fs in found])
        names, at = np.unique(flat, return_inverse=True)
        pos = np.bincount(at, owner == 1, len(names)).astype(np.int64)
        yield arrow(feature=names, pos=pos, any=np.bincount(at, owner == 0, len(names)).astype(np.int64))


class Model:
    """Weights of features that a text has or has not, and the texts' scores."""

    def __init__(self, names, weights, bias):
        self.weights, self.bias = weights, bias
        self.index = {n: i for i, n in enumerate(names)}
        self.known = {}

    def present(self, text):
        out = set()
        for w in set(words(text)):
            hit = self.known.get(w)
            if hit is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                hit = self.known[w] = tuple(
                    self.index[f] for f in _features(w) if f in self.index)
            if hit:
                out.update(hit)
        return sorted(out)

    def score(self, text):
        logit = self.bias + sum(self.weights[i] for i in self.present(text))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))) if logit > -np.inf else 0.0


def _nnpu(rows, side, n_features, prior):
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam)."""
    sizes = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64, sizes.sum())
    owner = np.repeat(np.arange(len(rows)), sizes)
    pos, n_pos, n_any = side == 1, (side == 1).sum(), (side == 0).sum()
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        f = np.bincount(owner, w[flat], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-f))
        # Slopes of the loss as a positive (-log p) and as a negative (-log(1-p)).
        negative = np.logaddexp(0, f)
        risk = negative[~pos].mean() - prior * negative[pos].mean()
        slope = np.where(pos, -prior * p / n_pos, p / n_any)
        if risk >= 0:
            slope = slope + np.where(pos, prior * (p - 1) / n_pos, 0)
        else:
            slope = -slope
        g = np.append(np.bincount(flat, slope[owner], n_features), slope.sum())
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], w[-1]


def fit(docs, labels, learn):
    """A model learned from the labelled rows of `docs` where the condition `learn` holds.

    Without a positive row every score is 0. The sample is bounded by POSITIVES and UNLABELLED and
    the features by FEATURES; only their numbers, never texts, come to the driver.
    """
    sample = _sample(bounded_batches(docs), labels, learn).select("text", "side")
    counts = sample.mapInArrow(_counted, "feature long, pos long, any long") \
        .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("any").alias("any"))
    marked = docs.select("doc_id").where(learn).distinct().join(
        labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").agg(
        F.avg(F.col("toxic").cast("double")).alias("prior"), F.sum("toxic").alias("pos")).first()
    if not marked["pos"]:
        return Model([], np.zeros(0), -np.inf)
    sizes = sample.agg(F.sum("side"), F.sum(1 - F.col("side"))).first()
    n_pos, n_any = sizes
    expected = F.col("any") / F.lit(int(n_any)) * F.lit(int(n_pos))
    names = [r["feature"] for r in counts.where(
        (F.col("pos") >= 3) & (F.col("pos") >= LIFT * expected))
        .orderBy(F.desc((F.col("pos") - expected) / F.sqrt(expected + 1)), "feature")
        .limit(FEATURES).select("feature").collect()]
    model = Model(names, np.zeros(len(names)), 0.0)

    def run(batches):
        for part in slices(batches):
            yield arrow(side=part.column("side"), found=pa.array(
                [model.present(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32())))

    rows = sample.mapInArrow(run, "side int, found array<int>").collect()
    prior = min(max(marked["prior"], 1e-4), 1 - 1e-4)
    weights, bias = _nnpu([r["found"] for r in rows], np.array([r["side"] for r in rows]),
                          len(names), prior)
    return Model(names, weights, bias)


def _scored(docs, model):
    """The columns of `docs` in a struct `row`, and the score of each text."""
    rows = bounded_batches(docs).select(whole_row(docs), F.coalesce("text", F.lit("")).alias("text"))
    names = {n: i for n, i in model.index.items()}

    def run(batches):
        local = Model(names, model.weights, model.bias)
        for part in slices(batches):
            yield arrow(row=part.column("row"), score=(
                [local.score(t) for t in part.column("text").to_pylist()], pa.float64()))

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def toxicity(docs, labels):
    """doc_id, held_out, score and predicted of every row.

    The model learns from labelled rows that are not held out, and from their texts alone. NULL
    and empty texts get the score of a text without any feature. Labels that are NULL or belong to
    no row teach nothing; of repeated labels the highest counts. Rows that repeat a doc_id are
    scored each; a NULL doc_id has the remainder of the empty text. Without positive labels every
    score is 0. An empty table gives no rows; further columns are dropped. Whole texts are scored.
    """
    scored = _scored(docs.select("doc_id", "text"), fit(docs, labels, ~held_out()))
    return scored.select("row.doc_id", "score").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs, labels):
    """`docs` without the rows that the model rejects, all columns unchanged, whatever their names.

    NULL and empty texts, repeated rows and missing labels count as in `toxicity`; an empty table
    stays empty.
    """
    return _scored(docs, fit(docs, labels, ~held_out())).where("score < 0.5").select("row.*")
