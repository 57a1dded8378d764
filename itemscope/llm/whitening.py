"""Whitening of embeddings by incremental eigendecomposition.

Every partition keeps the count, the mean and the spectrum of its vectors' scatter, and changes them
by centred rank-one updates: the new eigenvalues are the roots of the secular equation between the
old ones, and directions that the update does not reach are deflated. A block of vectors is centred
and reduced to its triangular factor, which has the same scatter in at most d rows; these are the
updates, and one more for the distance of the means. So are spectra combined, with an update for
each scaled eigenvector of the other, sixteen partitions at a time. The rotation found so is refined in one more distributed pass, a Rayleigh-Ritz step over
all its directions, which gives eigenvalues and components to double precision.

Only d x d sums leave a task: no vector does.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from itemscope.llm.common import arrow, bounded_batches
from itemscope.session import written

#: Entries are rounded down to this many steps a unit, and moved up to be positive.
STEPS, SHIFT = 64, 1_000_000
#: Vectors that one triangular factor stands for.
BLOCK = 4096
#: Partials that one task adds up.
FAN = 16
_EPS = np.finfo(float).eps


def secular_roots(values, weights):
    """Roots of 1 + sum(weights / (values - x)) = 0, as (index of a pole, distance from it).

    `values` ascend strictly and `weights` are positive. Root i lies between pole i and pole i + 1,
    the last one at most sum(weights) above the last pole. Distances are from the nearer pole, so
    that differences to poles keep their digits.
    """
    n, own = len(values), np.arange(len(values))
    gap = np.append(values[1:] - values[:-1], weights.sum())
    apart = values[None, :] - values[:, None]            # [i, j]: pole j seen from pole i
    middle = 1 + (weights / (apart - (gap / 2)[:, None])).sum(1)
    upper = (middle < 0) & (own < n - 1)        # nearer to the pole above
    pole = own + upper
    seen = values[None, :] - values[pole][:, None]
    low = np.where(upper, -gap / 2, np.where(middle >= 0, 0.0, gap / 2))
    high = np.where(upper, 0.0, np.where(middle >= 0, gap / 2, gap))
    at = (low + high) / 2
    below = np.tri(n)
    under = values - values[pole]
    over = np.append(under[:-1] + gap[:-1], np.inf)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(100):
            away = 1 / (seen - at[:, None])
            term = weights * away
            value = 1 + term.sum(1)
            if np.all((np.abs(value) <= 4 * _EPS * (1 + np.abs(term).sum(1)))
                      | (high - low <= 2 * _EPS * np.abs(at))):
                break
            rising = value < 0                           # between poles the function rises
            low, high = np.where(rising, at, low), np.where(rising, high, at)
            # Poles below and above stand for one pole each, at the nearest, with their slopes; the
            # root of that function is the next guess, or the middle where it leaves the bracket.
            term *= away
            slope = term.sum(1)
            left = np.einsum("ij,ij->i", term, below)
            d1, d2 = under - at, over - at
            c = value - d1 * left - np.where(np.isinf(d2), 0.0, d2) * (slope - left)
            a, b = (d1 + d2) * value - d1 * d2 * slope, d1 * d2 * value
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move[-1] = d1[-1] * value[-1] / c[-1]
            step = at + move
            at = np.where((step >= low) & (step <= high) & (step != 0), step, (low + high) / 2)
    return pole, at


def rank_one_update(values, vectors, u):
    """Spectrum of vectors @ diag(values) @ vectors.T + u u^T; values ascend."""
    z = vectors.T @ u
    norm = float(z @ z)
    if norm == 0:
        return values, vectors
    scale = max(abs(values[-1]), norm)
    tiny = 8 * _EPS * scale
    # Deflation: directions that the update does not reach keep their value; of directions with
    # one value, a rotation leaves a single one that it does reach.
    reached = np.abs(z) * np.sqrt(norm) > tiny
    z = np.where(reached, z, 0.0)
    live = np.flatnonzero(reached)
    if len(live) == 0:
        return values, vectors
    vectors = vectors.copy()
    close = np.flatnonzero(values[live[1:]] - values[live[:-1]] <= tiny)
    for k in close:
        a, b = live[k], live[k + 1]
        r = np.hypot(z[a], z[b])
        c, s = z[b] / r, z[a] / r
        va, vb = vectors[:, a].copy(), vectors[:, b].copy()
        vectors[:, a], vectors[:, b] = c * va - s * vb, s * va + c * vb
        z[a], z[b] = 0.0, r
    live = np.flatnonzero(z)
    d = values[live]
    pole, offset = secular_roots(d, z[live] ** 2)
    # Weights for which these roots are exact, so that the vectors are orthogonal (Gu, Eisenstat).
    minus = (d[pole][:, None] - d[None, :]) + offset[:, None]      # root i less pole j
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(minus / apart, axis=0)))
    inner = np.copysign(exact, z[live])[None, :] / minus
    inner /= np.linalg.norm(inner, axis=1, keepdims=True)
    values = values.copy()
    values[live] = d[pole] + offset
    vectors[:, live] = vectors[:, live] @ inner.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the scatter of some vectors."""

    def __init__(self, d, count=0, mean=None, values=None, vectors=None):
        self.count = count
        self.mean = np.zeros(d) if mean is None else mean
        self.values = np.zeros(d) if values is None else values
        self.vectors = np.eye(d) if vectors is None else vectors

    def add(self, u):
        self.values, self.vectors = rank_one_update(self.values, self.vectors, u)

    def block(self, x):
        """Take in the rows of `x`. The rows of their triangular factor have the same scatter."""
        mean = x.mean(0)
        self.take(len(x), mean, np.linalg.qr(x - mean, mode="r"))

    def take(self, count, mean, rows):
        """Take in vectors of this count and mean, whose scatter is that of `rows`."""
        away, total = mean - self.mean, self.count + count
        for row in rows:
            self.add(row)
        self.add(away * np.sqrt(self.count * (count / total)))
        self.mean = self.mean + away * (count / total)
        self.count = total

    def merge(self, other):
        live = other.values > 0
        self.take(other.count, other.mean, (other.vectors[:, live] * np.sqrt(other.values[live])).T)

    def state(self):
        return np.concatenate(([self.count], self.mean, self.values, self.vectors.ravel()))

    @classmethod
    def of(cls, state, d):
        return cls(d, state[0], state[1:d + 1], state[d + 1:2 * d + 1], state[2 * d + 1:].reshape(d, d))


def _matrix(column, d):
    """The vectors of an Arrow list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _states(total):
    """One batch with one state, an array of doubles, under a key that spreads tasks."""
    kind = pa.list_(pa.float64())
    return arrow(part=pa.array([TaskContext.get().partitionId()], pa.int64()),
                 state=pa.array([total], kind))


STATE = "part long, state array<double>"


def _spectra(base, d):
    """The spectrum of a partition's vectors; `base` is taken off first, to keep their digits."""
    def work(batches):
        spectrum = Spectrum(d)
        for batch in batches:
            x = (_matrix(batch.column("x"), d) - base).astype(float)
            for begin in range(0, len(x), BLOCK):
                spectrum.block(x[begin:begin + BLOCK])
        if spectrum.count:
            yield _states(spectrum.state())
    return work


def _merged_spectra(d):
    def work(states):
        spectra = [Spectrum.of(s, d) for s in states]
        # The largest first: it is the one that is not taken apart.
        spectra.sort(key=lambda s: -s.count)
        for other in spectra[1:]:
            spectra[0].merge(other)
        return spectra[0].state()
    return work


def _covered(project, base, rest, n):
    """A partition's sum of the outer products of its projected, centred vectors."""
    def work(batches):
        total = None
        for batch in batches:
            y = _centred(batch.column("x"), base, rest, n) @ project
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield _states(total.ravel())
    return work


def _centred(column, base, rest, n):
    """x - S/n in double, from x - floor(S/n), which is exact, and the rest of the division."""
    return (_matrix(column, len(base)) - base).astype(float) - rest / n


def _combined(partials, merge):
    """All states of `partials` as one, about FAN at a time; every round is written."""
    def group(table):
        states = [np.array(s) for s in table.column("state").to_pylist()]
        return pa.table({"part": table.column("part")[:1],
                         "state": pa.array([merge(states)], pa.list_(pa.float64()))})

    partials = written(partials, "whitening-states")
    while (count := partials.count()) > 1:
        keyed = partials.withColumn("part", F.col("part") % -(-count // FAN))
        partials = written(keyed.groupBy("part").applyInArrow(group, STATE), "whitening-states")
    return np.array(partials.first()["state"])


def _stepped(embeddings):
    """vec_id and x, the entries as whole steps, of the rows whose vector has finite entries only."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return bounded_batches(embeddings).where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * STEPS) + SHIFT).alias("x"))


def _whitened(project, explained, error, base, rest, n):
    """A row for each vector and component."""
    k = project.shape[1]

    def work(batches):
        for batch in batches:
            rows = len(batch)
            z = _centred(batch.column("x"), base, rest, n) @ project
            at = pa.array(np.repeat(np.arange(rows), k))
            yield arrow(
                vec_id=batch.column("vec_id").take(at),
                component=pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                n=pa.array(np.full(rows * k, n, np.int64)), deviation=batch.column("deviation").take(at),
                # A component without variance has nothing to be scaled to.
                whitened=pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                explained=pa.array(np.tile(explained, rows)),
                identity_error=pa.array(np.full(rows * k, error)))
    return work


def whitened(embeddings, components=16):
    """vec_id, component, n, deviation, whitened, explained and identity_error of `embeddings`.

    Rows whose vector is NULL or has a NULL, NaN or infinite entry are dropped; entries become whole
    steps of 1/64. The basis is fitted on each distinct vector once. Rows that repeat a vec_id are
    rows of their own, equal vectors get equal values, and further columns are dropped, whatever
    their names. There are at most as many components as entries; one without variance has a NULL
    whitened value and does not count in identity_error. Vectors of several lengths raise. A table
    without vectors, or of vectors without entries, gives no rows. Sums that a long cannot hold raise.
    """
    rows = _stepped(embeddings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    fit = written(rows.select("x").distinct(), "whitening-fit")
    sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.sum("c").alias("s"), F.count("*").alias("n")).orderBy("i").collect()    # a row an entry
    if not sums:
        return embeddings.sparkSession.createDataFrame([], shape)
    d, n = len(sums), sums[0].n
    if sums[-1].n != n:
        raise ValueError("the vectors have several lengths")
    total = [r.s for r in sums]
    base = np.array([s // n for s in total])
    rest = np.array([float(s % n) for s in total])

    spectrum = Spectrum.of(_combined(fit.mapInArrow(_spectra(base, d), STATE), _merged_spectra(d)), d)
    rotation = np.linalg.qr(spectrum.vectors)[0]
    covered = _combined(fit.mapInArrow(_covered(rotation, base, rest, n), STATE), sum).reshape(d, d) / n
    values, inner = np.linalg.eigh((covered + covered.T) / 2)
    values, vectors = values[::-1], (rotation @ inner)[:, ::-1]

    k = min(components, d)
    varies = values[:k] > d * _EPS * values[0]
    project = np.full((d, k), np.nan)
    project[:, varies] = vectors[:, :k][:, varies] / np.sqrt(values[:k][varies])
    error = 0.0
    if varies.any():
        m = int(varies.sum())
        second = _combined(fit.mapInArrow(_covered(project[:, :m], base, rest, n), STATE), sum)
        error = float(np.abs(second.reshape(m, m) / n - np.eye(m)).max())
    explained = values[:k] / values.sum() if values[0] > 0 else np.zeros(k)
    away = F.zip_with("x", F.array(*map(F.lit, total)), lambda x, s: x * n - s)
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda held, v: held + v * v)
    return rows.withColumn("deviation", deviation).mapInArrow(
        _whitened(project, explained, error, base, rest, n), shape)
