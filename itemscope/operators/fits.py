"""Maximum-likelihood fits of the 1PL, 2PL and K-factor logistic models on a long response table.

Given the subjects, every item is a small ridge-penalized logistic regression on its own answers
and is solved inside its row of the packed table. What is left is a function of the subjects
alone: the penalized likelihood at the best items. One pass gives its value and gradient, added up
per subject, the only rows that are shuffled. For few subjects a pass also adds up the whole matrix of
second derivatives, and Newton steps settle in some ten passes; for more, it is climbed by
limited-memory quasi-Newton steps. Either count only where the likelihood rises, so a fit converges
or raises. Scale and axes, which leave the likelihood as it is, are fixed at the end.
"""

from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from itemscope.functions.scalar import safe_logit
from itemscope.session import local_table, written

FIT_SUBJECTS = 1_000_000  # subject parameters are held by the driver between passes
REMEMBERED_STEPS = 12  # of the quasi-Newton direction
WHOLE_PARAMETERS = 256  # subject parameters up to which all their second derivatives are added up
QUASI_PASSES = 100  # after which Newton steps no longer wait for a concave likelihood
_CROSSED = 1 << 21  # numbers of a dense block of items by subject parameters
_CELLS = 1 << 16  # items times subjects that are fitted at once
_FILLED = 4  # cells of a table of items by subjects for each answer, at most
_EDGE = 1e-4  # mean answers are kept this far from 0 and 1


class _Model:
    """log-odds = offset(subject) + X(subject) . item, seen from the item,
    and = offset(item) + W(item) . subject, seen from the subject.

    The longest quasi-Newton step is `stride` times the subjects' root mean square, 1 at least."""

    stride = 0.0

    def __init__(self, item_prior, item_penalty, subject_prior, subject_penalty):
        self.item_prior, self.item_penalty = np.array(item_prior), np.array(item_penalty)
        self.subject_prior = np.array(subject_prior)
        self.subject_penalty = np.array(subject_penalty)

    def mixed(self):
        """Second derivatives of the log-odds, by item parameter and subject parameter."""
        return np.zeros((len(self.item_prior), len(self.subject_prior)))


class OnePL(_Model):
    """log-odds = theta - b; item parameter b, subject parameter theta."""

    def __init__(self):
        super().__init__([0.0], [0.0], [0.0], [0.0])

    def item_view(self, s):
        return s[:, 0], -np.ones((len(s), 1))

    def subject_view(self, i):
        return -i[:, 0], np.ones((len(i), 1))

    def fixed(self, s):
        """Subjects with the scale fixed, and (m, c) that turn items into items @ m + c."""
        return s - s.mean(axis=0), np.eye(1), -s.mean(axis=0)


class TwoPL(_Model):
    """log-odds = a theta + d; item parameters (a, d) with a drawn to 1, b = -d / a.

    The more items there are, the less theta is drawn to 0, so steps lengthen with it.
    """

    stride = 3.0

    def __init__(self):
        super().__init__([1.0, 0.0], [1.0, 0.01], [0.0], [1.0])

    def item_view(self, s):
        return np.zeros(len(s)), np.column_stack([s[:, 0], np.ones(len(s))])

    def subject_view(self, i):
        return i[:, 1], i[:, :1]

    def mixed(self):
        return np.array([[1.0], [0.0]])

    def fixed(self, s):
        mean, spread = s.mean(), max(s.std(), 1e-12)
        return (s - mean) / spread, np.array([[spread, mean], [0.0, 1.0]]), np.zeros(2)


class KFactor(_Model):
    """log-odds = bias + u . v; subject parameters (bias, u), item parameters v.

    Only the product u . v is determined. The columns of u are its principal axes, longest first,
    at unit mean square and with a positive largest entry. Of its many hills long steps choose lower ones.
    """

    def __init__(self, k):
        super().__init__(np.zeros(k), np.ones(k), np.zeros(k + 1), np.r_[0.01, np.full(k, 0.1)])

    def item_view(self, s):
        return s[:, 0], s[:, 1:]

    def subject_view(self, i):
        return np.zeros(len(i)), np.column_stack([np.ones(len(i)), i])

    def mixed(self):
        k = len(self.item_prior)
        return np.hstack([np.zeros((k, 1)), np.eye(k)])

    def fixed(self, s):
        left, size, axes = np.linalg.svd(s[:, 1:], full_matrices=False)
        size = np.maximum(size / np.sqrt(len(s)), 1e-12)
        top = left[np.abs(left).argmax(axis=0), np.arange(len(size))]
        sign = np.where(top < 0, -1.0, 1.0)
        return (np.hstack([s[:, :1], left * sign * np.sqrt(len(s))]),
                axes.T * (sign * size), np.zeros(len(size)))


def _solve(h, g):
    return np.linalg.solve(h + 1e-9 * np.eye(h.shape[-1]), g[..., None])[..., 0]


def _likelihood(eta, y):
    return y * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta)))


def _chance(eta):
    return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def _sums(index, size, values):
    return np.stack([np.bincount(index, v, size) for v in values.reshape(len(index), -1).T],
                    axis=1).reshape(size, *values.shape[1:])


def _squares(x, weight, index, size):
    """Weighted sums by index of the outer products of the rows of `x`."""
    out = np.empty((size, x.shape[1], x.shape[1]))
    for a in range(x.shape[1]):
        for b in range(a + 1):
            out[:, a, b] = out[:, b, a] = np.bincount(index, x[:, a] * x[:, b] * weight, size)
    return out


class _Listed:
    """The answers of a block of items one by one, beside what the items need of their subjects."""

    def __init__(self, model, subjects, who, item, y, n_items):
        self.offset, self.x = (part[who] for part in model.item_view(subjects))
        self.who, self.item, self.y, self.n, self.size = who, item, y, n_items, len(subjects)

    def rows(self, kept):
        """Which of the chances that `at` gives belong to these items."""
        return kept[self.item]

    def only(self, kept):
        out, rows = copy(self), self.rows(kept)
        out.who, out.y, out.offset, out.x = self.who[rows], self.y[rows], self.offset[rows], self.x[rows]
        out.item, out.n = (np.cumsum(kept) - 1)[self.item[rows]], np.count_nonzero(kept)
        return out

    def at(self, beta):
        """(chances of the answers, likelihoods of the items) at these items."""
        eta = self.offset + np.einsum("ij,ij->i", self.x, beta[self.item])
        return _chance(eta), np.bincount(self.item, _likelihood(eta, self.y), self.n)

    def slopes(self, p):
        """Gradients and negative Hessians of the items' likelihoods."""
        return (_sums(self.item, self.n, self.x * (self.y - p)[:, None]),
                _squares(self.x, p * (1 - p), self.item, self.n))

    def subject_slopes(self, w, p):
        """The same by subject, where the log-odds are w . subject; and the subjects met."""
        w, met = w[self.item], np.zeros(self.size, bool)
        met[self.who] = True
        return (_sums(self.who, self.size, w * (self.y - p)[:, None]),
                _squares(w, p * (1 - p), self.who, self.size), met)

    def crossed(self, model, w, p, lower):
        """What the items' own best answer takes from the subjects' second derivatives, added up.

        An item's share is C' H^-1 C, with H its second derivatives and C those by item and subject
        parameters. With H = LL' it is the product of L^-1 C with itself, for many items at once.
        """
        q, r, size = self.x.shape[1], w.shape[1], self.size
        spread = (p * (1 - p))[:, None, None]
        cross = (self.x[:, :, None] * w[self.item][:, None, :] * spread
                 - (self.y - p)[:, None, None] * model.mixed())
        out = np.zeros((size * r, size * r))
        # answers lie item by item
        bounds, step = np.searchsorted(self.item, np.arange(self.n + 1)), max(1, _CROSSED // (q * size * r))
        for a in range(0, self.n, step):
            z = min(a + step, self.n)
            here = slice(bounds[a], bounds[z])
            dense = np.zeros((z - a, size, q, r))
            np.add.at(dense, (self.item[here] - a, self.who[here]), cross[here])
            dense = dense.transpose(2, 0, 1, 3).reshape(q, z - a, size * r)
            for part in _forward(lower[a:z], dense):
                out += part.T @ part
        return out


class _Tabled:
    """The answers of a block as tables of items by subjects, their counts and sums.

    For few subjects most cells are filled, and sums over answers are products of matrices.
    """

    def __init__(self, model, subjects, who, item, y, n_items):
        self.offset, self.x = model.item_view(subjects)
        self.n, self.size = n_items, len(subjects)
        cell, cells = item * self.size + who, (n_items, self.size)
        self.count = np.bincount(cell, minlength=n_items * self.size).reshape(cells).astype(float)
        self.total = np.bincount(cell, y, n_items * self.size).reshape(cells)
        # so that the product of 1 + e over the subjects, 2 at most each, needs one logarithm
        self.once = self.size <= 1000 and self.count.max(initial=0) <= 1
        self.met, self.pull = self.total @ self.offset, self.total @ self.x
        self.squares = _products(self.x)

    def rows(self, kept):
        return kept

    def only(self, kept):
        out = copy(self)
        out.count, out.total, out.met, out.pull = (t[kept] for t in (self.count, self.total, self.met, self.pull))
        out.n = len(out.count)
        return out

    def at(self, beta):
        eta = beta @ self.x.T
        eta += self.offset
        e = np.exp(-np.abs(eta))
        if self.once:
            log = np.log((1 + self.count * e).prod(axis=1))
        else:
            log = np.einsum("ij,ij->i", self.count, np.log1p(e))
        log += np.einsum("ij,ij->i", self.count, np.maximum(eta, 0))
        whole = 1 + e
        np.copyto(e, 1.0, where=eta >= 0)
        e /= whole
        return e, self.met + np.einsum("ij,ij->i", beta, self.pull) - log

    def slopes(self, p):
        weight = self.count * p
        g = self.pull - weight @ self.x
        weight *= 1 - p
        return g, _unfolded(weight @ self.squares, self.x.shape[1])

    def subject_slopes(self, w, p):
        weight = self.count * p
        g = (self.total - weight).T @ w
        weight *= 1 - p
        return g, _unfolded(weight.T @ _products(w), w.shape[1]), self.count.any(axis=0)

    def crossed(self, model, w, p, lower):
        q, r, wide = self.x.shape[1], w.shape[1], self.size * w.shape[1]
        weight, mixed = self.count * p, model.mixed()
        off = self.total - weight
        weight *= 1 - p
        cross = np.empty((q, self.n, self.size, r))
        for a in range(q):
            scaled = weight * self.x[:, a]
            for b in range(r):
                np.multiply(scaled, w[:, b:b + 1], out=cross[a, :, :, b])
                if mixed[a, b]:
                    cross[a, :, :, b] -= off * mixed[a, b]
        out = np.zeros((wide, wide))
        for part in _forward(lower, cross.reshape(q, self.n, wide)):
            out += part.T @ part
        return out


def _products(x):
    return np.stack([x[:, a] * x[:, b] for a in range(x.shape[1]) for b in range(a + 1)], axis=1)


def _unfolded(sums, wide):
    """Symmetric matrices from rows of their lower triangles."""
    out = np.empty((len(sums), wide, wide))
    at = iter(sums.T)
    for a in range(wide):
        for b in range(a + 1):
            out[:, a, b] = out[:, b, a] = next(at)
    return out


def _lower(h):
    """Cholesky factors of many small matrices."""
    out = np.zeros_like(h)
    for a in range(h.shape[1]):
        for b in range(a + 1):
            left = h[:, a, b] - np.einsum("ij,ij->i", out[:, a, :b], out[:, b, :b])
            out[:, a, b] = np.sqrt(np.maximum(left, 1e-12)) if a == b else left / out[:, b, b]
    return out


def _forward(lower, rows):
    """L^-1 times `rows`, whose first axis is that of the matrices; changes them."""
    for a in range(len(rows)):
        for b in range(a):
            rows[a] -= lower[:, a, b, None] * rows[b]
        rows[a] /= lower[:, a, a, None]
    return rows


def _ridge(model):
    return np.diag(model.item_penalty) + 1e-9 * np.eye(len(model.item_penalty))


def _step(lower, g):
    """H^-1 g of many items, with H = LL'."""
    out = _forward(lower, g.T[:, :, None].copy())[:, :, 0]
    for a in reversed(range(len(out))):
        for b in range(a + 1, len(out)):
            out[a] -= lower[:, b, a] * out[b]
        out[a] /= lower[:, a, a]
    return out.T


def _fit_items(model, answers, steps=200):
    """(items, likelihoods) of a block.

    Newton steps, halved for an item until its value rises by a part of what the slope promises.
    Items that no longer move are done, and their answers are left out of further steps.
    """
    n = answers.n
    found, values, open_items = np.tile(model.item_prior, (n, 1)), np.zeros(n), np.arange(n)
    scale = np.maximum(1.0, np.abs(answers.x).max(axis=0, initial=0))    # of the log-odds

    def at(answers, beta):
        p, likelihood = answers.at(beta)
        return p, likelihood - np.sum(model.item_penalty * (beta - model.item_prior) ** 2, axis=1) / 2

    beta = found.copy()
    p, reached = at(answers, beta)
    for _ in range(steps):
        g, h = answers.slopes(p)
        g -= model.item_penalty * (beta - model.item_prior)
        move = _step(_lower(h + _ridge(model)), g)
        move /= np.maximum(1.0, np.abs(move).max(axis=1, keepdims=True) / 4)
        promised = np.sum(move * g, axis=1)
        going = np.abs(move * scale).max(axis=1) >= 1e-5    # Newton steps leave an error of about their square
        if not going.all():
            done = open_items[~going]
            found[done], values[done] = (beta + move)[~going], (reached + promised / 2)[~going]
            if not going.any():
                return found, values
            answers, open_items = answers.only(going), open_items[going]
            beta, reached, move, promised = beta[going], reached[going], move[going], promised[going]
        tried = beta + move
        p, new = at(answers, tried)
        size = 1.0
        while (worse := new < reached + 0.1 * size * promised - 1e-10 * (1 + np.abs(reached))).any():
            size = np.where(worse, size / 2, size)
            tried[worse] = (beta + size[:, None] * move)[worse]
            p[answers.rows(worse)], new[worse] = at(answers.only(worse), tried[worse])
        beta, reached = tried, new
    raise RuntimeError(f"an item did not converge in {steps} Newton steps")


def _block(batch):
    """(subjects, items, answers) of a batch of rows with the lists `who` and `ys`."""
    lengths = batch.column("who").value_lengths().to_numpy(zero_copy_only=False)
    who, y = (batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("who", "ys"))
    item = np.repeat(np.arange(len(lengths)), lengths)
    # an item answered all alike has no finite difficulty: its mean is kept off the edge
    mean = np.bincount(item, y, len(lengths)) / lengths
    pull = np.clip(mean, _EDGE, 1 - _EDGE) - mean
    return who, item, y + pull[item]


def _pieces(model, subjects, batch):
    """The items of an Arrow or pandas batch as (rows, answers).

    Where most cells are filled they lie in tables, few enough for the caches, else in a list.
    """
    if not isinstance(batch, pa.RecordBatch):
        batch = pa.RecordBatch.from_pandas(batch, preserve_index=False)
    n, size = batch.num_rows, max(1, len(subjects))
    tabled = n * size <= _FILLED * len(batch.column("who").flatten())
    step = max(1, _CELLS // size) if tabled else max(1, n)
    for a in range(0, n, step):
        part = batch.slice(a, step)
        yield part, (_Tabled if tabled else _Listed)(model, subjects, *_block(part), part.num_rows)


def _subject_sums(model, subjects):
    """Gradient and Hessian sums by subject; a row with idx -1 holds the penalized likelihood.

    Up to WHOLE_PARAMETERS, rows that follow the subjects' hold what `crossed` adds up.
    """
    size, r = len(subjects), subjects.shape[1]
    whole = size * r <= WHOLE_PARAMETERS

    def run(batches):
        total, met, likelihood = np.zeros((size, r + r * r)), np.zeros(size, bool), 0.0
        crossed = 0.0
        for batch in batches:
            for _, answers in _pieces(model, subjects, batch):
                beta, values = _fit_items(model, answers)
                likelihood += values.sum()
                w = model.subject_view(beta)[1]
                p, _ = answers.at(beta)
                g, h, seen = answers.subject_slopes(w, p)
                total += np.hstack([g, h.reshape(size, -1)])
                met |= seen
                if whole:
                    lower = _lower(answers.slopes(p)[1] + _ridge(model))
                    crossed = crossed + answers.crossed(model, w, p, lower)
        if not met.any():
            return
        more = _cut(crossed, r + r * r) if whole else []
        rows = np.concatenate((np.flatnonzero(met), [-1], size + np.arange(len(more))))
        yield pd.DataFrame({"idx": rows, "row": [
            *total[met], np.append(likelihood, np.zeros(r + r * r - 1)), *more]})
    return run


def _cut(matrix, width):
    """A matrix as rows of `width` numbers, the last filled with zeros."""
    flat = matrix.ravel()
    return np.append(flat, np.zeros(-len(flat) % width)).reshape(-1, width)


def _item_rows(model, subjects, m, c):
    def run(batches):
        for batch in batches:
            for part, answers in _pieces(model, subjects, batch):
                beta = _fit_items(model, answers)[0]
                yield pd.DataFrame({"item_id": part.column("item_id").to_numpy(zero_copy_only=False),
                                    "beta": list(beta @ m + c)})
    return run


def _in_arrow(run, **columns):
    """`run` from Arrow batches, whose lists need not be taken apart, to Arrow batches."""
    def out(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, pa.schema(columns), preserve_index=False)
    return out


def _fitted_items(packed, model, found, m, c):
    run = _in_arrow(_item_rows(model, found, m, c), item_id=pa.string(), beta=pa.list_(pa.float64()))
    return packed.select("item_id", "who", "ys").mapInArrow(run, "item_id string, beta array<double>")


def pack_for_fit(responses):
    """(packed, names): one row per item with subject numbers `who` and answers `ys`.

    The subjects' names come to the driver, which holds their parameters between passes.
    """
    spark = responses.sparkSession
    known = responses.filter(F.col("y").isNotNull())
    names = sorted(r[0] for r in known.select("subject").distinct().limit(
        FIT_SUBJECTS + 1).collect())
    if len(names) > FIT_SUBJECTS:
        raise ValueError(f"the fits are limited to {FIT_SUBJECTS} subjects")
    roster = local_table(spark, [(n, i) for i, n in enumerate(names)],
                         {"subject": pa.string(), "idx": pa.int32()})
    # files of equal size, a multiple of the cores: every pass ends with its slowest task
    packed = known.join(roster, "subject").repartition(
        4 * spark.sparkContext.defaultParallelism, "item_id").groupBy("item_id").agg(
        F.collect_list("idx").alias("who"), F.collect_list("y").alias("ys"))
    return written(packed, "packed-answers"), names


def _climb(packed, model, subjects):
    """Value, gradient, Hessian blocks and, for few subjects, the whole negative Hessian of the
    penalized likelihood at these subjects."""
    size, r = subjects.shape
    width = r + r * r
    whole = np.zeros((-(-(size * r) ** 2 // width), width)) if size * r <= WHOLE_PARAMETERS else None
    run = _in_arrow(_subject_sums(model, subjects), idx=pa.int32(), row=pa.list_(pa.float64()))
    rows = packed.select("who", "ys").mapInArrow(run, "idx int, row array<double>")
    total, value = np.zeros((len(subjects), width)), 0.0
    for s in rows.groupBy("idx").agg(
            F.array(*[F.sum(F.col("row")[j]) for j in range(width)]).alias("row")).collect():
        if s["idx"] < 0:
            value = s["row"][0]
        elif s["idx"] < size:
            total[s["idx"]] = s["row"]
        else:
            whole[s["idx"] - size] = s["row"]
    away = subjects - model.subject_prior
    value -= np.sum(model.subject_penalty * away ** 2) / 2
    blocks = total[:, r:].reshape(-1, r, r) + np.diag(model.subject_penalty)
    if whole is not None:
        whole = -whole.ravel()[:(size * r) ** 2].reshape(size, r, size, r)
        whole[np.arange(size), :, np.arange(size)] += blocks
        whole = whole.reshape(size * r, size * r)
    return value, total[:, :r] - model.subject_penalty * away, blocks, whole


def _newton(g, whole, radius):
    """(direction, promised rise, whether the likelihood is concave here) of the Newton step.

    It is at most `radius` long along each axis of the Hessian. Where the likelihood is not concave
    it climbs, and where it is flat it stays.
    """
    values, axes = np.linalg.eigh((whole + whole.T) / 2)
    slope, size = axes.T @ g.ravel(), np.abs(values)
    least = 1e-9 * size.max()
    share = np.clip(np.divide(slope, size, out=np.zeros_like(size), where=size > least), -radius, radius)
    return ((axes @ share).reshape(g.shape), np.sum(share * slope - values * share ** 2 / 2),
            values[0] >= -least)


def _uphill(g, h, steps):
    """A limited-memory quasi-Newton direction, from the Hessian blocks and the last steps."""
    q, used = g.copy(), []
    for moved, turned in reversed(steps):
        share = np.sum(moved * q) / np.sum(moved * turned)
        q -= share * turned
        used.append(share)
    q = _solve(h, q)
    for (moved, turned), share in zip(steps, reversed(used)):
        q += (share - np.sum(turned * q) / np.sum(moved * turned)) * moved
    return q


def _fit(packed, model, start, max_sweeps, tol):
    """Subjects at which the scores vanish: a Newton step by blocks moves none of them by `tol`.

    The first steps are quasi-Newton ones, which choose the hill. Once the likelihood was concave
    around a point, or QUASI_PASSES are over, Newton steps end the climb where the whole Hessian is
    known; their radius follows how well they keep what they promise. A step is taken only if the
    likelihood rises, and made smaller until it does. Raises where `max_sweeps` passes are not enough.
    """
    subjects, steps, radius, newton = start, [], 1.0, False
    value, g, h, whole = _climb(packed, model, subjects)
    passes = 1
    while (left := np.abs(_solve(h, g)).max(initial=0)) >= tol:
        if whole is not None:
            move, promised, concave = _newton(g, whole, radius)
            newton = newton or concave or passes >= QUASI_PASSES
        if not newton:
            move = _uphill(g, h, steps)
            if np.sum(move * g) <= 0:
                move, steps = _solve(h, g), []
            longest = max(1.0, model.stride * np.sqrt(np.mean((subjects - model.subject_prior) ** 2)))
            move = move / max(1.0, np.abs(move).max() / longest)
        size = 1.0
        while True:
            if passes >= max_sweeps:
                raise RuntimeError(f"no convergence in {max_sweeps} passes: a step still moves "
                                   f"{left:.2g}, the tolerance is {tol:.2g}")
            tried, passes = _climb(packed, model, subjects + size * move), passes + 1
            wanted = 0.1 * promised if newton else 1e-4 * size * np.sum(move * g)
            if tried[0] >= value + wanted - 1e-11 * abs(value):
                break
            if newton:
                radius = min(radius, np.abs(move).max()) / 4
                move, promised, _ = _newton(g, whole, radius)
            else:
                size /= 2
        if newton and tried[0] - value > 0.6 * promised:
            radius *= 2
        turned = g - tried[1]
        if np.sum(turned * move) > 0:
            steps = [*steps[1 - REMEMBERED_STEPS:], (size * move, turned)]
        subjects = subjects + size * move
        value, g, h, whole = tried
    if whole is not None and left >= tol / 100:    # a last Newton step needs no pass; held short where it is flat
        move, _, concave = _newton(g, whole, 10 * tol)
        subjects = subjects + move if concave else subjects
    return subjects


def _start_abilities(responses, names):
    means = {r["subject"]: r["t"] for r in responses.groupBy("subject").agg(
        safe_logit(F.avg("y")).alias("t")).collect()}
    theta = np.array([means[n] for n in names])
    return (theta - theta.mean())[:, None]


def rasch_fit(responses, max_sweeps=300, tol=1e-6):
    """Joint maximum likelihood of the 1PL model; abilities have mean zero.

    Returns (subjects, items): columns subject, ability and item_id, difficulty.
    """
    packed, names = pack_for_fit(responses)
    model = OnePL()
    found = _fit(packed, model, _start_abilities(responses, names), max_sweeps, tol)
    s, m, c = model.fixed(found)
    items = _fitted_items(packed, model, found, m, c)
    subjects = local_table(responses.sparkSession, zip(names, s[:, 0]),
                           {"subject": pa.string(), "ability": pa.float64()})
    return subjects, items.select("item_id", F.col("beta")[0].alias("difficulty"))


def twopl_fit(responses, max_sweeps=300, tol=1e-5):
    """Penalized 2PL fit; abilities have mean zero and unit spread, discriminations centre on 1.

    Returns (subjects, items) with discrimination and difficulty per item.
    """
    packed, names = pack_for_fit(responses)
    model = TwoPL()
    start = _start_abilities(responses, names)
    start = start / max(start.std(), 1e-6)
    found = _fit(packed, model, start, max_sweeps, tol)
    s, m, c = model.fixed(found)
    items = _fitted_items(packed, model, found, m, c)
    subjects = local_table(responses.sparkSession, zip(names, s[:, 0]),
                           {"subject": pa.string(), "ability": pa.float64()})
    a, d = F.col("beta")[0], F.col("beta")[1]
    return subjects, items.select("item_id", a.alias("discrimination"),
                                  F.try_divide(-d, a).alias("difficulty"))


def kfactor_fit(responses, k, start_loadings, max_sweeps=300, tol=1e-5):
    """Ridge-penalized logistic factor model with a subject bias.

    `start_loadings` has columns subject and u (array), as `factor_subjects` returns them.
    Returns (subjects, items): subject, bias, factor_1.. and item_id, factor_1...
    """
    packed, names = pack_for_fit(responses)
    model = KFactor(k)
    loads = {r["subject"]: list(r["u"])[:k] for r in start_loadings.select("subject", "u").collect()}
    u = np.array([loads.get(n, []) + [0.0] * (k - len(loads.get(n, []))) for n in names])
    u = u / np.maximum(np.sqrt(np.mean(u ** 2, axis=0)), 1e-6)
    start = np.hstack([_start_abilities(responses, names), u])
    found = _fit(packed, model, start, max_sweeps, tol)
    s, m, c = model.fixed(found)
    items = _fitted_items(packed, model, found, m, c)
    columns = {"subject": pa.string(), "bias": pa.float64(),
               **{f"factor_{i + 1}": pa.float64() for i in range(k)}}
    subjects = local_table(responses.sparkSession, [(n, *row) for n, row in zip(names, s)], columns)
    return subjects, items.select("item_id", *[
        F.col("beta")[i].alias(f"factor_{i + 1}") for i in range(k)])


def factor_table(subjects, responses, n_items, k):
    """Fitted factors with totals, in the layout of the K-factor artifacts."""
    totals = responses.groupBy("subject").agg(
        F.sum("y").cast("long").alias("correct"), F.count("y").alias("observed_total"))
    out = subjects.join(totals, "subject")
    return out.select(
        F.lit(k).alias("k_factors"), F.col("subject").alias("model"), "bias",
        *[f"factor_{i + 1}" for i in range(k)], "correct", "observed_total",
        (F.lit(n_items).cast("long") - F.col("observed_total")).alias("missing_total"),
        (F.col("observed_total") / F.lit(float(n_items))).alias("coverage"),
        F.try_divide("correct", "observed_total").alias("accuracy"))
