"""Answers to items never seen: predict item parameters from metadata, test on held-out items.

Every seed is a `split` value, so one pass serves all of them, and one fit per split at the
largest factor count serves every K. Answers are packed once to one row per item (an item holds
at most one answer per subject); from there on, work is done per item row and only sums over
subjects, design columns or grid points are shuffled.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F

from itemscope.functions.scalar import (
    rasch_probability, safe_logit, sigmoid, standardized_residual)
from itemscope.operators.design import design_entries, encode_features, partial_rows, sum_rows
from itemscope.operators.performance import binary_metrics
from itemscope.operators.ranks import hash_positions
from itemscope.operators.residuals import collected_rows, factor_subjects, spanned, spanned_factors
from itemscope.operators.responses import require_metadata
from itemscope.session import local_table, written

# The grid of factor scales, from -2 to 2 in 161 steps.
GRID_POINTS, GRID_START, GRID_STEP = 161, -2.0, 0.025
_COARSE = 10
# Answers per packed list.
PACKED = 65_536
# Design columns of a block whose equations are inverted together.
BLOCK_COLUMNS = 512
# Fixed value: factors kept at least.
MIN_FACTORS = 8
ITEM_MEAN = "oracle_item_mean_not_coldstart"
SUBJECT_MEAN = "model_mean_only"


def method_name(k):
    return "feature_1pl_b_only_K0" if k == 0 else f"feature_K{k}_b_plus_loading"


def held_out_items(observed, seeds, test_size, min_observed):
    """Rows (split, item_id): per seed, the `test_size` eligible items with the smallest hash.

    `observed` has item_id and its number of answers `n_observed`.
    """
    eligible = observed.filter(F.col("n_observed") >= min_observed).select("item_id")
    n = eligible.count()
    if n < test_size:
        raise ValueError(f"only {n} eligible items, fewer than test_size={test_size}")
    drawn = eligible.select("item_id", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))
                            .alias("split"))
    key = F.concat(F.col("split").cast("string"), F.lit(":"), F.col("item_id"))
    return hash_positions(drawn, ["split"], key, first=test_size).select("split", "item_id")


def pack_items(responses, n_subjects):
    """Answers packed as `obs` rows per item, with the item's mean answer and number of answers.

    Up to PACKED subjects an item is one row (part 0). More subjects are dealt by hash to as many
    parts as keep each list near that size.
    """
    known = responses.filter(F.col("y").isNotNull())
    parts = -(-n_subjects // PACKED)
    lists = F.collect_list(F.struct("subject", "y")).alias("obs")
    if parts <= 1:
        return known.groupBy("item_id").agg(
            lists, F.avg("y").alias("item_mean"), F.count("y").alias("n_observed")).withColumn(
            "part", F.lit(0))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("subject"), F.lit(parts)).cast("int"))
    dealt = dealt.groupBy("item_id", "part").agg(
        lists, F.sum("y").alias("s"), F.count("y").alias("n"))
    whole = known.groupBy("item_id").agg(
        F.avg("y").alias("item_mean"), F.count("y").alias("n_observed"))
    # parts are numbered from 0 per item, so that part 0 stands for the item
    number = F.dense_rank().over(Window.partitionBy("item_id").orderBy("part")) - 1
    return dealt.withColumn("part", number).join(whole, "item_id").select(
        "item_id", "obs", "item_mean", "n_observed", "part")


def _train_splits(seeds):
    return F.array_except(F.array(*[F.lit(int(s)) for s in seeds]), F.col("test_splits"))


def subject_totals(responses):
    return responses.groupBy("subject").agg(F.sum("y").alias("s"), F.count("y").alias("n")).filter(
        F.col("n") > 0)


def split_parameters(items, total, seeds):
    """Rows (split, subject, model_mean, theta, b_center) from the train items of every split.

    Train sums are the totals minus the sums of the few held-out items.
    """
    cells = items.filter(F.size("test_splits") > 0).select("test_splits", F.explode("obs").alias("o"))
    held = cells.select(F.explode("test_splits").alias("split"), "o").groupBy(
        "split", "o.subject").agg(F.sum("o.y").alias("hs"), F.count(F.lit(1)).alias("hn"))
    every = F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("split")
    means = total.select("subject", "s", "n", every).join(held, ["split", "subject"], "left")
    means = means.select("split", "subject", F.try_divide(
        F.col("s") - F.coalesce("hs", F.lit(0)),
        (F.col("n") - F.coalesce("hn", F.lit(0))).cast("double")).alias("model_mean"))
    means = means.withColumn("raw", safe_logit("model_mean"))
    centre = means.groupBy("split").agg(F.avg("raw").alias("theta_center"))
    raw_b = items.filter(F.col("part") == 0).select("test_splits", (-safe_logit("item_mean")).alias("b"))
    b_centre = raw_b.select("b", F.explode(_train_splits(seeds)).alias("split")).groupBy(
        "split").agg(F.avg("b").alias("b_center"))
    return means.join(centre, "split").join(b_centre, "split").select(
        "split", "subject", "model_mean", (F.col("raw") - F.col("theta_center")).alias("theta"),
        "b_center")


def train_residuals(items, params, seeds):
    """Rows (split, item_id, subject, b, z) for the train items of every split."""
    cells = items.select("item_id", (-safe_logit("item_mean")).alias("b"), "obs",
                         F.explode(_train_splits(seeds)).alias("split"))
    cells = cells.select("split", "item_id", "b", F.explode("obs").alias("o")).select(
        "split", "item_id", "b", "o.subject", "o.y")
    joined = cells.join(params.select("split", "subject", "theta", "b_center"),
                        ["split", "subject"])
    b = F.col("b") - F.col("b_center")
    return joined.select("split", "item_id", "subject", b.alias("b"), standardized_residual(
        "y", rasch_probability(F.col("theta"), b)).alias("z"))


def item_targets(z, factors, kmax):
    """Rows (split, item_id, t): difficulty, then the item's loading on each factor."""
    cells = z.join(factors.select("split", "subject", "u", "s"), ["split", "subject"])
    part = lambda i: F.sum(F.when(
        F.get("s", F.lit(i)) > 1e-9,
        F.col("z") * F.get("u", F.lit(i)) / F.get("s", F.lit(i))).otherwise(0.0))
    sums = cells.groupBy("split", "item_id").agg(
        F.max("b").alias("b"), *[part(i).alias(f"v{i}") for i in range(kmax)])
    return sums.select("split", "item_id",
                       F.array("b", *[f"v{i}" for i in range(kmax)]).alias("t"))


class _Few:
    """Numbers of a few subjects as arrays by split, for tasks that hold whole items."""

    def __init__(self, params, seeds, kmax):
        rows = params.collect()    # a row for each split and subject
        self.names = sorted({r["subject"] for r in rows if r["subject"] is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.seeds, self.kmax = seeds, kmax
        self.theta = {s: np.full(len(number), np.nan) for s in seeds}
        self.u = {s: np.zeros((len(number), kmax)) for s in seeds}
        self.scale = {s: np.zeros(kmax) for s in seeds}
        self.b_center = dict.fromkeys(seeds, np.nan)
        for r in (r.asDict() for r in rows if r["subject"] is not None):
            split, i = r["split"], number[r["subject"]]
            self.theta[split][i] = np.nan if r["theta"] is None else r["theta"]
            self.b_center[split] = r.get("b_center") if r.get("b_center") is not None else np.nan
            loads = (r.get("u") or [])[:kmax]
            self.u[split][i, :len(loads)] = loads
            sizes = (r.get("s") or [])[:kmax]
            self.scale[split][:len(sizes)] = sizes

    def cells(self, batch):
        """Row, subject number and answer of every packed answer of a known subject."""
        lists = batch.column("obs")
        flat = lists.flatten()
        row = lists.value_parent_indices().to_numpy(zero_copy_only=False)
        who = pc.fill_null(pc.index_in(flat.field("subject"), pa.array(self.names, pa.string())), -1).to_numpy()
        y = flat.field("y").to_numpy(zero_copy_only=False).astype(float)
        known = who >= 0
        return row[known], who[known], y[known]

    def train(self, batch, split):
        """Whether each row is a train item of `split`."""
        held = np.zeros(len(batch), bool)
        lists = batch.column("test_splits")
        held[lists.value_parent_indices().to_numpy(zero_copy_only=False)[
            lists.flatten().to_numpy(zero_copy_only=False) == split]] = True
        return ~held

    def residuals(self, batch):
        """(split, difficulties, residuals as a dense block, their squares' sums, their numbers) per split."""
        row, who, y = self.cells(batch)
        mean = np.clip(batch.column("item_mean").to_numpy(zero_copy_only=False), 1e-4, 1 - 1e-4)
        raw = -np.log(mean / (1 - mean))
        for split in self.seeds:
            here = self.train(batch, split)[row] & ~np.isnan(self.theta[split][who])
            r, w = row[here], who[here]
            b = raw - self.b_center[split]
            p = 1 / (1 + np.exp(-(self.theta[split][w] - b[r])))
            z = (y[here] - p) / np.sqrt(np.maximum(p * (1 - p), 1e-4))
            dense = np.zeros((len(batch), len(self.names)))
            np.add.at(dense, (r, w), z)
            yield split, b, dense, np.bincount(r, z * z, len(batch)), np.bincount(r, minlength=len(batch))


def few_subject_factors(items, params, subjects, seeds, kmax):
    """`factor_subjects` of the train residuals where the subjects are few: rows (split, subject, u, s, total).

    Items are whole rows, so each task works out their residuals, adds up the subjects' Gram matrix
    and forgets them: they are neither written nor moved.
    """
    few = _Few(params, seeds, kmax)
    n = len(few.names)

    def run(batches):
        sums = {}
        for batch in batches:
            for split, _, dense, squares, number in few.residuals(batch):
                part = np.zeros((n + 2, n))    # two more rows for the sum of squares and the items
                part[:n] = dense.T @ dense
                part[n, 0], part[n + 1, 0] = squares.sum(), np.count_nonzero(number)
                sums[split] = sums.get(split, 0.0) + part
        yield from partial_rows(sums)
    found = collected_rows(sum_rows(items.select("obs", "item_mean", "test_splits").mapInArrow(
        run, "split int, i int, row array<double>"), ["split", "i"]))
    found = {s: m for s, m in found.items() if m[n + 1, 0]}
    names = few.names + [r["subject"] for r in subjects.filter("subject is null").select(
        "subject").distinct().collect()]
    return spanned_factors(items.sparkSession, {s: m[:n] for s, m in found.items()}, names, kmax, {
        s: {"total": m[n, 0], "items": int(m[n + 1, 0])} for s, m in found.items()})


def few_subject_targets(items, params, factors, seeds, kmax):
    """`item_targets` of few subjects: rows (split, item_id, t), each made in its item's task."""
    few = _Few(params.join(factors, ["split", "subject"], "left"), seeds, kmax)

    def run(batches):
        for batch in batches:
            for split, b, dense, _, number in few.residuals(batch):
                s = few.scale[split]
                share = np.divide(few.u[split], s, out=np.zeros_like(few.u[split]),
                                  where=np.broadcast_to(s > 1e-9, few.u[split].shape))
                here = np.flatnonzero(number)
                t = np.hstack([b[:, None], dense @ share])[here]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(here), split), pa.int32()), batch.column("item_id").take(pa.array(here)),
                     pa.array(list(t), pa.list_(pa.float64()))], ["split", "item_id", "t"])
    return items.select("item_id", "obs", "item_mean", "test_splits").mapInArrow(
        run, "split int, item_id string, t array<double>")


def _few_subject_losses(predicted, params, ks, seeds, kmax):
    """What `_mean_losses` gives, added up in the tasks that hold the items of few subjects."""
    few = _Few(params, seeds, kmax)

    def mean(stride, count, low=None):
        begin = {} if low is None else {(r["split"], r["k"]): r["low"] for r in low.collect()}

        def run(batches):
            sums = {}
            for batch in batches:
                row, who, y = few.cells(batch)
                pred = np.array(batch.column("pred").to_pylist(), float).reshape(len(batch), -1)
                for at, split in enumerate(seeds):
                    here = few.train(batch, split)[row] & ~np.isnan(few.theta[split][who])
                    if not here.any():
                        continue
                    r, w, answers = row[here], who[here], y[here]
                    t = pred[:, at * (kmax + 1):(at + 1) * (kmax + 1)]
                    base = few.theta[split][w] - t[r, 0]
                    for k in ks:
                        f = (t[:, 1:k + 1] @ few.u[split][:, :k].T)[r, w]
                        total = sums.setdefault((split, k), np.zeros(count + 1))
                        total[count] += len(r)
                        for i in range(count):
                            c = (begin.get((split, k), 0) + i * stride) * GRID_STEP + GRID_START
                            eta = base + c * f
                            total[i] += np.sum(np.maximum(eta, 0)) + np.sum(
                                np.log(1 + np.exp(-np.abs(eta)))) - answers @ eta
            yield pa.RecordBatch.from_pydict({
                "split": pa.array([s for s, _ in sums], pa.int32()), "k": pa.array([k for _, k in sums], pa.int32()),
                "row": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})
        sums = sum_rows(predicted.select("obs", "test_splits", "pred").mapInArrow(
            run, "split int, k int, row array<double>"), ["split", "k"])
        sums = sums.withColumn("low", F.lit(0)) if low is None else sums.join(low, ["split", "k"])
        return sums.select("split", "k", "low", *[
            (F.col("row")[i] / F.col("row")[count]).alias(f"l{i}") for i in range(count)])
    return mean


def _gram(design, seeds):
    """Rows (split, i, j, g): train sums of the products of two design columns, where any item has both.

    A split's sum is that of all items minus that of its few held-out ones. A pair of columns is
    added up within tasks first, and only pairs that occur together exist.
    """
    pairs = design.select("test_splits", "row", F.explode("row").alias("l")).select(
        "test_splits", "l", F.explode(F.filter("row", lambda e: e["i"] >= F.col("l")["i"])).alias("r"))
    product = F.col("l.a") * F.col("r.a")
    held = [F.sum(F.when(F.array_contains("test_splits", s), product).otherwise(0.0)) for s in seeds]
    sums = pairs.groupBy(F.col("l.i").alias("i"), F.col("r.i").alias("j")).agg(
        F.sum(product).alias("every"), F.array(*held).alias("held"))
    names = F.array(*[F.lit(s) for s in seeds])
    half = sums.select("i", "j", "every", F.explode(F.arrays_zip(
        names.alias("split"), F.col("held"))).alias("h")).select(
        "h.split", "i", "j", (F.col("every") - F.col("h.held")).alias("g"))
    half = written(half, "gram-half")
    other = half.filter("i < j").select("split", F.col("j").alias("i"), F.col("i").alias("j"), "g")
    return written(half.unionByName(other), "gram")


def _scaling(design, seeds, gram, alpha, width):
    """Rows (split, i, e, f): what scales a column of the design, and its penalty at that scale.

    Columns have unit deviation over all items, as the penalty sees them. On top of that they are
    scaled to a unit diagonal of the normal equations, which changes the steps, not the solution.
    """
    each = design.select(F.explode("row").alias("e")).groupBy("e.i").agg(
        F.sum("e.a").alias("sum"), F.sum(F.col("e.a") * F.col("e.a")).alias("square"))
    n = F.lit(float(design.count()))
    mean = F.col("sum") / n
    var = F.col("square") / n - mean * mean
    own = each.select("i", F.when(F.col("i") == width, 1.0).otherwise(F.when(
        var > 1e-12 * F.greatest(F.lit(1.0), mean * mean), 1 / F.sqrt(var)).otherwise(1.0)).alias("d"))
    size = gram.filter("i = j").join(own, "i")
    penalty = F.when(F.col("i") == width, 0.0).otherwise(float(alpha))
    whole = F.col("g") * F.col("d") * F.col("d") + penalty
    scale = F.when(whole > 0, 1 / F.sqrt(whole)).otherwise(0.0)
    return size.select("split", "i", (F.col("d") * scale).alias("e"), (penalty * scale * scale).alias("f"))


def _block(encoding):
    """Number of the block that the design column `i` belongs to.

    Columns count from the intercept and the numbers on to the categorical columns with the fewest
    levels first, so that those which most items have share a block.
    """
    sizes = [len(labels) + 1 for labels in encoding.levels]
    place = F.lit(encoding.width) - F.col("i")    # the intercept and the numbers
    begin = encoding.width - encoding.first_number + 1
    for size, offset in sorted(zip(sizes, encoding.offsets)):
        inside = (F.col("i") >= offset) & (F.col("i") < offset + size)
        place = F.when(inside, F.col("i") - offset + begin).otherwise(place)
        begin += size
    return F.floor(place / BLOCK_COLUMNS).cast("int")


def _inverted(key, pdf):
    """The entries of a block's inverse, as rows (split, i, j, g), without its zeros."""
    names, at = np.unique(pdf["i"].to_numpy(), return_inverse=True)
    matrix = np.zeros((len(names), len(names)))
    matrix[at, np.searchsorted(names, pdf["j"].to_numpy())] = pdf["g"].to_numpy()
    inverse = np.linalg.inv(matrix)
    inverse = (inverse + inverse.T) / 2
    row, column = np.nonzero(inverse)
    return pd.DataFrame({"split": np.full(len(row), key[0]), "i": names[row], "j": names[column],
                         "g": inverse[row, column]})


def _block_inverses(gram, scaling, encoding):
    """Rows (split, i, j, g) of the inverses of the diagonal blocks of the scaled normal equations.

    A block has at most `BLOCK_COLUMNS` columns, so its matrix is small whatever their number.
    """
    mine = scaling.withColumn("block", _block(encoding))
    other = mine.select("split", F.col("i").alias("j"), F.col("e").alias("ej"), "block")
    inside = gram.join(mine, ["split", "i"]).join(other, ["split", "j", "block"])
    g = F.col("g") * F.col("e") * F.col("ej") + F.when(F.col("i") == F.col("j"), F.col("f")).otherwise(0.0)
    own = F.when((F.col("i") == F.col("j")) & (F.col("e") == 0), 1.0).otherwise(g)    # an empty column
    return inside.select("split", "block", "i", "j", own.alias("g")).groupBy("split", "block").applyInPandas(
        _inverted, "split int, i int, j int, g double")


def _plus(column, other, factor):
    """The array `column` plus the array `other` times the array `factor`."""
    return F.zip_with(column, F.zip_with(other, factor, lambda a, b: a * b), lambda a, b: a + b)


def _times(matrix, vectors, name, width):
    """Rows (split, i, name): the matrix of rows (split, i, j, g) times the arrays `name` by (split, i)."""
    steps = matrix.join(vectors.select("split", F.col("i").alias("j"), name), ["split", "j"])
    sums = steps.groupBy("split", "i").agg(
        *[F.sum(F.col("g") * F.col(name)[k]).alias(f"s{k}") for k in range(width)])
    return sums.select("split", "i", F.array(*[f"s{k}" for k in range(width)]).alias(name))


def ridge_coefficients(design, targets, encoding, seeds, alpha, tolerance=1e-11, max_rounds=5000):
    """Rows (i, w): per design column the coefficients of all targets, one split after the other.

    Ridge regression on columns of unit deviation with a free intercept, the column
    `encoding.width`. The normal equations are never solved as one dense matrix: they are rows, and
    conjugate gradients multiply them by a row of numbers for each column. Steps are preconditioned
    by the inverses of the diagonal blocks of `BLOCK_COLUMNS` columns, so that a design of one block
    needs hardly more than one step, and a wider one only as many as its blocks are entangled. All
    splits and targets take their steps together; per step only a few sums for each reach the driver.
    Raises where residuals, weighed by the blocks' inverses, do not fall below `tolerance` of the
    right-hand side. Columns without any item have no row.
    """
    gram = _gram(design, seeds)
    width = targets.first()
    if width is None:
        raise ValueError("there are no items to learn from")
    width = len(width["t"])
    numbers = range(width)
    products = targets.join(design.select("item_id", "row"), "item_id").select(
        "split", "t", F.explode("row").alias("e")).groupBy("split", F.col("e.i").alias("i")).agg(
        *[F.sum(F.col("e.a") * F.col("t")[k]).alias(f"t{k}") for k in numbers])
    scaling = written(_scaling(design, seeds, gram, alpha, encoding.width), "ridge-scaling")
    blocks = written(_block_inverses(gram, scaling, encoding), "ridge-blocks")
    # the equations in scaled columns, penalty included
    at_j = scaling.select("split", F.col("i").alias("j"), F.col("e").alias("ej"))
    penalty = F.when(F.col("i") == F.col("j"), F.col("f")).otherwise(0.0)
    equations = written(gram.join(scaling, ["split", "i"]).join(at_j, ["split", "j"]).select(
        "split", "i", "j", (F.col("g") * F.col("e") * F.col("ej") + penalty).alias("g")), "equations")
    zero = F.array_repeat(F.lit(0.0), width)
    right = F.array(*[F.coalesce(F.col(f"t{k}"), F.lit(0.0)) * F.col("e") for k in numbers])
    state = written(scaling.join(products, ["split", "i"], "left").select(
        "split", "i", "e", zero.alias("x"), right.alias("r")), "ridge-right")
    # z is the residual times the blocks' inverses, p the direction
    state = written(state.join(_times(blocks, state.withColumnRenamed("r", "z"), "z", width),
                               ["split", "i"]).withColumn("p", F.col("z")), "ridge-state")
    dot = lambda a, b: F.array(*[F.sum(F.col(a)[k] * F.col(b)[k]) for k in numbers]).alias(a + b)
    limit = None
    for _ in range(max_rounds):
        image = written(_times(equations, state.withColumnRenamed("p", "y").select("split", "i", "y"),
                               "y", width), "ridge-image")
        turned = _times(blocks, image.withColumnRenamed("y", "q"), "q", width)
        state = written(state.join(image, ["split", "i"]).join(turned, ["split", "i"]), "ridge-step")
        sums = state.groupBy("split").agg(
            dot("r", "z"), dot("p", "y"), dot("r", "q"), dot("y", "z"), dot("y", "q")).collect()
        limit = limit or {s["split"]: [tolerance ** 2 * v for v in s["rz"]] for s in sums}
        moves, done = [], True
        for s in sums:    # a row for each split
            far, near, turn = [], [], []
            for k in numbers:
                going = s["rz"][k] > limit[s["split"]][k] and s["py"][k] > 0
                a = s["rz"][k] / s["py"][k] if going else 0.0
                left = max(s["rz"][k] - a * (s["rq"][k] + s["yz"][k]) + a * a * s["yq"][k], 0.0)
                far.append(a)
                near.append(-a)
                turn.append(left / s["rz"][k] if going else 0.0)
                done = done and not going
            moves.append((s["split"], far, near, turn))
        if done:
            break
        arrays = pa.list_(pa.float64())
        moves = local_table(gram.sparkSession, moves, {
            "split": pa.int32(), "far": arrays, "near": arrays, "turn": arrays})
        state = written(state.join(moves, "split").withColumn("x", _plus("x", "p", "far")).withColumn(
            "r", _plus("r", "y", "near")).withColumn("z", _plus("z", "q", "near")).withColumn(
            "p", _plus("z", "p", "turn")).select("split", "i", "e", "x", "r", "z", "p"), "ridge-state")
    else:
        raise RuntimeError(f"the ridge has not settled after {max_rounds} rounds")
    place = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("split"))
    w = F.transform("x", lambda v: v * F.col("e"))
    return state.groupBy("i").agg(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct(place.alias("place"), w.alias("w")))), lambda s: s["w"])).alias("w"))


def predicted_targets(design, coefficients, width):
    """Rows (item_id, pred): an item's predicted targets of all splits, one after the other."""
    entries = design.select("item_id", F.explode("row").alias("e")).select(
        "item_id", F.col("e.i").alias("i"), F.col("e.a").alias("a"))
    return entries.join(coefficients, "i").groupBy("item_id").agg(
        F.array(*[F.sum(F.col("a") * F.col("w")[k]) for k in range(width)]).alias("pred"))


def _with_prediction(predicted, splits, seeds, kmax):
    """Explode an item row to the given splits; `t` holds that split's predicted targets."""
    number = F.create_map(*[x for i, s in enumerate(seeds) for x in (F.lit(int(s)), F.lit(i))])
    rows = predicted.select("item_id", "obs", "item_mean", "pred", F.explode(splits).alias("split"))
    return rows.select("split", "item_id", "obs", "item_mean", F.slice(
        "pred", F.try_element_at(number, F.col("split")) * (kmax + 1) + 1, kmax + 1).alias("t"))


def _scored_cells(rows, params, ks):
    """Cells with log-odds `eta` of the difficulty part and the factor sums `f` for each K > 0."""
    cells = rows.select("split", "item_id", "item_mean", "t", F.explode("obs").alias("o")).select(
        "split", "item_id", "item_mean", "t", "o.subject", "o.y")
    cells = cells.join(params, ["split", "subject"])

    def factor_sum(k):
        terms = [F.coalesce(F.get("u", F.lit(i)), F.lit(0.0)) * F.col("t")[i + 1] for i in range(k)]
        return sum(terms[1:], terms[0])
    return cells.select(
        "split", "item_id", "subject", "y", "item_mean", "model_mean",
        F.col("t")[0].alias("b_hat"), (F.col("theta") - F.col("t")[0]).alias("eta"),
        F.array(*[F.struct(F.lit(k).alias("k"), factor_sum(k).alias("f")) for k in ks])
        .alias("fs") if ks else F.array().cast("array<struct<k:int,f:double>>").alias("fs"))


def _mean_losses(cells):
    """A function of (stride, count, low) that gives rows (split, k, low, l0, l1..): the mean train
    log-loss at `count` grid numbers low, low + stride.. `low` is a table (split, k, low); without it
    the grid starts at 0."""
    def mean(stride, count, low=None):
        rows = cells.select("split", "y", "eta", F.explode("fs").alias("kf")).select(
            "split", "y", "eta", "kf.k", "kf.f")
        rows = rows.withColumn("low", F.lit(0)) if low is None else rows.join(low, ["split", "k"])

        def loss(i):
            eta = f"(eta + ((low + {i * stride}) * {GRID_STEP}D + {GRID_START}D) * f)"
            return F.expr(f"avg(greatest({eta}, 0D) + log1p(exp(-abs({eta}))) - y * {eta}) as l{i}")
        return rows.groupBy("split", "k", "low").agg(*[loss(i) for i in range(count)])
    return mean


def _best_of_grid(mean, stride, count, low=None):
    """Per (split, k): the first of `count` grid numbers low, low + stride.. with the least mean loss."""
    points = ", ".join(f"struct(l{i} as loss, low + {i * stride} as g)" for i in range(count))
    inside = F.expr(f"filter(array({points}), s -> s.g < {GRID_POINTS})")
    return mean(stride, count, low).select("split", "k", F.array_min(inside)["g"].alias("g"))


def factor_scales(mean):
    """Rows (split, k, c): the first grid point with the least train loss.

    The loss is convex in c, so a coarse pass brackets the least point and a fine pass over the
    bracket finds it: two passes over 36 points in place of one over 161.
    """
    coarse = _best_of_grid(mean, _COARSE, (GRID_POINTS - 1) // _COARSE + 1)
    low = F.greatest(F.col("g") - (_COARSE - 1), F.lit(0))
    low = written(coarse.select("split", "k", low.alias("low")), "bracket")
    fine = _best_of_grid(mean, 1, 2 * _COARSE - 1, low)
    return fine.select("split", "k", (F.col("g") * F.lit(GRID_STEP) + F.lit(GRID_START)).alias("c"))


class ColdStart:
    """Tables of a cold-start experiment: every attribute is a DataFrame.

    `cells` holds the held-out answers with the probability of each K, `metrics_by_split`,
    `diagnostics_by_split`, `summary` and `diagnostics_summary` the evaluation.
    """

    def __init__(self, cells, ks, alpha, test_size, scales):
        self.cells, self.ks, self.scales = cells, list(ks), scales
        self.metrics_by_split = _metrics_by_split(cells, ks, alpha, test_size, scales)
        self.diagnostics_by_split = _diagnostics(cells, ks, test_size, scales)
        self.summary = summarize_metrics(self.metrics_by_split)
        self.diagnostics_summary = summarize_diagnostics(self.diagnostics_by_split)

    def predictions(self, seed, k):
        """The held-out answers of one split with the three predicted probabilities."""
        here = self.cells.filter(F.col("split") == seed)
        return here.select(
            "item_id", F.col("subject").alias("model"), F.col("y").alias("observed_response"),
            F.try_element_at("p", F.lit(k)).alias("p_K_coldstart"),
            sigmoid("eta").alias("p_feature_1pl"), F.col("model_mean").alias("p_model_mean"))


def run_cold_start(responses, flat, seeds=(2026, 2027, 2028, 2029, 2030), ks=(0, 1, 2, 4, 8),
                   test_size=500, alpha=10.0, min_observed=10, encoded=None):
    """Hold out whole items per seed, learn metadata -> item parameters, predict their answers.

    `encoded`, the result of `encode_features(flat)`, spares encoding the same metadata again.
    Answers to an item that `flat` lacks are an error.
    """
    require_metadata(responses, flat)
    seeds, ks = [int(s) for s in seeds], [int(k) for k in ks]
    if not seeds or not ks or test_size <= 0:
        raise ValueError("seeds and ks must be given and test_size be positive")
    kmax = max(MIN_FACTORS, *ks)
    used = [k for k in ks if k > 0]

    encoded, encoding = encoded or encode_features(flat)
    totals = written(subject_totals(responses), "subject-totals")
    n_subjects = totals.count()
    # A few subjects are numbers that tasks hold, so that answers stay with their items. An item with
    # several rows of metadata has several rows, which have to meet.
    few = n_subjects <= PACKED and spanned(n_subjects, kmax) and encoded.groupBy("item_id").count().filter(
        "count > 1").isEmpty()
    packed = written(pack_items(responses, n_subjects).join(encoded, "item_id"), "packed-items")
    observed = packed.filter(F.col("part") == 0).select("item_id", "n_observed")
    held = held_out_items(observed, seeds, test_size, min_observed).groupBy("item_id").agg(
        F.collect_set("split").alias("test_splits"))
    # the few held-out items are a small written table, so the packed items need not move again
    items = packed.join(written(held, "held-out"), "item_id", "left").select(
        "item_id", "part", "obs", "item_mean",
        F.coalesce("test_splits", F.array().cast("array<int>")).alias("test_splits"), "cat", "num")
    # one row per item
    design = written(design_entries(items.filter(F.col("part") == 0), encoding), "design")

    params = written(split_parameters(items, totals, seeds), "split-parameters")
    if few:
        factors = written(few_subject_factors(items, params, totals, seeds, kmax), "split-factors")
        targets = written(few_subject_targets(items, params, factors, seeds, kmax), "item-targets")
    else:
        z = written(train_residuals(items, params, seeds), "train-residuals")
        factors = written(factor_subjects(z, kmax, subjects=totals), "split-factors")
        targets = written(item_targets(z, factors, kmax), "item-targets")
    coefficients = written(ridge_coefficients(design, targets, encoding, seeds, alpha), "coefficients")

    pred = predicted_targets(design, coefficients, len(seeds) * (kmax + 1))
    predicted = written(items.select("item_id", "obs", "item_mean", "test_splits").join(pred, "item_id"),
                        "predicted-items")
    params = written(params.join(factors.select("split", "subject", "u"), ["split", "subject"],
                                 "left").select("split", "subject", "theta", "model_mean", "u"),
                     "subject-parameters")

    losses = _few_subject_losses(predicted, params, used, seeds, kmax) if few else _mean_losses(
        _scored_cells(_with_prediction(predicted, _train_splits(seeds), seeds, kmax), params, used))
    scales = factor_scales(losses) if used else responses.sparkSession.createDataFrame(
        [], "split int, k int, c double")
    scales = written(scales, "factor-scales")
    test = _scored_cells(
        _with_prediction(predicted.filter(F.size("test_splits") > 0), F.col("test_splits"),
                         seeds, kmax), params, used)
    by_split = scales.groupBy("split").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("c"))
    test = test.join(by_split, "split", "left")
    factor_part = F.transform("fs", lambda s: F.struct(
        s["k"].alias("k"),
        sigmoid(F.col("eta") + F.try_element_at("c", s["k"]) * s["f"]).alias("p")))
    plain = F.array(*[F.struct(F.lit(0).alias("k"), sigmoid("eta").alias("p"))]) if 0 in ks \
        else F.array().cast("array<struct<k:int,p:double>>")
    cells = written(test.select(
        "split", "item_id", "subject", "y", "item_mean", "model_mean", "b_hat", "eta",
        F.map_from_entries(F.concat(plain, factor_part)).alias("p")), "held-out-cells")
    return ColdStart(cells, ks, alpha, test_size, scales)


def _metrics_by_split(cells, ks, alpha, test_size, scales):
    # baselines do not depend on K: k = -1 and -2 stand for them until they are repeated per K
    ways = F.concat(
        F.transform(F.map_entries("p"), lambda e: F.struct(e["key"].alias("k"),
                                                           e["value"].alias("p"))),
        F.array(F.struct(F.lit(-1).alias("k"), F.col("model_mean").alias("p")),
                F.struct(F.lit(-2).alias("k"), F.col("item_mean").alias("p"))))
    scored = cells.select("split", "y", F.explode(ways).alias("w")).select(
        "split", "y", "w.k", "w.p")
    m = binary_metrics(scored, ["split", "k"], "y", "p", accuracy="acc_at_0p5", clip_auc=True)
    all_ks = F.array(*[F.lit(k) for k in ks])
    own = F.when(F.col("k") >= 0, F.array("k")).otherwise(all_ks)
    name = F.when(F.col("k") == -1, SUBJECT_MEAN).when(F.col("k") == -2, ITEM_MEAN)
    for k in ks:
        name = name.when(F.col("k") == k, method_name(k))
    m = m.join(scales, ["split", "k"], "left")
    return m.select("auc", "logloss", "brier", "acc_at_0p5", name.alias("method"),
                    F.explode(own).alias("K"), F.col("split").alias("seed"),
                    F.lit(test_size).alias("test_items"), F.col("n").alias("n_test_responses"),
                    F.lit(float(alpha)).alias("alpha"), F.col("c").alias("factor_scale_c"))


def _diagnostics(cells, ks, test_size, scales):
    """Agreement of the held-out items' own difficulty with the predicted one.

    The predicted difficulty is centred, the empirical one is not, so R2 carries that offset.
    """
    items = cells.groupBy("split", "item_id").agg(
        F.count("y").alias("answers"), F.max("b_hat").alias("b_hat"),
        (-safe_logit(F.max("item_mean"))).alias("b_own"))
    gap = F.col("b_own") - F.col("b_hat")
    fit = items.groupBy("split").agg(
        F.sum("answers").alias("n_test_responses"), F.count(F.lit(1)).alias("n"),
        F.corr("b_own", "b_hat").alias("corr"), F.sum(gap * gap).alias("sse"),
        F.var_pop("b_own").alias("var"))
    fit = fit.select(
        "split", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "n_test_responses",
        F.when(F.col("n") > 1, F.col("corr")).alias("b_empirical_corr"),
        F.when(F.col("n") > 1, 1 - F.try_divide("sse", F.col("var") * F.col("n")))
        .alias("b_empirical_r2"))
    return fit.join(scales, ["split", "k"], "left").select(
        F.col("split").alias("seed"), F.col("k").alias("K"), F.lit(test_size).alias("test_items"),
        "n_test_responses", "b_empirical_corr", "b_empirical_r2",
        F.col("c").alias("factor_scale_c"))


def summarize_metrics(metrics):
    both = lambda c: [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    return metrics.groupBy("method", "K").agg(
        F.count_distinct("seed").alias("splits"), *both("auc"), *both("logloss"), *both("brier"),
        *both("acc_at_0p5"), F.avg("n_test_responses").alias("mean_test_responses")).orderBy(
        "method", "K")


def summarize_diagnostics(diagnostics):
    both = lambda c: [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    return diagnostics.groupBy("K").agg(
        *both("b_empirical_corr"), *both("b_empirical_r2"),
        F.avg("factor_scale_c").alias("mean_factor_scale_c")).orderBy("K")
