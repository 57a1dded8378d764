"""Moment estimates of the one-parameter model, standardized residuals and their factors.

All tables carry a `split` column, so that many train sets are handled in one pass; the plain
analysis uses the single split 0. A missing cell has residual zero, hence absent rows in the long
table lose nothing.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from itemscope.operators.responses import first_per_item
from itemscope.functions.scalar import rasch_probability, safe_logit, standardized_residual
from itemscope.operators.design import partial_rows, sum_rows
from itemscope.session import local_table, written


def moment_abilities(responses):
    """ability = logit of the subject's mean answer, centred over subjects."""
    raw = responses.groupBy("subject").agg(
        F.avg("y").alias("mean_response"), F.count("y").alias("n_observed"))
    raw = raw.withColumn("raw", safe_logit("mean_response"))
    centre = raw.agg(F.avg("raw")).scalar()
    return raw.select("subject", "mean_response", "n_observed",
                      (F.col("raw") - centre).alias("ability"))


def moment_difficulties(responses):
    """difficulty = minus the logit of the item's mean answer, centred over items."""
    raw = responses.groupBy("item_id").agg(
        F.avg("y").alias("empirical_accuracy"), F.count("y").alias("n_observed"))
    raw = raw.withColumn("empirical_difficulty", -safe_logit("empirical_accuracy"))
    centre = raw.agg(F.avg("empirical_difficulty")).scalar()
    return raw.select("item_id", "empirical_accuracy", "n_observed", "empirical_difficulty",
                      (F.col("empirical_difficulty") - centre).alias("difficulty"))


def residuals(responses, ability, item_params):
    """Rows (split, item_id, subject, z); cells without ability or difficulty are missing."""
    eta = (responses.filter(F.col("y").isNotNull())
           .join(first_per_item(item_params.select("item_id", "difficulty")), "item_id")
           .join(ability.select("subject", "ability"), "subject"))
    p = rasch_probability("ability", "difficulty")
    return eta.select(F.lit(0).alias("split"), "item_id", "subject",
                      standardized_residual("y", p).alias("z")).filter(F.col("z").isNotNull())


def residual_gram(z):
    """Upper triangle of the Gram matrix, as rows (split, subject_a, subject_b, dot).

    Pairs of subjects meet at the items that both answered and are added up where they meet.
    """
    a, b = (z.select("split", "item_id", F.col("subject").alias(f"subject_{x}"), F.col("z").alias(x))
            for x in "ab")
    return a.join(b, ["split", "item_id"]).where("subject_a <= subject_b").groupBy(
        "split", "subject_a", "subject_b").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))


def _times_gram(z, x, width):
    """Rows (split, subject, y): the subjects' Gram matrix times the columns of `x`.

    `x` has rows (split, subject, x). Residuals move once, to their items; a window adds up the
    item's side, and what goes back to the subjects is combined within tasks first.
    """
    item = Window.partitionBy("split", "item_id")
    cells = z.repartition("split", "item_id").join(x, ["split", "subject"])
    cells = cells.select("split", "subject", "z", *[
        F.sum(F.col("z") * F.col("x")[i]).over(item).alias(f"v{i}") for i in range(width)])
    sums = cells.groupBy("split", "subject").agg(
        *[F.sum(F.col("z") * F.col(f"v{i}")).alias(f"v{i}") for i in range(width)])
    return sums.select("split", "subject", F.array(*[f"v{i}" for i in range(width)]).alias("y"))


def _cross(column):
    """Per partition and split: sums of the outer product of `column` with itself."""
    def run(batches):
        sums = {}
        for batch in batches:
            split = batch.column("split").to_numpy(zero_copy_only=False)
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(split), -1)
            for s in np.unique(split):
                part = x[split == s]
                sums[s] = sums.get(s, 0.0) + part.T @ part
        yield from partial_rows(sums)
    return run


def _crossed(rows, column):
    """{split: matrix} of the sums of outer products over the rows of each split."""
    sums = sum_rows(rows.select("split", column).mapInArrow(
        _cross(column), "split int, i int, row array<double>"), ["split", "i"])
    return collected_rows(sums)    # a row for each column of the block and split


def _mixed(rows, column, mixes, names):
    """The columns of the array `column` of each row, mixed by the matrices of the row's split.

    `mixes` is {split: [a matrix for each of `names`]}.
    """
    def run(batches):
        for batch in batches:
            split = batch.column("split").to_numpy(zero_copy_only=False)
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(split), -1)
            out = [[None] * len(split) for _ in names]
            for s in np.unique(split):
                here = np.flatnonzero(split == s)
                for values, mix in zip(out, mixes[s]):
                    for at, row in zip(here, x[here] @ mix):
                        values[at] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("split"), batch.column("subject"),
                 *(pa.array(values, pa.list_(pa.float64())) for values in out)],
                ["split", "subject", *names])
    return rows.select("split", "subject", column).mapInArrow(
        run, "split int, subject string, " + ", ".join(f"{n} array<double>" for n in names))


def _independent(gram):
    """A matrix that turns columns with this Gram matrix into orthonormal ones, without the rest."""
    size = np.sqrt(np.diag(gram))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
    keep = values > 1e-11 * values[-1] if len(values) else values > 0
    return scale[:, None] * vectors[:, keep] / np.sqrt(values[keep])


def _padded(columns, width):
    return np.hstack([columns, np.zeros((len(columns), max(0, width - columns.shape[1])))])[:, :width]


def _ritz(crossed, width):
    """Of a split's [Q | A Q]: values, and mixes that give the next basis.

    That is the best vectors, their residuals and the directions that led to them.
    """
    n = len(crossed) // 2
    gram, product = crossed[:n, :n], crossed[:n, n:]
    basis = _independent(gram)
    inner = basis.T @ (product + product.T) / 2 @ basis
    values, turn = np.linalg.eigh(inner)
    values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
    best = basis @ turn
    residual = np.vstack([-best * values, best])
    led = best.copy()
    led[:width] = 0.0
    zero = np.zeros_like(best)
    return values, (
        _padded(np.vstack([best, zero]), width), _padded(np.vstack([zero, best]), width),
        _padded(residual, width), _padded(np.vstack([led, zero]), width),
        _padded(np.vstack([zero, led]), width))


#: Columns of a block beyond the factors that are asked for.
SPARE = 24


def factor_subjects(z, k, subjects=None, tolerance=1e-12, max_rounds=200):
    """Leading `k` factors per split: rows (split, subject, u, s, total).

    `u` is the subject's loading times the root of the singular value, `s` the singular values,
    `total` the sum of squared residuals. There are never more factors than items or subjects.
    `subjects` may name a smaller table to read the subjects from; those without residuals load
    nothing. `z` is read many times, so it should be a written table.

    A block of random columns, a row of numbers for each subject, is multiplied by Z and its
    transpose and improved over the span of the block, its residuals and its last step, until the
    residuals of all k vectors are below `tolerance` of the largest value; a block that does not get
    there raises. Where the block would span all subjects, their Gram matrix is added up in one pass
    instead. Only sums of 6 x (k + SPARE) columns reach the driver, however many subjects.
    """
    totals = {r["split"]: r for r in z.groupBy("split", "item_id").agg(
        F.sum(F.col("z") * F.col("z")).alias("q")).groupBy("split").agg(
        F.sum("q").alias("total"), F.count("*").alias("items")).collect()}    # a row for each split
    roster = (z if subjects is None else subjects).select("subject").distinct()
    seats = local_table(z.sparkSession, [(s,) for s in totals], {"split": pa.int32()})
    roster = written(seats.join(roster), "roster")
    m = roster.groupBy("split").count().agg(F.max("count")).first()[0] or 0
    if not m:
        return roster.select("split", "subject", F.lit(None).cast("array<double>").alias("u"),
                             F.lit(None).cast("array<double>").alias("s"), F.lit(None).cast("double").alias("total"))
    if spanned(m, k):    # one pass gives the whole matrix
        names = sorted((r["subject"] for r in roster.select("subject").distinct().collect()),
                       key=lambda name: (name is None, name))
        known = [name for name in names if name is not None]
        numbers = local_table(z.sparkSession, [(name, i) for i, name in enumerate(known)],
                              {"subject": pa.string(), "idx": pa.int32()})
        cells = z.select("split", "item_id", "subject", "z").join(numbers, "subject").groupBy(
            "split", "item_id").agg(F.collect_list(F.struct("idx", "z")).alias("cells"))
        grams = _grams(cells, len(known))
        return spanned_factors(z.sparkSession, {s: grams.get(s, np.zeros((len(known),) * 2)) for s in totals},
                               names, k, totals)
    k = min(k, m)
    width = min(m, k + SPARE)
    noise = F.array(*[(F.xxhash64("subject", F.lit(i)) / F.lit(2.0 ** 63)) for i in range(width)])
    start = written(roster.select("split", "subject", noise.alias("x")), "factor-block")
    mixes = {s: [_padded(_independent(g), width)] for s, g in _crossed(start, "x").items()}
    block = written(_mixed(start, "x", mixes, ["x"]), "factor-block")

    def multiplied(block, column):
        return block.join(_times_gram(z, block.select("split", "subject", F.col(column).alias("x")), width),
                          ["split", "subject"], "left").withColumn(
            "y", F.coalesce("y", F.array_repeat(F.lit(0.0), width)))
    state = written(multiplied(block, "x").select("split", "subject", F.concat("x", "y").alias("x")),
                    "factor-state")
    for _ in range(max_rounds):
        found = {s: _ritz(c, width) for s, c in _crossed(state, "x").items()}
        mixed = written(_mixed(state, "x", {s: mixes for s, (_, mixes) in found.items()},
                               ["x", "ax", "r", "p", "ap"]), "factor-block")
        off = mixed.select("split", F.posexplode(F.slice("r", 1, k)).alias("i", "r")).groupBy("split", "i").agg(
            F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("off")).groupBy("split").agg(F.max("off").alias("off"))
        if all(r["off"] <= tolerance * found[r["split"]][0][0] for r in off.collect()):
            break
        state = written(multiplied(mixed, "r").select(
            "split", "subject", F.concat("x", "r", "p", "ax", "y", "ap").alias("x")), "factor-state")
    else:
        raise ValueError(f"the factors have not settled after {max_rounds} rounds")
    vectors = mixed.select("split", "subject", F.col("x").alias("u"))
    return _signed(z.sparkSession, vectors, {s: values for s, (values, _) in found.items()}, totals, k)


def _signed(spark, vectors, values, totals, k):
    """Rows (split, subject, u, s, total) from unit vectors `u` and the Gram matrices' values."""
    counts = {s: min(k, totals[s]["items"], len(values[s])) for s in values}
    singular = {s: np.sqrt(np.clip(values[s][:n], 0.0, None)) for s, n in counts.items()}
    # The largest loading of a factor is positive; of equal ones, that of the first subject.
    most = vectors.select("split", "subject", F.posexplode("u").alias("i", "v")).groupBy("split", "i").agg(
        F.min_by(F.signum("v"), F.struct(-F.round(F.abs("v"), 12), "subject")).alias("sign"))
    signs = {}
    for r in most.collect():    # a row for each factor
        signs.setdefault(r["split"], {})[r["i"]] = r["sign"]
    turned = {s: [np.eye(len(values[s]))[:, :len(v)] * [signs[s][i] * np.sqrt(x) for i, x in enumerate(v)]]
              for s, v in singular.items()}
    sizes = local_table(spark, [(s, v.tolist(), float(totals[s]["total"])) for s, v in singular.items()],
                        {"split": pa.int32(), "s": pa.list_(pa.float64()), "total": pa.float64()})
    return _mixed(vectors, "u", turned, ["u"]).join(sizes, "split").select("split", "subject", "u", "s", "total")


def _grams(cells, n):
    """{split: Gram matrix} of `n` subjects from rows (split, cells), an item's residuals `z` by number `idx`.

    Every task adds up the items it holds, so that residuals do not move for it.
    """
    def run(batches):
        sums = {}
        for batch in batches:
            split, lists = batch.column("split").to_numpy(zero_copy_only=False), batch.column("cells")
            flat = lists.flatten()
            row = lists.value_parent_indices().to_numpy(zero_copy_only=False)
            dense = np.zeros((len(split), n))
            np.add.at(dense, (row, flat.field("idx").to_numpy(zero_copy_only=False)),
                      flat.field("z").to_numpy(zero_copy_only=False))
            for s in np.unique(split):
                part = dense[split == s]
                sums[s] = sums.get(s, 0.0) + part.T @ part
        yield from partial_rows(sums)
    return collected_rows(sum_rows(cells.select("split", "cells").mapInArrow(
        run, "split int, i int, row array<double>"), ["split", "i"]))


def collected_rows(rows):
    """{split: matrix} of rows (split, i, row)."""
    out = {}
    for r in rows.collect():
        out.setdefault(r["split"], {})[r["i"]] = r["row"]
    return {s: np.array([rows[i] for i in range(len(rows))]) for s, rows in out.items()}


def spanned(n, k):
    """Whether a block of columns for `k` factors would span all `n` subjects, so that their Gram
    matrix is no larger than what a round sends to the driver."""
    return n <= k + SPARE


def spanned_factors(spark, grams, names, k, totals):
    """`factor_subjects` of a few subjects `names`, whose Gram matrices are known.

    `totals` is {split: {"total": .., "items": ..}}.
    """
    values, rows = {}, []
    for s, gram in grams.items():
        found, vectors = np.linalg.eigh((gram + gram.T) / 2)
        values[s], vectors = found[::-1], vectors[:, ::-1]
        rows += [(s, name, vectors[i].tolist() if i < len(vectors) else [0.0] * len(found))
                 for i, name in enumerate(names)]
    vectors = local_table(spark, rows, {"split": pa.int32(), "subject": pa.string(), "u": pa.list_(pa.float64())})
    return _signed(spark, vectors, values, totals, min(k, len(names)))


def item_loadings(z, factors, k):
    """Rows (split, item_id, v): item loadings times the root of the singular value."""
    cells = z.join(factors.select("split", "subject", "u", "s"), ["split", "subject"])
    at = lambda i: F.sum(F.when(F.get("s", F.lit(i)) > 1e-9, F.col("z") * F.get("u", F.lit(i))
                                / F.get("s", F.lit(i))).otherwise(0.0))
    sums = cells.groupBy("split", "item_id").agg(*[at(i).alias(f"v{i}") for i in range(k)])
    return sums.select("split", "item_id", F.array(*[f"v{i}" for i in range(k)]).alias("v"))


def residual_factor_analysis(responses, ability, item_params, n_factors=5):
    """Factors of the one-parameter residuals: subject loadings, item loadings, variance shares.

    Returns a dict of three DataFrames. `ability` has columns subject, ability.
    """
    z = written(residuals(responses, ability, item_params), "residual-cells")
    factors = written(factor_subjects(z, n_factors, subjects=ability), "factors")
    first = factors.first()
    k = len(first["s"]) if first else 0
    names = [f"factor{i + 1}" for i in range(k)]
    subject = factors.select(F.col("subject").alias("model"), *[
        F.col("u")[i].alias(n) for i, n in enumerate(names)])
    item = item_loadings(z, factors, k).select("item_id", *[
        F.col("v")[i].alias(n) for i, n in enumerate(names)])
    variance = factors.select("s", "total").distinct().select(
        "total", F.posexplode("s").alias("pos", "singular_value")).select(
        (F.col("pos") + 1).alias("factor"), "singular_value",
        (F.col("singular_value") * F.col("singular_value") / F.col("total"))
        .alias("residual_variance_share")).orderBy("factor")
    return {"subject_factors": subject, "item_factors": item, "variance": variance}
