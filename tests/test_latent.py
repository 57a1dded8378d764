import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemscope.operators import coldstart, fits, residuals
from itemscope.operators.design import Encoding


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _moments(y):
    theta = _logit(np.nanmean(y, axis=1))
    b = -_logit(np.nanmean(y, axis=0))
    return theta - theta.mean(), b - b.mean()


def _standardized(y, theta, b):
    p = _sigmoid(theta[:, None] - b)
    return np.where(np.isnan(y), 0.0, (y - p) / np.sqrt(np.maximum(p * (1 - p), 1e-4)))


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    y = (rng.random((6, 40)) < 0.6).astype(float)
    y[rng.random(y.shape) < 0.1] = np.nan
    return y


@pytest.mark.parametrize("spare", [24, 0])
def test_residual_factors_against_dense_svd(long_table, small, monkeypatch, spare):
    # without spare columns the block does not span all subjects at once
    monkeypatch.setattr(residuals, "SPARE", spare)
    cells = long_table(small)
    ability, items = residuals.moment_abilities(cells), residuals.moment_difficulties(cells)
    theta, b = _moments(small)
    got = ability.orderBy("subject").toPandas()
    assert np.allclose(got["ability"], theta)
    z = _standardized(small, theta, b)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    out = residuals.residual_factor_analysis(cells, ability, items, 4)
    var = out["variance"].toPandas()
    assert np.allclose(var["singular_value"], s[:4])
    assert np.allclose(var["residual_variance_share"], s[:4] ** 2 / np.sum(s ** 2))
    subj = out["subject_factors"].orderBy("model").toPandas()
    item = out["item_factors"].orderBy("item_id").toPandas()
    for k in range(4):
        sign = np.sign(u[np.argmax(np.abs(u[:, k])), k])
        assert np.allclose(subj[f"factor{k + 1}"], sign * u[:, k] * np.sqrt(s[k]))
        assert np.allclose(item[f"factor{k + 1}"], sign * vt[k] * np.sqrt(s[k]))


def test_factors_of_many_subjects_and_splits(spark):
    rng = np.random.default_rng(11)
    n, m = 40, 5000
    dense = {s: rng.normal(size=(m, 3)) @ rng.normal(size=(3, n)) * 2 + rng.normal(size=(m, n)) for s in (0, 7)}
    frames = [pd.DataFrame({"split": np.int32(s), "item_id": np.tile([f"i{j}" for j in range(n)], m),
                            "subject": np.repeat([f"s{i:04d}" for i in range(m)], n), "z": z.ravel()})
              for s, z in dense.items()]
    z = spark.createDataFrame(pd.concat(frames), "split int, item_id string, subject string, z double")
    got = residuals.factor_subjects(z, 3).toPandas()
    for s, matrix in dense.items():
        u, values, _ = np.linalg.svd(matrix, full_matrices=False)
        own = got[got.split == s].sort_values("subject")
        assert np.allclose(own["s"].iloc[0], values[:3], rtol=1e-10)
        assert own["total"].iloc[0] == pytest.approx(np.sum(matrix ** 2))
        loadings = np.vstack(own["u"].to_numpy())
        for k in range(3):
            sign = np.sign(u[np.argmax(np.abs(u[:, k])), k])
            assert np.abs(loadings[:, k] - sign * u[:, k] * np.sqrt(values[k])).max() < 1e-8


def test_factors_that_do_not_settle_raise(long_table, small, monkeypatch):
    monkeypatch.setattr(residuals, "SPARE", 0)
    cells = long_table(small)
    z = residuals.residuals(cells, residuals.moment_abilities(cells), residuals.moment_difficulties(cells))
    with pytest.raises(ValueError):
        residuals.factor_subjects(z, 2, max_rounds=1)


def test_gram_table(long_table, small):
    cells = long_table(small)
    zl = residuals.residuals(cells, residuals.moment_abilities(cells),
                             residuals.moment_difficulties(cells))
    theta, b = _moments(small)
    z = _standardized(small, theta, b)
    gram = z @ z.T
    for r in residuals.residual_gram(zl).collect():
        i, j = int(r["subject_a"][1:]), int(r["subject_b"][1:])
        assert i <= j and r["dot"] == pytest.approx(gram[i, j])
    total = zl.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    assert np.sum(np.linalg.svd(z)[1] ** 2) == pytest.approx(total)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(7)
    m, n = 12, 90
    state = rng.choice(["", "TX", "FL"], n)
    occ = rng.integers(1, 6, n).astype(float)
    b = 0.8 * (state == "TX") + 0.3 * (occ - 3)
    v = 1.0 * (state == "FL") - 0.4
    u = rng.normal(size=m)
    y = (rng.random((m, n)) < _sigmoid(rng.normal(size=m)[:, None] - b + u[:, None] * v)).astype(
        float)
    y[rng.random(y.shape) < 0.15] = np.nan
    return y, state, occ


def _cold_start_by_hand(y, state, occ, seed, size, ks, alpha, min_observed):
    n = y.shape[1]
    eligible = [j for j in range(n) if np.sum(~np.isnan(y[:, j])) >= min_observed]
    eligible.sort(key=lambda j: hashlib.md5(f"{seed}:i{j:03d}".encode()).hexdigest())
    test = np.sort(eligible[:size])
    train = np.setdiff1d(np.arange(n), test)
    x = np.column_stack([state == s for s in ("", "FL", "TX")] + [occ]).astype(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    theta, b = _moments(y[:, train])
    u, s, vt = np.linalg.svd(_standardized(y[:, train], theta, b), full_matrices=False)
    u, v = u[:, :8] * np.sqrt(s[:8]), vt[:8].T * np.sqrt(s[:8])
    t = np.column_stack([b, v])
    tm, ts = t.mean(axis=0), t.std(axis=0)
    xc = x[train] - x[train].mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ ((t - tm) / ts))
    pred = (x - x[train].mean(axis=0)) @ w * ts + tm
    seen = ~np.isnan(y)
    out = {}
    for k in ks:
        eta = theta[:, None] - pred[:, 0]
        f = u[:, :k] @ pred[:, 1:k + 1].T
        c = np.nan
        if k:
            rows = [(m, j) for m in range(len(y)) for j in train if seen[m, j]]
            losses = []
            for g in np.linspace(-2, 2, 161):
                e = np.array([eta[r] + g * f[r] for r in rows])
                losses.append(np.mean(np.logaddexp(0, e) - e * np.array([y[r] for r in rows])))
            c = np.linspace(-2, 2, 161)[int(np.argmin(losses))]
            eta = eta + c * f
        out[k] = c, {(m, j): _sigmoid(eta[m, j]) for m in range(len(y)) for j in test if seen[m, j]}
    b_own = -_logit(np.nanmean(y[:, test], axis=0))
    return out, test, b_own, pred[test, 0], np.nanmean(y[:, train], axis=1)


@pytest.fixture(scope="module")
def run(spark, world):
    y, state, occ = world
    rows = [(f"s{m:02d}", f"i{j:03d}", int(y[m, j])) for m in range(len(y))
            for j in range(y.shape[1]) if not np.isnan(y[m, j])]
    cells = spark.createDataFrame(rows, "subject string, item_id string, y int")
    flat = spark.createDataFrame([(f"i{j:03d}", str(state[j]), float(occ[j]))
                                  for j in range(y.shape[1])],
                                 "item_id string, State string, Occupants double")
    return cells, flat, coldstart.run_cold_start(cells, flat, (1, 2), (0, 1, 3), 20, min_observed=6)


def test_cold_start_against_numpy(run, world):
    got = {(r["split"], r["subject"], r["item_id"]): r for r in run[2].cells.collect()}
    metrics = run[2].metrics_by_split.toPandas()
    diag = run[2].diagnostics_by_split.toPandas()
    for seed in (1, 2):
        want, test, b_own, b_hat, means = _cold_start_by_hand(*world, seed, 20, (0, 1, 3), 10.0, 6)
        assert {k[2] for k in got if k[0] == seed} == {f"i{j:03d}" for j in test}
        for k, (c, probabilities) in want.items():
            own = metrics[(metrics.seed == seed) & (metrics.K == k)
                          & (metrics.method == coldstart.method_name(k))].iloc[0]
            assert own["n_test_responses"] == len(probabilities)
            assert own["factor_scale_c"] == pytest.approx(c) or (k == 0 and np.isnan(
                own["factor_scale_c"]))
            for (m, j), p in probabilities.items():
                r = got[seed, f"s{m:02d}", f"i{j:03d}"]
                assert r["p"][k] == pytest.approx(p, abs=1e-9)
                assert r["model_mean"] == pytest.approx(means[m])
            d = diag[(diag.seed == seed) & (diag.K == k)].iloc[0]
            assert d["b_empirical_corr"] == pytest.approx(np.corrcoef(b_own, b_hat)[0, 1])
            r2 = 1 - np.sum((b_own - b_hat) ** 2) / np.sum((b_own - b_own.mean()) ** 2)
            assert d["b_empirical_r2"] == pytest.approx(r2)
    one = run[2].predictions(1, 3).first()
    assert one["p_K_coldstart"] is not None and one["p_feature_1pl"] is not None


def test_cold_start_summaries(run):
    by_split = run[2].metrics_by_split.toPandas()
    assert len(by_split) == 2 * 3 * 3
    summary = run[2].summary.toPandas()
    assert len(summary) == 9 and (summary["splits"] == 2).all()
    row = summary[(summary.method == "feature_K3_b_plus_loading")].iloc[0]
    part = by_split[by_split.method == "feature_K3_b_plus_loading"]
    assert row["mean_auc"] == pytest.approx(part["auc"].mean())
    assert row["sd_auc"] == pytest.approx(part["auc"].std())
    assert len(run[2].diagnostics_summary.collect()) == 3


def test_cold_start_ignores_partitions_and_packing(run, monkeypatch):
    cells, flat, first = run
    monkeypatch.setattr(coldstart, "PACKED", 5)  # items are now split over three lists
    monkeypatch.setattr(coldstart, "BLOCK_COLUMNS", 7)  # and the ridge takes steps between blocks
    again = coldstart.run_cold_start(cells.repartition(3), flat.repartition(2), (1, 2), (0, 3), 20,
                                     min_observed=6)
    key = lambda r: (r["split"], r["subject"], r["item_id"])
    want = {key(r): r["p"][3] for r in first.cells.collect()}
    got = {key(r): r["p"][3] for r in again.cells.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_ridge_with_many_levels(spark):
    levels, n, alpha = 20_000, 45_000, 10.0
    rng = np.random.default_rng(3)
    level = np.r_[np.arange(levels), rng.integers(0, levels, n - 2 * levels), np.zeros(levels, int)]
    t = rng.normal(size=n) + level % 7
    held = np.arange(n) % 11 == 0
    pdf = pd.DataFrame({"item_id": [f"i{j}" for j in range(n)], "level": level, "t": t, "held": held})
    items = spark.createDataFrame(pdf)
    design = items.selectExpr(
        "item_id", "if(held, array(7), array()) as test_splits",
        f"array(named_struct('i', cast(level as int), 'a', 1D), named_struct('i', {levels}, 'a', 1D)) as row")
    targets = items.filter("not held").selectExpr("7 as split", "item_id", "array(t, 2 * t) as t")
    encoding = Encoding(["c"], [], [[""] * (levels - 1)])
    got = {r["i"]: r["w"] for r in coldstart.ridge_coefficients(
        design, targets, encoding, [7], alpha).collect()}
    # One category: its levels meet only through the intercept, so the solution is in closed form.
    share = np.bincount(level, minlength=levels) / n
    count = np.bincount(level[~held], minlength=levels)
    total = np.bincount(level[~held], t[~held], minlength=levels)
    size = count + alpha * share * (1 - share)
    constant = (total.sum() - np.sum(count * total / size)) / (count.sum() - np.sum(count ** 2 / size))
    want = (total - count * constant) / size
    found = np.array([got[j] for j in range(levels)])
    assert np.allclose(found[:, 0], want, atol=1e-8) and np.allclose(found[:, 1], 2 * want, atol=1e-8)
    assert got[levels][0] == pytest.approx(constant, abs=1e-8)


def test_cold_start_needs_enough_items(run):
    with pytest.raises(ValueError, match="eligible"):
        coldstart.run_cold_start(run[0], run[1], (1,), (0,), 5000)


def _simulate(theta, a, d, seed, extra=0.0):
    rng = np.random.default_rng(seed)
    return (rng.random((len(theta), len(d))) < _sigmoid(theta[:, None] * a + d + extra)).astype(float)


def test_rasch_recovery(long_table):
    rng = np.random.default_rng(1)
    theta, b = np.linspace(-2, 2, 12), rng.normal(size=400)
    y = _simulate(theta, np.ones(400), -b, 2)
    y[rng.random(y.shape) < 0.2] = np.nan
    subjects, items = fits.rasch_fit(long_table(y))
    got = subjects.orderBy("subject").toPandas()["ability"].to_numpy()
    assert abs(got.mean()) < 1e-9
    assert np.corrcoef(got, theta)[0, 1] > 0.98
    diff = items.orderBy("item_id").toPandas()["difficulty"].to_numpy()
    # items answered all alike sit at the edge, so ranks are compared
    assert np.corrcoef(pd.Series(diff).rank(), pd.Series(b).rank())[0, 1] > 0.7
    # likelihood equations hold: expected totals equal observed ones
    p = _sigmoid(got[:, None] - diff)
    seen = ~np.isnan(y)
    assert np.allclose(np.where(seen, p, 0).sum(axis=1), np.nansum(y, axis=1), atol=0.2)


def test_twopl_and_kfactor_recovery(long_table):
    rng = np.random.default_rng(4)
    theta = np.linspace(-2, 2, 16)
    a, d = rng.uniform(0.3, 2.0, 200), rng.normal(size=200)
    subjects, items = fits.twopl_fit(long_table(_simulate(theta, a, d, 5)))
    got = subjects.orderBy("subject").toPandas()["ability"].to_numpy()
    assert np.corrcoef(got, theta)[0, 1] > 0.95
    disc = items.orderBy("item_id").toPandas()["discrimination"].to_numpy()
    assert np.corrcoef(disc, a)[0, 1] > 0.4

    u, v = rng.normal(size=16), rng.normal(size=200)
    cells = long_table(_simulate(np.zeros(16), a, 0 * d, 6, extra=1.5 * u[:, None] * v))
    z = residuals.residuals(cells, residuals.moment_abilities(cells),
                            residuals.moment_difficulties(cells))
    subjects, items = fits.kfactor_fit(cells, 1, residuals.factor_subjects(z, 1))
    got = subjects.orderBy("subject").toPandas()["factor_1"].to_numpy()
    assert abs(np.corrcoef(got, u)[0, 1]) > 0.9
    table = fits.factor_table(subjects, cells, 200, 1).first()
    assert table["k_factors"] == 1 and table["observed_total"] == 200


@pytest.mark.parametrize("model", [fits.OnePL(), fits.TwoPL(), fits.KFactor(3)])
def test_score_equations_hold(long_table, model):
    rng = np.random.default_rng(9)
    n, k = 14, 3
    u, v = rng.normal(size=(n, k)), rng.normal(size=(300, k))
    y = _simulate(rng.normal(size=n), np.ones(300), rng.normal(size=300), 7, extra=u @ v.T)
    y[rng.random(y.shape) < 0.1] = np.nan
    packed, names = fits.pack_for_fit(long_table(y))
    wide = len(model.subject_prior)
    start = np.hstack([np.zeros((n, 1)), u])[:, :wide] if wide > 1 else np.linspace(-1, 1, n)[:, None]
    s = fits._fit(packed, model, start, 300, 1e-6)
    rows = packed.mapInPandas(fits._item_rows(model, s, np.eye(len(model.item_prior)), 0.0),
                              "item_id string, beta array<double>").orderBy("item_id").toPandas()
    beta = np.array(rows["beta"].tolist())
    offset, w = model.subject_view(beta)
    seen = ~np.isnan(y)
    mean = np.nanmean(y, axis=0)
    error = np.where(seen, y + np.clip(mean, 1e-4, 1 - 1e-4) - mean - _sigmoid(offset + s @ w.T), 0)
    assert names == sorted(names)
    assert np.abs(error @ w - model.subject_penalty * (s - model.subject_prior)).max() < 1e-4
    x = model.item_view(s)[1]
    assert np.abs(error.T @ x - model.item_penalty * (beta - model.item_prior)).max() < 1e-4
    # scale and axes leave every answer's probability as it is
    fixed, m, c = model.fixed(s)
    offset, w = model.subject_view(beta @ m + c)
    before = model.subject_view(beta)
    assert np.allclose(offset + fixed @ w.T, before[0] + s @ before[1].T)


def test_a_fit_that_does_not_converge_raises(long_table):
    y = _simulate(np.linspace(-1, 1, 6), np.ones(40), np.zeros(40), 3)
    with pytest.raises(RuntimeError, match="no convergence"):
        fits.twopl_fit(long_table(y), max_sweeps=2)


@pytest.mark.parametrize("model, passes", [(fits.TwoPL(), 60), (fits.KFactor(2), 120)])
def test_few_subjects_settle_in_few_passes(model, passes):
    """The whole Hessian is that of the best items, and steps with it reach the top in few passes."""
    rng = np.random.default_rng(5)
    n, wide = 12, len(model.subject_prior)
    y = (rng.random((n, 1500)) < 0.5).astype(float)    # no factor stands out
    pdf = pd.DataFrame({"who": [np.flatnonzero(s) for s in rng.random((1500, n)) < 0.7]})
    pdf["ys"] = [y[w, i] for i, w in enumerate(pdf["who"])]
    pdf = pdf[pdf["who"].map(len) > 0].reset_index(drop=True)
    rows = lambda s: next(fits._subject_sums(model, s)([pdf]))
    score = lambda s: np.array([r for i, r in zip(*rows(s).values.T) if 0 <= i < n])[:, :wide].ravel()
    s = rng.normal(size=(n, wide)) / 2
    found = rows(s)
    blocks = np.array([r for i, r in zip(*found.values.T) if 0 <= i < n])[:, wide:].reshape(n, wide, wide)
    crossed = np.concatenate([r for i, r in zip(*found.values.T) if i >= n])[:(n * wide) ** 2]
    whole = -crossed.reshape(n, wide, n, wide)
    whole[np.arange(n), :, np.arange(n)] += blocks
    for j in range(n * wide):
        step = np.zeros(n * wide)
        step[j] = 1e-5
        step = step.reshape(s.shape)
        slope = (score(s + step) - score(s - step)) / 2e-5
        assert np.allclose(-slope, whole.reshape(n * wide, -1)[:, j], atol=2e-3)
    calls = []

    def climb(packed, model, at):
        calls.append(1)
        out = rows(at)
        total = np.array([r for i, r in zip(*out.values.T) if 0 <= i < n])
        value = next(r for i, r in zip(*out.values.T) if i < 0)[0]
        away = at - model.subject_prior
        h = total[:, wide:].reshape(n, wide, wide) + np.diag(model.subject_penalty)
        full = -np.concatenate([r for i, r in zip(*out.values.T) if i >= n])[:(n * wide) ** 2].reshape(n, wide, n, wide)
        full[np.arange(n), :, np.arange(n)] += h
        return (value - np.sum(model.subject_penalty * away ** 2) / 2,
                total[:, :wide] - model.subject_penalty * away, h, full.reshape(n * wide, -1))
    kept, fits._climb = fits._climb, climb
    try:
        fits._fit(None, model, s, 300, 1e-5)
    finally:
        fits._climb = kept
    assert len(calls) <= passes


def test_items_settle_beside_far_subjects():
    """A step whose parts are cut one by one can lead downhill, and this item never settled."""
    s = np.array([[0.4, -162.9, 92.1], [0.1, -0.4, -0.9], [0.1, -22.0, -7.8], [0.1, -1.4, 0.1], [-47.5, -41.8, 691.1],
                  [0.1, -0.0, -7.1], [0.1, -3.8, 10.5], [0.1, 1.5, -4.1], [0.1, -2.6, -3.5], [7.6, -42.7, -75.5],
                  [0.1, -0.3, -2.9], [0.1, -1.8, -3.4], [0.1, 1.8, -6.5], [0.1, -2.5, 0.2], [0.1, -0.3, -3.7],
                  [0.0, -3.3, -0.4], [0.1, -4.5, 0.0], [13.4, 826.1, -127.8], [1.0, 1.5, -16.5]])
    y = np.array([0, 1, 0, 0, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 1, 0])
    pdf = pd.DataFrame({"who": [np.arange(19)], "ys": [y], "item_id": ["a"]})
    for strangers in (0, 100):    # in a table, and in a list
        subjects = np.vstack([s, np.zeros((strangers, 3))])
        beta = next(fits._item_rows(fits.KFactor(2), subjects, np.eye(2), 0.0)([pdf]))["beta"][0]
        left = s[:, 1:].T @ (y - _sigmoid(s[:, 0] + s[:, 1:] @ beta)) - beta
        assert np.abs(left).max() < 1e-4


@pytest.mark.parametrize("model", [fits.OnePL(), fits.TwoPL(), fits.KFactor(2)])
def test_sums_of_tables_and_lists_agree(model, monkeypatch):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(9, len(model.subject_prior)))
    for repeats in (1, 2):    # a cell may come twice
        who = [np.repeat(np.flatnonzero(w), repeats) for w in rng.random((300, 9)) < 0.7]
        pdf = pd.DataFrame({"who": [w for w in who if len(w)]})
        pdf["ys"] = [rng.integers(0, 2, len(w)) for w in pdf["who"]]
        monkeypatch.setattr(fits, "_CELLS", 400)
        tables = next(fits._subject_sums(model, s)([pdf]))
        monkeypatch.setattr(fits, "_FILLED", 0)
        lists = next(fits._subject_sums(model, s)([pdf]))
        monkeypatch.undo()
        assert tables["idx"].tolist() == lists["idx"].tolist()
        assert np.allclose(np.array(tables["row"].tolist()), np.array(lists["row"].tolist()), atol=1e-6)


def _passes(model, s, pdf, times, monkeypatch):
    """Passes of a fit to the rows of `pdf` and as many more as `times` says."""
    n, wide = s.shape
    calls = []

    def climb(packed, model, at):
        calls.append(1)
        out = next(fits._subject_sums(model, at)([pdf]))
        out = {i: times * np.array(r) for i, r in zip(out["idx"], out["row"])}
        total, away = np.array([out[i] for i in range(n)]), at - model.subject_prior
        h = total[:, wide:].reshape(n, wide, wide) + np.diag(model.subject_penalty)
        crossed = np.concatenate([out[i] for i in sorted(out) if i >= n])[:(n * wide) ** 2]
        whole = -crossed.reshape(n, wide, n, wide)
        whole[np.arange(n), :, np.arange(n)] += h
        return (out[-1][0] - np.sum(model.subject_penalty * away ** 2) / 2,
                total[:, :wide] - model.subject_penalty * away, h, whole.reshape(n * wide, -1))
    monkeypatch.setattr(fits, "_climb", climb)
    found = fits._fit(None, model, s, 300, 1e-5)
    assert np.abs(climb(None, model, found)[1]).max() < 1e-3 * times
    return len(calls) - 1


def test_twopl_steps_lengthen_with_the_abilities(monkeypatch):
    rng = np.random.default_rng(5)
    n = 25
    y = (rng.random((n, 2500)) < 0.5).astype(float)
    pdf = pd.DataFrame({"who": [np.flatnonzero(s) for s in rng.random((2500, n)) < 0.66]})
    pdf["ys"] = [y[w, i] for i, w in enumerate(pdf["who"])]
    start = rng.normal(size=(n, 1))
    assert _passes(fits.TwoPL(), start / start.std(), pdf, 2000, monkeypatch) <= 70


def test_cold_start_of_few_subjects_moves_no_residuals(run, monkeypatch):
    cells, flat, first = run
    # the general way, of which a row per split and answer is written
    monkeypatch.setattr(coldstart, "spanned", lambda n, k: False)
    monkeypatch.setattr(residuals, "SPARE", 1)
    general = coldstart.run_cold_start(cells, flat, (1, 2), (0, 1, 3), 20, min_observed=6)
    monkeypatch.undo()

    def refused(*_):
        raise AssertionError("residuals of few subjects stay with their items")
    monkeypatch.setattr(coldstart, "train_residuals", refused)
    few = coldstart.run_cold_start(cells, flat, (1, 2), (0, 1, 3), 20, min_observed=6)
    key = lambda r: (r["split"], r["subject"], r["item_id"])
    want = {key(r): r["p"] for r in general.cells.collect()}
    got = {key(r): r["p"] for r in few.cells.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][i] == pytest.approx(want[k][i], abs=1e-9) for k in want for i in (0, 1, 3))
    scales = lambda c: sorted(map(tuple, c.scales.collect()))
    assert scales(few) == scales(general)
