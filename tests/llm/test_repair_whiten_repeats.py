import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from itemscope.llm import conversation_repair as repair, queries, suffix_dedup as suffix, whitening

SF = "/root/testdata/sf0.001"


# --- whitening

def numpy_whitening(vectors, k):
    x = [np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for v in vectors]
    fit = np.unique(np.array(x), axis=0)
    centred = fit - fit.mean(0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(fit))
    values, directions = values[::-1], directions[:, ::-1]
    z = (np.array(x) - fit.mean(0)) @ directions[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
    total = [int(s) for s in fit.sum(0)]
    deviation = [sum((len(fit) * int(a) - s) ** 2 for a, s in zip(v, total)) for v in x]
    return len(fit), z, values / values.sum(), deviation


@pytest.mark.parametrize("d", [1, 2, 7, 30])
def test_rank_one_updates_with_deflation(d):
    rng = np.random.default_rng(d)
    for trial in range(60):
        values = np.sort(rng.choice([0, 0, 1, 2.5, 1e-9, rng.random() * 10], d)).astype(float)
        vectors = np.linalg.qr(rng.normal(size=(d, d)))[0]
        u = rng.normal(size=d) * rng.choice([1e-12, 1e-3, 1, 100])
        if trial % 3 == 0:
            u = vectors[:, 0] * 3
        want = vectors @ np.diag(values) @ vectors.T + np.outer(u, u)
        got, turned = whitening.rank_one_update(values, vectors, u)
        assert np.all(np.diff(got) >= 0)
        assert np.abs(turned @ np.diag(got) @ turned.T - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(turned.T @ turned - np.eye(d)).max() < 1e-12


def test_merged_spectra_equal_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 9)) * np.arange(9) + 5
    parts = []
    for cut in (x[:3], x[3:4], x[4:150], x[150:]):
        spectrum = whitening.Spectrum(9)
        for begin in range(0, len(cut), 40):
            spectrum.block(cut[begin:begin + 40])
        parts.append(spectrum.state())
    merged = whitening.Spectrum.of(whitening._merged_spectra(9)(parts), 9)
    assert merged.count == 200 and np.allclose(merged.mean, x.mean(0), atol=1e-12)
    scatter = merged.vectors @ np.diag(merged.values) @ merged.vectors.T
    assert np.abs(scatter - np.cov(x.T, bias=True) * 200).max() < 1e-9


def test_whitening_of_a_table(spark):
    got = queries.op11_embedding_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, z, explained, deviation = numpy_whitening([r.embedding for r in rows], 16)
    assert len(got) == 16 * len(rows) and set(got.n) == {n}
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:16], explained[:16], rtol=1e-10)
    assert got.deviation.to_numpy()[::16].tolist() == deviation
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_vectors(spark):
    shape = "vec_id long, embedding array<float>, x string, n int, component double"
    rows = [(1, [0.5, 1.0, 3.0]), (1, [0.5, 1.0, 3.0]), (None, [1.5, -2.0, 3.0]), (3, [0.0, 4.0, 3.0]),
            (4, None), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [1.0, float("inf"), 2.0])]
    got = whitening.whitened(spark.createDataFrame([(*r, "a", 1, 0.5) for r in rows], shape)).collect()
    assert Counter(r.vec_id for r in got) == {1: 6, None: 3, 3: 3}
    _, z, explained, _ = numpy_whitening([v for _, v in rows[1:4]], 3)
    assert all(r.whitened is None for r in got if r.component == 3)    # the third entry never varies
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1 and r.vec_id != 1),
                       sorted(abs(z[1:, 0])))
    assert all(r.n == 3 and abs(r.explained - max(explained[r.component - 1], 0)) < 1e-9 for r in got)
    empty = spark.createDataFrame([], shape)
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [], "a", 1, 0.5)], shape)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [2.0], "a", 1, 0.5)] * 3, shape)).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(None, 0, 0, 0)] * 3
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0], "a", 1, 0.5), (2, [1.0, 2.0], "a", 1, 0.5)], shape))


# --- conversation repair

def brute_edits(rows):
    """Cheapest (cost, audit, turns) over all edits; rows are (initial, fault)."""
    best = None
    legal = lambda roles: roles == "" or roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2) \
        and roles.count("s") <= 1 and "u" in roles
    n = len(rows)
    for kinds in itertools.product(["D", "K", "Ru", "Ra"], repeat=n):
        if any(k != "D" and f in (1, 2) for k, (_, f) in zip(kinds, rows)):
            continue
        cost = sum({"D": 3, "K": 0}.get(k, 2) + (k != "D" and f == 3) for k, (_, f) in zip(kinds, rows))
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
            roles, audit = "", ""
            for i in range(n + 1):
                roles, audit = roles + gaps[i], audit + "I" * len(gaps[i])
                if i < n:
                    audit += kinds[i][0]
                    roles += {"D": "", "K": rows[i][0] or "?"}.get(kinds[i], kinds[i][1:])
            if legal(roles):
                found = (cost + 2 * sum(map(len, gaps)), audit, roles)
                best = min(best or found, found)
    return best


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n == 3 else 25):
            rows = [(rng.choice(["s", "u", "a", "u", "a", "x"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            want = brute_edits(rows)
            assert repair.cheapest_edits("".join(r for r, _ in rows), [f for _, f in rows]) == want[:2], rows


def test_blocks_give_what_one_walk_gives(monkeypatch):
    rng = random.Random(6)
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(repair, "BLOCK", 10 ** 6)
        talks = [("".join(rng.choices("suax", [1, 5, 5, 1], k=23)), rng.choices([0, 1, 2, 3], [6, 1, 1, 1], k=23))
                 for _ in range(20)]
        want = [repair.cheapest_edits(*t) for t in talks]
        monkeypatch.setattr(repair, "BLOCK", block)
        assert [repair.cheapest_edits(*t) for t in talks] == want


def brute_report(rows, conv):
    """Damage and repair of one conversation, by the words of the contract; short ones only."""
    kept = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        number = zlib.crc32(key.encode()) % 20
        text = "" if number == 1 else text.translate({ord(c): None for c in ".!?"}) if number == 2 else text
        role = "user" if number == 4 else role
        kept += [(turn, role, text)] * (0 if number == 0 else 2 if number == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in kept:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = {t for t, _, _ in kept if t is not None}
    initials = [r[:1] for _, r, _ in kept]
    cost, audit, roles = brute_edits(list(zip(initials, faults)))
    lines, i = [], 0
    roles = iter(roles)
    for letter in audit:
        if letter == "I":
            lines.append({"u": "user:", "a": "assistant:"}[next(roles)])
            continue
        if letter != "D":
            role = next(roles)
            lines.append((kept[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[role]) + ":" + kept[i][2])
        i += 1
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_of_odd_conversations(spark):
    talks = {
        1: [(0, "system", "Be."), (1, "user", "Hi?"), (3, "assistant", "Yes!  \n")],
        2: [(None, "user", "a."), (None, None, None), (5, "assistant", "cut of")],
        3: [(0, "assistant", "\t\x0b\n"), (1, "tool", "x."), (1, "tool", "x.")],
        None: [(7, "user", "é."), (2, "", "")],
        8: [(i, "user", "w " * 60_000 + ".") for i in range(2)],
        **{100 + i: [(0, "user", "u.")] for i in range(40)}}
    rows = [(c, t, r, x, "extra") for c, talk in talks.items() for t, r, x in talk]
    shape = "conv_id long, turn long, role string, text string, place string"
    table = spark.createDataFrame(rows, shape).repartition(3)
    got = repair.repair_report(repair.damaged(table), table).collect()
    want = [brute_report(talk, conv) for conv, talk in talks.items()]
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(w[-2] == "" for w in want)    # some conversation has lost all its rows
    turns = repair.repaired_turns(repair.damaged(table)).orderBy("conv_id", "place").collect()
    for report in got:
        mine = [r for r in turns if r.conv_id == report.conv_id]
        assert [r.edit for r in mine] == [c for c in report.audit if c != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() \
            == report.repaired_sha256
    empty = spark.createDataFrame([], shape)
    assert repair.repair_report(repair.damaged(empty), empty).count() == 0


# --- repeated strings

def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for _ in range(150):
        symbols = rng.choice([1, 2, 3, 50])
        text = np.array([rng.randrange(symbols) for _ in range(rng.randint(1, 300))], np.uint8)
        raw = text.tobytes()
        order = suffix.suffix_array(text)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want
        assert suffix.common_prefixes(text, order).tolist() == [0] + [
            common(raw[a:], raw[b:]) for a, b in zip(want, want[1:])]


def brute_repeats(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                covered[p:p + length] = b"\1" * length
        spans = [(k, len(list(g))) for k, g in itertools.groupby(covered)]
        yield bytes(c for c, hit in zip(t, covered) if not hit), sum(k for k, _ in spans), sum(covered)


@pytest.mark.parametrize("shard, group", [(2 << 20, 1 << 20), (1500, 1 << 20), (1500, 400), (1, 300)])
def test_repeats_equal_brute_force(spark, shard, group):
    rng = random.Random(9)
    word = lambda: rng.choice(["la", "ré", "tion", "x"]) + str(rng.randrange(300))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(40), prose(60)
    texts = [None, "", "short", "a" * 500, "ab" * 300, prose(400), "\0" * 200, prose(50) + "\0" * 150]
    texts += [prose(20) + passage + prose(20) for _ in range(12)]
    texts += [other[:rng.randrange(150, 300)] + prose(3) + other[rng.randrange(100):] for _ in range(12)]
    texts += [texts[8], texts[8], passage + other + passage]
    table = spark.createDataFrame([(i % 9 or None, t, "c") for i, t in enumerate(texts)],
                                  "doc_id long, text string, row string").repartition(5)
    got = suffix.without_repeats(table, 100, shard, group).collect()
    raw = [(t or "").encode() for t in texts]
    want = Counter((i % 9 or None, len(t), *b) for i, (t, b) in enumerate(zip(raw, brute_repeats(raw, 100))))
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans), sum(s.end - s.start for s in r.spans))
                   for r in got) == want


def test_repeats_of_nothing(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string"), length=10)


def test_long_texts_are_cut_into_pieces(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=(1 << 20) + 5000))
    at = (1 << 20) - 300     # a repeat over the cut, within one text
    text = long + long[at:at + 700]
    got = suffix.without_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in got.spans] == [(at, at + 700), (len(long), len(long) + 700)]
