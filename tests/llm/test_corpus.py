import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from itemscope.llm import (
    components, decontamination, exact_dedup, extraction, language_model, oracles, packing, queries,
    secret_scan, sharding, simhash, token_counts, toxicity)
from itemscope.llm import common

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [None, "", "  \n ", "one", "Two words", "a b c d e f g h i j k l", "a b c d e f g h i j k l",
         "a b  c d e f g h i j k l", LONG, "<|endoftext|> it's 'so' ünï\t 12345  x\n\ny", "ΑΣ ΑΣΑ"]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [(i, t, i % 3, f"s{i % 2}", None) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", 0, "s1", None), (None, "of no id", 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, source string, n long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(rows):
    return [(r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()]


def test_token_counts_equal_the_library(odd, docs):
    library = Tokenizer.from_file(WORD)
    for table in (odd, docs):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in
                      token_counts.token_counts(table, WORD).collect())
        assert got == Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False)))
                              for i, t in plain(table))


def test_rank_synchronous_merging_of_runs_and_long_words():
    library, counter = Tokenizer.from_file(WORD), token_counts.Counter(WORD)
    words = ["a" * n for n in range(1, 40)] + ["ab" * 2000, "l" * 501, "haha" * 99 + "h", "é" * 77]
    assert counter.counts(words) == [len(library.encode(w, add_special_tokens=False)) for w in words]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or \
        ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in set(fps.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i in sorted(fps):
        least.setdefault(find(fps[i]), i)
    return {i: least[find(f)] for i, f in fps.items()}


def test_simhash_against_brute_force(odd, docs):
    for table in (odd.where("doc_id is not null"), docs):
        fps = {i: brute_fingerprint(t) for i, t in plain(table)}
        wanted = brute_components(fps)
        got = simhash.near_duplicates(table).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
        assert {r.doc_id: r.component_id for r in got} == wanted
        assert len(got) == table.count()


@pytest.mark.parametrize("compared", [64, 2])
def test_links_of_crowded_fingerprints(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(-2 ** 63, 2 ** 63 - 1, 6):
        for _ in range(60):
            f = int(base) & (2 ** 64 - 1)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(bit)
            fps.add(f)
    fps |= {0, 1 << 63, (1 << 64) - 1}
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    table = spark.createDataFrame(signed, "fp long")
    found = components.components(simhash.links(table)).collect()
    roots = {r.node: r.root for r in found}
    wanted = brute_components({f[0]: f[0] & (2 ** 64 - 1) for f in signed})
    assert all(wanted[f] == roots.get(f, f) for f, in signed)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()} == \
        {**{i: 0 for i in range(41)}, 80: 80, 90: 80}


def test_shards(odd, docs, spark):
    for table, shards in ((odd, 3), (docs, 24)):
        rows = sharding.histogram_shards(table, shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
            (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in plain(table))
        by_shard = defaultdict(list)
        for r in rows:
            by_shard[r.shard].append(r)
        assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard.values())
        sums = [sum(r.size for r in by_shard[s]) for s in range(shards)]
        mean, largest = sum(sums) / shards, max(r.size for r in rows)
        assert all(abs(s - mean) <= 0.02 * mean + largest for s in sums)
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    counts = sharding.histogram_shards(same, 4).groupBy("shard").count().collect()
    assert len(counts) == 4 and all(abs(r["count"] - 250) <= 5 for r in counts)


def test_extraction():
    page = """<html><head><title>t</title><style>p{}</style></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a>News</a></ul></nav>
    <div class="cookie-notice">We use cookies to serve you better, accept them all.</div>
    <article><h1>The &amp; head</h1><p>First <b>bold
    words</b>&nbsp;here and a long run of plain words that goes on.<p>Second, &eacute;t&#233; &lt;x&gt;
    <div class="ad">Buy this thing now</div><script>var a="</p>"</script><p>Third one</article>
    <section id="comments"><p>I liked this article very much, it was the best that I read.</p></section>
    <aside><p>Related pages</p></aside><form><input><p>Your mail</p></form><footer>(c)</footer>"""
    assert extraction.main_text(page).split("\n") == [
        "The & head", "First bold words here and a long run of plain words that goes on.",
        "Second, été <x>", "Third one"]
    assert extraction.main_text("") == extraction.main_text("<nav>a</nav>") == ""


ONE, TWO, THREE = (
    "The river rose in the night, and by the morning it had taken the lower fields. " * 3,
    "Nobody in the village had seen it so high, the old miller said when he was asked. " * 2,
    "It fell again on the third day. The fields were grey, and the road to the mill was gone. " * 2)
SITE = ('<nav><a href=/>Home</a> <a href=/n>News</a></nav><div class="cookie-banner">We use cookies to '
        'make this site better for you and for all of our many partners, please accept them.</div>')
END = ('<div id="comments"><div>What a river, I have never seen it so high, and I live here.</div></div>'
       '<div><a href=/t>Terms</a> <a href=/p>Privacy</a></div><footer>(c) The Paper</footer>')


@pytest.mark.parametrize("page, wanted", [
    # Plain elements.
    (f"<body>{SITE}<div>{ONE}</div><div>{TWO}</div><div>{THREE}</div>{END}", [ONE, TWO, THREE]),
    (f"<body>{SITE}<section><center>{ONE}</center></section><div><div>{TWO}</div></div>{END}", [ONE, TWO]),
    # Bare text of the body.
    (f"<body>{SITE}{ONE}<br><br>{TWO}<br><br>{THREE}{END}", [f"{ONE} {TWO} {THREE}"]),
    # Without spaces.
    (f"<body>{SITE}<div>{'河水在夜里上涨，到了早晨已经淹没了低处的田地。' * 9}</div>{END}",
     ["河水在夜里上涨，到了早晨已经淹没了低处的田地。" * 9]),
    # Class names that tell of the layout, and a form around the page.
    (f'<div class="no-sidebar">{SITE}<article><p>{ONE}<p>{TWO}</article>{END}</div>', [ONE, TWO]),
    (f'<form id=f><div class="page no-sidebar"><div class="sticky-menu">{SITE}<div>{ONE}</div>'
     f'<div>{TWO}</div></div>{END}</div></form>', [ONE, TWO]),
    ('<div class="no-sidebar"><article><p>A short note.</article></div>', ["A short note."]),
    # Comments, and other text of the site, that are longer than the text.
    (f'{SITE}<div>{THREE}</div><div id="comments"><div>{ONE * 3}</div><div>{TWO}</div></div>', [THREE]),
    (f'{SITE}<article><p>{THREE}</article><ol class="comments"><li><article><p>{ONE * 3}</article></ol>',
     [THREE]),
    (f'<aside><p>{ONE * 3}</aside><div>{THREE}</div><footer><div>{TWO * 3}</div></footer>', [THREE]),
    (f"<body>{SITE}<div>Welcome</div>{END}", [])])
def test_extraction_of_unmarked_pages(page, wanted):
    assert extraction.main_text(page).split("\n") == [" ".join(t.split()) for t in wanted or [""]]


def test_minimum_cut_is_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        costs = rng.normal(0, 1, n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < .6]

        def total(labels):
            return sum(-c if c < 0 and x else c if c > 0 and not x else 0
                       for c, x in zip(costs, labels)) + \
                sum(w for i, j, w in edges if labels[i] != labels[j])
        best = min(total([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert total(extraction.minimum_cut(costs, edges)) == pytest.approx(best)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<p>x</p>"), (None, "u", "")],
                                  "page_id long, url string, html string")
    assert extraction.main_texts(pages).count() == 3


def brute_katz(table):
    small, least = language_model.MAX_DISCOUNTED, language_model.LEAST_DISCOUNT
    texts = [(i, t.encode().lower().split() + ["."]) for i, t in plain(table)]
    learn = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, _ in texts]
    one, two = Counter(), Counter()
    for (_, ws), yes in zip(texts, learn):
        if yes:
            one.update(ws)
            two.update(zip([0] + ws[:-1], ws))
    n = sum(one.values())

    def factors(counts):
        return language_model._discounts([sum(c == r for c in counts.values()) for r in range(1, 8)])
    f_one, f_two = factors(one), factors(two)

    def star(c, f):
        return c * f[c - 1] if c <= small else c - least
    unknown = 1 - sum(star(c, f_one) for c in one.values()) / n

    def lower(w):
        return star(one[w], f_one) / n if w in one else unknown
    heads = defaultdict(dict)
    for (h, w), c in two.items():
        heads[h][w] = c
    size = {h: sum(ws.values()) for h, ws in heads.items()}
    back = {h: (1 - sum(star(c, f_two) for c in ws.values()) / size[h]) /
            (1 - sum(map(lower, ws))) for h, ws in heads.items()}
    for h in list(heads)[:20]:
        rest = unknown + sum(lower(w) for w in one if w not in heads[h])
        assert sum(star(c, f_two) for c in heads[h].values()) / size[h] + back[h] * rest == \
            pytest.approx(1)
    out = []
    for (i, ws), yes in zip(texts, learn):
        score = 0
        for h, w in zip([0] + ws[:-1], ws):
            c = heads[h].get(w) if h in heads else None
            score += np.log10(star(c, f_two) / size[h]) if c else \
                np.log10(back.get(h, 1) * lower(w))
        base = sum(np.log10((one[w] + 1) / (n + len(one) + 1)) for w in ws)
        out.append((str(i), not yes, len(ws), sum(w in one for w in ws), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("bucket", [48 << 20, 60_000])
def test_katz_against_brute_force(odd, docs, monkeypatch, bucket):
    monkeypatch.setattr(language_model, "BUCKET", bucket)
    for table in (odd, docs):
        got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in language_model.katz_scores(table).collect())
        wanted = brute_katz(table)
        assert [g[:5] for g in got] == [w[:5] for w in wanted]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in wanted], rtol=1e-9)


def test_packing(odd, docs):
    library = Tokenizer.from_file(BYTE)
    for table in (odd, docs):
        ids = defaultdict(list)
        for i, t in plain(table):
            ids[i].append(np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4"))
        rows = packing.packed(table, BYTE, 1024).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            assert any(zlib.crc32(a[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       and len(a) == r.doc_tokens for a in ids[r.doc_id])
            pieces[r.doc_id].append(r.length)
            sequences[r.sequence_id].append((r.offset, r.length))
        assert all(sum(pieces[i]) == sum(map(len, a)) for i, a in ids.items())
        lengths = []
        for s in sorted(sequences):
            at = 0
            for offset, length in sorted(sequences[s]):
                assert offset == at and length > 0
                at += length
            lengths.append(at)
        assert set(lengths[:-1]) <= {1024} and sorted(sequences) == list(range(len(lengths)))


def test_hilbert_neighbours_are_near():
    points = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    index = packing.hilbert(points, 3)
    walk = points[np.argsort(index)]
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_contamination_of_short_items_and_edges(spark):
    item = " ".join(f"k{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "!!"), (1, "again here"),
                                   (None, "nameless one")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "x " + " ".join(f"K{i}," for i in range(2, 12)) + " y"), (2, "a Tiny-Item b tiny item"),
        (3, " ".join(f"k{i}" for i in range(9))), (4, None), (5, ""), (6, "again here nameless one"),
        (6, "again here nameless one")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in
           decontamination.contamination(docs, bench).collect()}
    digest = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("", "1", "2")}
    assert got == {1: (12, 10, 1, digest["1"]), 2: (6, 4, 1, digest["2"]), 3: (9, 0, 0, digest[""]),
                   4: (0, 0, 0, digest[""]), 5: (0, 0, 0, digest[""]), 6: (4, 4, 1, digest["1"])}
    assert decontamination.without_contaminated(docs, bench).count() == 3
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_packing_follows_the_curve(odd, docs):
    for table in (odd, docs):
        rows = packing.tokenised(table, BYTE).collect()
        rows.sort(key=lambda r: (r.curve, r.doc_id is not None, r.doc_id, r.crc))
        ends = np.cumsum([r.n for r in rows])
        want = Counter((r.doc_id, r.n, end - r.n) for r, end in zip(rows, ends.tolist()))
        got = packing.packed(table.repartition(7), BYTE, 1024).where("start = 0").collect()
        assert Counter((r.doc_id, r.doc_tokens, r.sequence_id * 1024 + r.offset) for r in got) == want


def test_exact_duplicates(odd):
    got = exact_dedup.exact_duplicates(odd, capacity=2).collect()
    groups = defaultdict(list)
    for i, t in plain(odd):
        norm = b" ".join(t.encode().replace(b"\n", b" ").split()) if t.strip() else t.encode() and b" "
        lead = b" " if t[:1] in (" ", "\n") and t.strip() else b""
        groups[hashlib.sha256(lead + norm).hexdigest()].append(i)
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert (r.group_size, r.keep_id) == (len(groups[r.text_sha256]), min(ids, default=None))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.without_copies(odd)
    assert kept.count() == len(groups) and kept.columns == odd.columns


def test_exact_index_tells_texts_of_one_hash_apart(odd):
    few = lambda norm: F.pmod(F.length(norm), F.lit(3)).cast("long") * F.lit(1 << 61)
    rows, index = exact_dedup.dedup_index(odd, capacity=1, hashed=few)
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.h, bytes(r.sha)].append((r.doc_id is None, r.doc_id, r.row))
    found = index.collect()
    assert Counter(r.h for r in rows.collect()).most_common(1)[0][1] > 2
    assert {(r.h, bytes(r.sha)): (r.group_size, r.keep_id, r.keep_row) for r in found} == {
        k: (len(v), min(v)[1], min(v)[2]) for k, v in groups.items()}
    links = defaultdict(list)
    for r in found:
        links[r.h].append(r.link)
        assert r.bucket == (r.h % (1 << 64)) >> (64 - r.bits) if r.bits else r.bucket == 0
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in links.values()) and len(found) > len(links)
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
            for r in exact_dedup.exact_duplicates(odd).collect()}
    got = exact_dedup.exact_duplicates(odd, hashed=few).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


@pytest.fixture
def cut(spark, tmp_path):
    """A folder of files, and a function that sets into how many tasks the next reads cut it."""
    texts = [f"text {i // 2} " + " ".join(f"w{i // 2 * 31 + k}" for k in range(9)) for i in range(120)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string") \
        .repartition(7).write.parquet(f"{tmp_path}/docs")
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    spark.conf.set(names[0], "1")
    yield f"{tmp_path}/docs", lambda n: spark.conf.set(names[1], str(n))
    for name in names:
        spark.conf.unset(name)


def test_row_keys_of_two_reads(spark, cut):
    folder, tasks = cut
    tasks(1)
    rows = common.numbered(spark.read.parquet(folder))
    found = []
    for n in (1, 7):
        tasks(n)
        found.append({r.doc_id: r["__row"] for r in rows.select("doc_id", "__row").collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == 120


@pytest.mark.parametrize("module, stage, name", [
    (exact_dedup, "without_copies", "dedup-dropped"),
    (simhash, "without_near_copies", "near-dropped")])
def test_copies_go_when_reads_are_cut_anew(spark, cut, monkeypatch, module, stage, name):
    folder, tasks = cut
    tasks(1)
    plain_written = module.written

    def written(df, at):
        out = plain_written(df, at)
        if at == name:
            tasks(7)
        return out
    monkeypatch.setattr(module, "written", written)
    kept = getattr(module, stage)(spark.read.parquet(folder)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 120, 2))


def test_row_keys_where_rows_repeat(spark, cut):
    folder, _ = cut
    docs = spark.read.parquet(folder)
    for repeated in (docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))),
                     spark.read.parquet(folder, folder), docs.union(docs),
                     docs.crossJoin(spark.range(2))):
        rows = common.numbered(repeated)
        assert rows.select("__row").distinct().count() == 240 == rows.count()


def test_secrets_with_odd_rows(spark):
    texts = [None, "", 'é token = "abcdef0123"', "secret:token: abcdef", "AKIA" + "A1" * 9,
             "f" * 24, "password=12345 api_key:'aB9xY7aB9xY7aB9xY7aB9xY7'"]
    opaque = "Zx9QwErTy7UiOpAsDfGhJkLz"
    texts += [f"key {opaque} end", "share Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8"] + ["Qq1Ww2Ee3Rr4Tt5Yy6Uu7Ii8"] * 3
    docs = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in
           secret_scan.secret_spans(docs).collect()}
    assert got == {0: (0, 0, 0, ""), 1: (0, 0, 0, ""), 2: (1, 0, 0, "assign:2:21"), 3: (0, 0, 0, ""),
                   4: (0, 1, 0, "access:0:22"), 5: (0, 0, 1, "hex:0:24"), 6: (1, 0, 0, "assign:15:48"),
                   7: (0, 0, 0, "opaque:4:28"), **{i: (0, 0, 0, "") for i in range(8, 12)}}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(11)] + [(3, 0, None)],
                                 "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, some).count() == odd.count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (token_counts.token_counts(docs, WORD), simhash.near_duplicates(docs),
               sharding.histogram_shards(docs), language_model.katz_scores(docs),
               packing.packed(docs, BYTE), decontamination.contamination(docs, bench),
               exact_dedup.exact_duplicates(docs), toxicity.toxicity(docs, labels),
               secret_scan.secret_spans(docs)):
        assert df.count() == 0


def test_queries_equal_sql(spark):
    import duckdb
    from check_oracles import _rows
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in oracles.all_sql().items():
        assert _rows(queries.ALL[name](spark, SF).toPandas()) == _rows(con.sql(sql).df())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "exact_dedup":
            texts = [" ".join(t.split()) for _, t in plain(kept)]
            assert len(texts) == len(set(texts)) == len({" ".join(t.split()) for _, t in plain(before)})
        if name == "near_dedup":
            found = brute_components({i: brute_fingerprint(t) for i, t in plain(before)})
            assert {i for i, _ in plain(kept)} == set(found.values())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == \
        {i for i, _ in plain(kept)}


def _secrets_by_hand(text):
    """Base spans (kind, start, end) of a text, read one match after the other."""
    kinds = {"assign": secret_scan.ASSIGN, "access": secret_scan.ACCESS, "hex": secret_scan.HEX}
    return sorted((m.start(), list(kinds).index(kind), kind, m.end()) for kind, pattern in kinds.items()
                  for m in re.finditer(pattern, text) if kind != "assign" or len(m[2]) >= 6)


def test_secrets_of_a_long_text_with_many_matches_and_clashing_columns(spark):
    draw = random.Random(5)
    pieces = [lambda: "%024x" % draw.getrandbits(96), lambda: "é token = \"%06d\"" % draw.randrange(10 ** 6),
              lambda: "secret:ab", lambda: "AKIA" + "A1B2" * 4, lambda: "Aa1" * 9 + str(draw.random())[2:12],
              lambda: "password=" + "%030x" % draw.getrandbits(120), lambda: "plain words"]
    long = " ".join(draw.choice(pieces)() for _ in range(12_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, "", "b"), (3, None, None)],
                                 "doc_id long, text string, source string")
    for name in ("row", "owner", "hash", "found", "kind", "start", "kept", "base"):
        docs = docs.withColumn(name, F.lit("x"))
    got = {r.doc_id: r for r in secret_scan.secret_spans(docs).collect()}
    want = _secrets_by_hand(long)
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in want)
    assert len(want) > 5_000 and got[1].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == tuple(
        sum(k == kind for _, _, k, _ in want) for kind in ("assign", "access", "hex"))
    base = [(s, e) for s, _, _, e in want]
    added = [tuple(map(int, s.split(":")[1:])) for s in got[1].spans.split(",") if s.startswith("opaque")]
    alone = [m.span() for m in re.finditer(secret_scan.OPAQUE, long)
             if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9].*[0-9]", m[0])
             and not any(b < m.end() and m.start() < e for b, e in base)]
    assert added == alone and added
    assert got[2].spans == got[3].spans == ""


def test_contamination_of_a_long_text_with_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(12))
    long = ("filler words here " * 60_000) + item + (" other things" * 60_000)
    docs = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string")
    for name in ("item_id", "words", "hash", "row", "__row"):
        docs = docs.withColumn(name, F.lit("x"))
    got = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (180_000 + 12 * 1 + 120_000, 12, 1)
    assert got[1].contaminated and not got[2].contaminated and not got[3].contaminated


@pytest.mark.parametrize("prior", [0.15, 0.45])
def test_unlabelled_learning_minimises_its_risk(prior):
    """The weights found are those of least non-negative risk, by a plain search over slopes."""
    rng = np.random.default_rng(11)
    n, k = 900, 6
    toxic = rng.random(n) < prior
    has = rng.random((n, k)) < np.where(toxic[:, None], np.linspace(0.6, 0.2, k), 0.2)
    known = rng.random((300, k)) < np.linspace(0.6, 0.2, k)
    x, side = np.vstack([known, has]).astype(float), np.r_[np.ones(300, int), np.zeros(n, int)]

    def risk(w):
        f = x @ w[:-1] + w[-1]
        pos, below = f[side == 1], np.logaddexp(0, f)
        rest = below[side == 0].mean() - prior * below[side == 1].mean()
        assert rest > 0    # here the estimate of the negatives needs no bound
        return prior * np.logaddexp(0, -pos).mean() + rest + toxicity.DECAY / 2 * (w[:-1] ** 2).sum()

    weights, bias = toxicity._nnpu([np.flatnonzero(r).tolist() for r in x], side, k, prior)
    w = np.append(weights, bias)
    eye = np.eye(k + 1)
    slope = np.array([(risk(w + 1e-5 * e) - risk(w - 1e-5 * e)) / 2e-5 for e in eye])
    assert np.abs(slope).max() < 2e-3
    assert all(risk(w) <= risk(w + s * e) + 1e-6 for e in eye for s in (-0.1, 0.1))


def test_a_negative_estimate_below_zero_is_driven_back():
    """Unlabelled rows all like the positives: without the bound the risk has no least value."""
    rows, side = [[0]] * 40 + [[0]] * 40 + [[1]] * 2, np.r_[np.ones(40, int), np.zeros(42, int)]
    weights, bias = toxicity._nnpu(rows, side, 2, 0.99)
    f = np.array([weights[r[0]] + bias for r in rows])
    below = np.logaddexp(0, f)
    assert np.isfinite(f).all() and np.abs(f).max() < 30
    assert below[side == 0].mean() - 0.99 * below[side == 1].mean() > -0.2


def test_packing_remembers_few_chunks(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    known = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    batch = [f"word{i} other{i}\nline{i}" for i in range(400)]
    got = known.ids(batch)
    assert len(known.first) + len(known.spaced) <= 50 + 3
    assert got == [known._whole(text) for text in batch]
    known.forget()
    assert not known.first and not known.spaced
