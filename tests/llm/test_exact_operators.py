"""Operators with exact answers against brute force and SQL."""

import hashlib
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from mercato.llm import ann, license_scan, mix_sources, registry, simhash, substring_dedup, url_filter
from tools.compare import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def removed_by_brute_force(docs, n=substring_dedup.WINDOW):
    """{doc_id: (words, kept words)}; every window is looked up in all documents with smaller ids."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs if i is not None]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def repeated_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 75, 120, 400)]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, max(0, len(p) - 45))
            body += p[lo : lo + rng.choice([len(p), 60])] + text(rng.randint(0, 30))
        docs.append((i * 7 % 61, rng.choice([" ", "\n", "\t "]).join(body)))
    return [*docs, (100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "w1 " * 300), (105, "w1 " * 120), (106, "a b\x1c" * 40)]


@pytest.mark.parametrize(("seed", "batch"), [(1, 2000), (2, 500), (3, 10**7)])
def test_substrings_equal_brute_force(documents, monkeypatch, seed, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    docs = repeated_corpus(seed)
    got = substring_dedup.dedup_substrings(documents(docs)).collect()
    want = removed_by_brute_force(docs)
    assert len(got) == len(docs)
    for r in got:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        if r.n_removed:
            assert r.kept_text.encode().split() == kept


def test_substrings_edge_rows(spark, documents):
    long = " ".join(f"x{k}" for k in range(70))
    rows_ = [(None, long, "e"), (None, None, "e"), (5, long, "e"), (5, long, "f"), (9, long, None)]
    got = {(r.doc_id, r.batch): r.n_removed for r in substring_dedup.dedup_substrings(documents(rows_, ", batch string")).collect()}
    assert got == {(None, "e"): 0, (5, "e"): 0, (5, "f"): 0, (9, None): 70}
    assert substring_dedup.dedup_substrings(documents([])).count() == 0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark, documents):
    rng = random.Random(4)
    texts = [None, "", "One", "Ä b", "A B c", "a b c d", *[" ".join(rng.choice("ab cd ef Gh".split()) for _ in range(n)) for n in (5, 50, 9000)]]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(documents(list(enumerate(texts)))).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    one = documents([(1, "x y z")]).select(F.xxhash64("text")).first()[0] & (1 << 64) - 1
    assert one == xxhash.xxh64_intdigest(b"x y z", 42)


def test_masks_cover_every_pair():
    rng = random.Random(5)
    for fixed in (0, sum(1 << b for b in range(0, 64, 2)), (1 << 40) - 1):
        family = simhash.masks(fixed)
        free = [b for b in range(64) if not fixed >> b & 1]
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(free, rng.randint(1, 3)))
            assert any(diff & m == 0 for m in family)


@pytest.mark.parametrize("bucket", [8192, 8])
def test_links_connect_what_all_pairs_would(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(6)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    mine = {f: f for f in fps}

    def find2(f):
        while mine[f] != f:
            f = mine[f]
        return f

    for r in links:
        a, b = r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1
        assert (a ^ b).bit_count() <= 3
        mine[find2(a)] = find2(b)
    groups = lambda f: {frozenset(x for x in fps if f(x) == f(y)) for y in fps}
    assert groups(find) == groups(find2)


def test_components_edge_rows(documents):
    text = "one two three four five six"
    rows_ = [(7, text), (3, text.upper()), (3, text), (None, text), (8, None), (9, ""), (None, "lonely words stand here")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.components_of(documents(rows_)).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (None, 3), (8, 8), (9, 8), (None, None)], key=str)
    kept = simhash.keep_one(documents([(*r, "x") for r in rows_], ", fp string")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([3, 8, None, None], key=str)
    assert simhash.components_of(documents([])).count() == 0


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 900, None: 50}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 0}, {"x": 5}, {"é": 7, "z": 9, "": 3, None: 0}])
def test_targets_equal_water_filling(spark, sizes):
    got = {r.source: r.target for r in mix_sources.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_splitting_is_exact_and_fair():
    import numpy as np

    sizes = np.array([5, 0, 100, 30, 7, 900, 58])
    draws = np.array([mix_sources.split_quota(sizes, 400, f"s{k}") for k in range(400)])
    assert (draws.sum(1) == 400).all() and (draws <= sizes).all()
    assert np.abs(draws.mean(0) - 400 * sizes / sizes.sum()).max() < 2
    assert (mix_sources.split_quota(sizes, 400, "s1") == draws[1]).all()
    assert mix_sources._draw(np.random.default_rng(0), 10**12, 10**12, 10**9) <= 10**9


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "a", "b", "c", None]), "q") for i in range(800)] + [(None, "x y", "b", "q"), (5, None, "b", "q"), (6, "r s t", "b", "q"), (6, "r s t", "b", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, quota string")
    sizes = df.select("doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).cast("long").alias("size"))
    first, again = (sorted(map(tuple, mix_sources.draw(sizes, block_docs=3).select("doc_id", "source", "size", "taken", "target").collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(docs)
    by = {}
    for _, s, n, taken, target in first:
        assert 0 <= taken <= 3 * n
        by.setdefault(s, [0, target])[0] += taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    mixed = mix_sources.mix(df, block_docs=3).collect()
    assert all(len(r.text.split()) == r.taken and r.quota == "q" for r in mixed)
    assert sum(r.taken for r in mixed) == sum(x[3] for x in first)
    assert mix_sources.draw(sizes.where("false")).count() == 0


def test_mix_splits_quotas_over_shards(spark):
    """What a source draws in a shard is what the tree gave it, near the shard's share, and sums to the quota."""
    rng = random.Random(3)
    rows = [(i, "a" if i % 3 else "b", rng.randint(1, 60)) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mix_sources.draw(sizes, n_shards=8, block_docs=40).collect()
    words, drawn = {}, {}
    for r in got:
        words[r.source, r.shard] = words.get((r.source, r.shard), 0) + r.size
        drawn[r.source, r.shard] = drawn.get((r.source, r.shard), 0) + r.part
    assert len(words) == 16 and {s for _, s in words} == set(range(8))
    for source in ("a", "b"):
        total = sum(n for (s, _), n in words.items() if s == source)
        quota = sum(n for (s, _), n in drawn.items() if s == source)
        target = next(r.target for r in got if r.source == source)
        assert quota == round(target) - int(target // total) * total and quota > 0
        for shard in range(8):
            n, q = words[source, shard], drawn[source, shard]
            deviation = (quota * n / total * (1 - n / total) * (total - quota) / (total - 1)) ** 0.5
            assert abs(q - quota * n / total) <= 5 * deviation
    plan = spark.createDataFrame([(1, s, 0, words["a", s]) for s in range(8)], "source_no long, shard long, block long, words long")
    split = mix_sources.shard_quotas(plan, spark.createDataFrame([(1, 5000)], "source_no long, quota long"), 8).collect()
    assert sum(r.quota for r in split) == 5000 and all(0 <= r.quota <= words["a", r.shard] for r in split)


def test_mix_deals_rows_without_an_id_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w{k} x y", "a") for k in range(3000)] + [(k, "b c", "b") for k in range(3000)], "doc_id long, text string, source string")
    mixed = mix_sources.mix(docs, n_shards=8, block_docs=40)
    per_shard = [r["count"] for r in mixed.where("source = 'a'").groupBy("shard").count().collect()]
    assert len(per_shard) == 8 and max(per_shard) < 2 * min(per_shard)
    once, again = (sorted((r.text, r["copy"], r.shard) for r in mix_sources.mix(docs.repartition(n), n_shards=8, block_docs=40).where("source = 'a'").collect()) for n in (3, 5))
    assert once == again


PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "https://A.Example.org/es/x#f", '<link href="https://b.com/q" rel="canonical">'),
    (2, "https://b.com/q", None),
    (3, "https://b.com/q#top", ""),
    (4, "https://ok.org/1", '<meta http-equiv="refresh" content="0; url=https://c.net/z">'),
    (5, "https://c.net/z", '<link rel=canonical href="https://example.org/es/y">'),
    (6, None, "x"),
    (7, "no scheme", "x"),
    (2, "https://b.com/q", None),
    (8, "http://x.com/de/1?y=/fr/", None),
    (9, "http://x.com/fr/", None),
    (10, "https://www.example.org/en/12", None),
    (11, "https://notexample.org/es/1", None),
]


def test_url_verdicts(spark):
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(ROWS, PAGES), rules).na.fill("-").collect())
    assert got == sorted(
        [
            (1, "a.example.org", "example.org/es/", "block"),
            (2, "b.com", "-", "block"),
            (2, "b.com", "-", "block"),
            (3, "b.com", "-", "block"),
            (4, "ok.org", "org/", "allow"),
            (5, "c.net", "-", "allow"),
            (6, "", "-", "allow"),
            (7, "", "-", "allow"),
            (8, "x.com", "com/de/", "block"),
            (9, "x.com", "com/fr/", "allow"),
            (10, "www.example.org", "example.org/en/1", "block"),
            (11, "notexample.org", "org/", "allow"),
        ]
    )
    more = spark.createDataFrame([("https://c.net/far", "https://example.org/es/y"), (None, "x")], "src string, dst string")
    pages = spark.createDataFrame([(1, "https://c.net/far", None)], PAGES)
    assert url_filter.filter_urls(pages, rules, more).first().verdict == "block"
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_licences(spark, documents):
    from mercato.llm.license_texts import KNOWN, MIT

    loud = "# Copyright (c) 2020, 2021 Somebody\n\n" + MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    rows_ = [(1, loud), (2, "prose\nReleased under the mit licence!\n..."), (3, None), (4, ""), (5, MIT[:-10]), (2, "Released under the MIT License."), (None, MIT)]
    found = license_scan.scan_licenses(documents([(*r, "d") for r in rows_], ", digest string"), license_scan.known_digests(spark, KNOWN))
    got = sorted(((r.doc_id, r.unit, r.line_no, r.license_id) for r in found.collect()), key=str)
    assert got == sorted([(1, "document", 0, "MIT"), (2, "line", 2, "MIT"), (2, "document", 0, "MIT"), (2, "line", 1, "MIT"), (None, "document", 0, "MIT")], key=str)


@pytest.mark.parametrize("shard", [8192, 60])
def test_neighbours(spark, monkeypatch, shard):
    import numpy as np

    monkeypatch.setattr(ann, "SHARD", shard)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[200:240] = x[5]  # a large class of equal vectors
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None]), (None, [1.0] * 16), (20, [float(v) for v in x[20]]), (1080, [1.0, 2.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 300, 20))
    x64, hits = x.astype(float), 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        s = x64 @ x64[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        mine = [found[k][0] for k in range(1, 21)]
        hits += len(set(want) & set(mine))
        assert mine == sorted(mine, key=lambda i: (-s[i], i)) and all(abs(found[k][1] - s[found[k][0]]) < 1e-9 for k in found)
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
