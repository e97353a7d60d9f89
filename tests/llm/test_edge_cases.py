"""Inputs that the test tables don't hold: colliding words, links of all kinds, clashing columns, empty and null rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import html_extract, license_scan, mix_sources, quality, simhash_copies, substring_dedup, toxicity, url_filter
from mercato.llm.common import slices
from tools.compare import rows

SF = "/root/testdata/sf0.001"


def test_words_that_differ_are_never_taken_for_equal(spark):
    """Two long words whose polynomial hashes modulo 2^64 agree (Thue-Morse); only one of 50 words differs."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_ids_that_are_no_numbers_and_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 2000)
    long = " ".join(f"v{k}" for k in range(3000))
    part = " ".join(f"v{k}" for k in range(500, 560))
    docs = spark.createDataFrame([("x", part), ("2", long), ("3", part), (None, part), ("2", part)], "doc_id string, text string")
    got = sorted((r.doc_id or "-", r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == [("-", 60, 0), ("2", 60, 0), ("2", 3000, 0), ("3", 60, 60), ("x", 60, 0)]


LINKS = [
    ("https://a.test/p/q?x=1", '<link rel="canonical" href="/es/1">', "https://a.test/es/1"),
    ("https://a.test/p/q", "<link rel=canonical href=//Example.ORG/es/2>", "https://example.org/es/2"),
    ("http://a.test/p/q", "<link href='other' rel='canonical'>", "http://a.test/p/other"),
    ("http://a.test", '<link rel="canonical" href="top">', "http://a.test/top"),
    ("http://a.test/p/q/r", '<link rel="canonical" href="../../es/./3#part">', "http://a.test/es/3"),
    ("http://a.test/p", '<link rel="canonical" href="https&#58;//example.org/es/?a=1&amp;b=2">', "https://example.org/es/?a=1&b=2"),
    ("http://a.test/m", '<meta http-equiv="refresh" content="0; url=\'https://example.org/es/4\'">', "https://example.org/es/4"),
    ("http://a.test/n?a", '<meta http-equiv=refresh content="0; URL=?b">', "http://a.test/n?b"),
    ("http://a.test/c", '<!-- <link rel="canonical" href="https://example.org/es/5"> -->', None),
    ("http://a.test/d", '<link rel="canonical" href="mailto:me@x.test">', None),
    ("no scheme", '<link rel="canonical" href="/es/6">', None),
    ("http://a.test/e", '<link data-href="/x" rel="stylesheet" href="https://example.org/es/7">', None),
]


def test_links_of_all_kinds(spark):
    pages = pd.DataFrame([(k, u, f"<html><head>{h}</head></html>") for k, (u, h, _) in enumerate(LINKS)] + [(90, None, None), (91, "https://x.example.org/es/9", "")], columns=["page_id", "url", "html"])
    df = spark.createDataFrame(pages.astype(object).where(pages.notna(), None).values.tolist(), "page_id long, url string, html string").withColumns({"rule": F.lit("mine"), "node": F.lit(1), "host": F.lit("h")})
    edges = {(r.src, r.dst) for r in url_filter.link_edges(df).collect()}
    assert edges == {(u, d) for u, _, d in LINKS if d}
    got = url_filter.filter_urls(df, url_filter.rules_frame(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict").toPandas()
    verdict = dict(zip(got.page_id, got.verdict, strict=True))
    assert [k for k, v in verdict.items() if v == "block"] and all(verdict[k] == ("block" if d and d.startswith("https://example.org/es/") else "allow") for k, (_, _, d) in enumerate(LINKS))
    con = duckdb.connect()
    con.register("pages", pages)
    assert rows(got) == rows(con.execute(url_filter.SQL).df())


def test_copyright_lines(spark):
    body = license_scan.KNOWN[0][1]
    heads = ["Copyright John Doe", "Copyright Acme Inc. 2021", "Copyright [yyyy] [name]", "© 2021 Acme", "Portions Copyright (C) 2020 Me", "Copyright (c) 2010, the copyright holders", "All rights reserved.", "(c) Somebody", " * Copyright 2001-2004 X"]
    docs = [(k, h + "\n\n" + body) for k, h in enumerate(heads)] + [(50, body.replace("copyright notice", "copyright remark")), (51, "word " * 20_000 + "\nMIT License"), (52, None), (53, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"length": F.lit(1), "digest": F.lit("x")})
    got = license_scan.scan_licenses(df, license_scan.known_digests(spark, license_scan.KNOWN)).toPandas()
    assert set(got[got.unit == "document"].doc_id) == set(range(len(heads)))
    for line in ("copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright license to reproduce", "Copyright law", "copyright owner", "copyrights"):
        assert spark.createDataFrame([(line,)], "x string").select(license_scan._form(F.col("x"))).first()[0] != ""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    assert rows(got) == rows(con.execute(license_scan.SQL).df())
    table = spark.createDataFrame([("mine", "My own words.")], "license_id string, text string")
    assert license_scan.scan_licenses(spark.createDataFrame([(1, "my OWN words")], "doc_id long, text string"), license_scan.known_digests(spark, table)).count() == 2


def test_draws_are_hypergeometric_at_every_size():
    rng = np.random.default_rng(3)
    for good, bad, n in ((3, 5, 4), (40, 60, 30), (7, 300, 100), (1, 1, 1), (1000, 2000, 500)):
        low, high = max(0, n - bad), min(good, n)
        p = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, high + 1)])
        seen = np.bincount([mix_sources._draw(rng, good, bad, n) - low for _ in range(4000)], minlength=len(p))
        often = p * 4000 > 5
        assert ((seen - 4000 * p)[often] ** 2 / (4000 * p)[often]).sum() < 3 * often.sum() + 10
    for good, bad, n in ((10**12, 3 * 10**12, 10**12), (10**15, 10**15, 10**9)):
        x, total = np.array([mix_sources._draw(rng, good, bad, n) for _ in range(2000)], float), good + bad
        sd = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
        assert abs(x.mean() - n * good / total) < 5 * sd / math.sqrt(2000) and 0.93 < x.std() / sd < 1.07
    assert mix_sources._draw(rng, 5, 0, 3) == 3 and mix_sources._draw(rng, 0, 5, 3) == 0


def test_raw_text_only_swallows_a_page():
    page = "<body><article><p>First words of the article, long enough.</p><{}><p>Last words of the article, long enough.</p></article></body>"
    for tag in ("svg", "object", "math", "template"):
        assert any("Last words" in t for _, t, _ in html_extract.leaf_blocks(page.format(tag)))
    assert not any("Last words" in t for _, t, _ in html_extract.leaf_blocks(page.format("script")))


@pytest.mark.parametrize("change", [{"bucket": 1}, {"FAMILY_BYTES": 2000}, {"SMALL": 2}])
def test_near_copies_by_other_ways_are_the_same(spark, monkeypatch, change):
    """Hot buckets, families dealt into blocks and crowded buckets give the components of the usual way."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 500, 200)]
    texts = [" ".join(f"x{k}" if rng.random() < 0.01 else w for k, w in enumerate(base)) for _ in range(120)] + [" ".join(f"q{k}" for k in rng.integers(0, 9**6, 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, simhash_copies.components_of(docs).collect()))
    if "bucket" in change:
        monkeypatch.setattr(simhash_copies, "SAMPLE", 1)
    for name, value in change.items():
        if name != "bucket":
            monkeypatch.setattr(simhash_copies, name, value)
    got = sorted(map(tuple, simhash_copies.components_of(docs, bucket=change.get("bucket", simhash_copies.BUCKET)).collect()))
    assert got == want and len({c for _, c in want}) < 120


CLASH = "doc_id long, text string, lang string, source string, n_chars long, judged string, score string, passages string, spans string, kept_text string, n_words string, n_removed string, kept_sha256 string, batch string, row string, node string, bands string, digest string, size string, block string"


def test_pipeline_stages_keep_other_columns_and_stand_odd_rows(spark):
    say = " ".join(f"s{k}" for k in range(80))
    odd = [(1, say, "en", "a", len(say)), (2, "before " + say + " after", "en", "a", len(say) + 13), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "no id here", "en", None, 10), (None, None, None, None, None)]
    extra = CLASH.count(",") - 4
    docs = spark.createDataFrame([(*r, *(f"own{k}" for k in range(extra))) for r in odd], CLASH)
    settings = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        got = after.collect()
        assert all(list(r[5:]) == [f"own{k}" for k in range(extra)] for r in got), name
        assert len(got) == (4 if name == "simhash near-dedup" else 6), name
        if name == "substring dedup":
            assert {r.doc_id: (r.text, r.n_chars) for r in got}[2] == ("before after", 12)
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    mixed = corpus_pipeline.mix(spark, docs, SF).collect()
    assert mixed and all(r.n_chars == len(r.text) for r in mixed)
    assert corpus_pipeline.mix(spark, docs.where("false"), SF).count() == 0
    assert settings == {k: spark.conf.get(k) for k in settings}


def test_scores_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words", "mine", 2.5)], "doc_id long, text string, judged string, score double")
    got = toxicity.score(docs, toxicity.Model()).first()
    assert got.judged == "mine" and 0 <= got.score <= 1 and quality.score(docs, quality.Model()).first().score == 0.5
    page = spark.createDataFrame([(1, "<p>x</p>", "mine")], "page_id long, html string, kind string")
    assert html_extract.extract(page).first().kind == "mine"


def test_slices_are_whole_and_small():
    import pyarrow as pa

    texts = ["x" * 3_000_000, None, "y" * 2_000_000, *["z"] * 1200, "w" * 9_000_000]
    got = list(slices([pa.RecordBatch.from_pydict({"text": texts})]))
    assert [t for b in got for t in b["text"].to_pylist()] == texts
    assert all(b.num_rows == 1 or (b.num_rows <= 500 and sum(len(t or "") for t in b["text"].to_pylist()) <= 4_000_000) for b in got)
