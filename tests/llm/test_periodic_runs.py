"""Runs against the plain definition: every period tried at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import periodic_runs
from mercato.llm.periodic_runs import Words, find_runs, pieces, runs_of


def plain_runs(words, times=4, least=6):
    """All maximal stretches by definition; a stretch's period is the smallest one."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def random_words(rng):
    words = []
    while len(words) < rng.randint(1, 60):
        part = [rng.randint(0, rng.choice((1, 2, 5))) for _ in range(rng.randint(1, 6))]
        words += part * rng.randint(1, 6)
    return words


@pytest.mark.parametrize("times,least", [(4, 6), (2, 2), (3, 1)])
def test_runs_are_those_of_the_definition(times, least):
    rng = random.Random(times)
    for _ in range(3000):
        words = random_words(rng)
        assert runs_of(words, times, least) == plain_runs(words, times, least), words


def test_cutting_at_rare_words_loses_no_run():
    rng = random.Random(5)
    for _ in range(1000):
        texts = [random_words(rng) for _ in range(3)]
        words, owner = np.array(sum(texts, [])), np.repeat([0, 1, 2], [len(t) for t in texts])
        got = [(a + s, n, p) for a, b in pieces(words, owner, 4, 6) for s, n, p in runs_of(words[a:b].tolist())]
        want, at = [], 0
        for t in texts:
            want += [(at + s, n, p) for s, n, p in plain_runs(t)]
            at += len(t)
        assert sorted(got) == want


def test_a_hash_that_takes_all_for_equal_is_found_out(monkeypatch):
    """With the prime 3 many different stretches have one hash; runs that are returned still hold."""
    monkeypatch.setattr(periodic_runs, "PRIME", 3)
    rng, seen = random.Random(3), 0
    for _ in range(300):
        words = random_words(rng)
        text = Words(words, 2)
        seen += any(not text.holds(*r) for r in text.runs(4, 6))
    assert seen  # what the verification is there for


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), lambda n: list(range(100)) * (n // 100)])
def test_time_grows_with_the_text(make):
    def took(n):
        began = time.perf_counter()
        runs_of(make(n))
        return time.perf_counter() - began

    assert took(80_000) < 4 * 2 * max(took(20_000), 0.05)


def altered(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_over_a_whole_table(spark):
    got = {r.doc_id: tuple(r) for r in periodic_runs.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    some = 0
    for r in docs:
        words = altered(r.doc_id, r.text)
        runs = plain_runs(words)
        some += len(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[r.doc_id] == (r.doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert len(got) == len(docs) and some > 10


def test_rows_of_every_kind(spark, documents):
    docs = documents([(1, None), (2, ""), (3, " a\t b " * 5), (3, " a\t b " * 5), (None, "x " * 9), (4, "  " * 6), (5, "z " * 200_000)])
    docs = docs.withColumns({"runs": F.lit("own"), "n_words": F.lit("own"), "row": F.lit(None)})
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in find_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 10, [(0, 10, 2)], "a b"), (3, 10, [(0, 10, 2)], "a b"), (None, 9, [(0, 9, 1)], "x"), (4, 6, [(0, 6, 1)], " "), (5, 200_000, [(0, 200_000, 1)], "z")], key=str
    )
    assert find_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs, times=1)
