"""Benchmark decontamination: an exact filter on rare words, then Smith-Waterman alignment.

Words are compared without case (A-Z) and ASCII punctuation. A local alignment of words (match 2,
mismatch -1, gap -1) gives score / (2 x words of the item); a document with a score of at least
``THRESHOLD`` is contaminated.

An alignment of share r of an item of L words matches at least r L of them within (3 - 2 r) L words
of the document, so it leaves out at most L - r L places of the item. Of any L - r L + t places it
matches t or more. The rarest places of an item, by counts over all documents, are its seeds;
wherever so many hits stand so close, the passage around them is aligned. The counts only decide
what is compared, so no document that reaches the threshold is missed, whatever its edits are.

Only the items travel to the executors, some ``CHUNK_BYTES`` of them at a time; a larger benchmark is
worked off in chunks, each with two passes over the documents. Texts are read where they are and never
shuffled; documents are keyed by the digest of their text, so what leaves a task is one row for each
passage that was aligned.

Defined results: null and empty texts are clean (score 0, null item); a text of any length is
searched whole; scores are exact from the threshold on, and below it are those of the passages that
were aligned (0 and a null item without any, as where too few words agree); null, empty and repeated
items are judged like others, items without words never match; of equal scores the smallest item_id
counts; repeated rows get equal results; an empty table on either side gives clean documents or no
rows; a null doc_id is kept; extra columns, whatever their names, are ignored by ``judge`` and kept
by ``drop_leaks``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import cut, load, slices
from mercato.llm.toxicity import tokens

THRESHOLD = 0.5
CHUNK_BYTES = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the alignment tables that are worked on at once.
CELLS = 1_000_000
#: An item has further seeds, and needs as many more hits, while each is at most this share of all words.
COMMON = 4e-3
#: Seed hits that are looked at at once, but whole documents.
HITS = 2_000_000
#: Passages of an Arrow batch.
PASSAGES = 5000


class Places:
    """The words of some texts as numbers of items' words (-1: none), one text after the other."""

    def __init__(self, texts: list, number: dict[bytes, int]):
        self.texts = [tokens(t or "") for t in texts]
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.first = np.concatenate([[0], np.cumsum(size)])
        words = itertools.chain.from_iterable(self.texts)
        self.word = np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int64, int(self.first[-1]))
        self.doc = np.repeat(np.arange(len(self.texts)), size)


class Seeds:
    """The words of some items, and after ``rare`` the items that each word is a seed of."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.items = [(i, w) for i, t in items if (w := tokens(t or ""))]
        self.number: dict[bytes, int] = {}
        word = [self.number.setdefault(x, len(self.number)) for _, w in self.items for x in w]
        self.length = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.table = pd.DataFrame({"item": np.repeat(np.arange(len(self.items)), self.length), "word": np.array(word, np.int64)})
        # How often an item holds each of its words, by item and word.
        self.held, self.times = np.unique(self.table.item.to_numpy() * len(self.number) + self.table.word.to_numpy(), return_counts=True)
        # Matches that a score of the threshold needs, and the words of a document that it can extend over.
        self.least = np.maximum(np.ceil(threshold * self.length - 1e-9), 1).astype(int)
        self.reach = np.maximum(np.floor(3 * self.length - 2 * threshold * self.length + 1e-9), self.length).astype(int)

    def rare(self, count: np.ndarray, total: int) -> None:
        """Picks the seeds by the ``count`` of each word among ``total`` words."""
        t = self.table.assign(n=count[self.table.word]).sort_values(["item", "n", "word"])
        item = t.item.to_numpy()
        rank = t.groupby("item").cumcount().to_numpy()
        first = (self.length - self.least)[item]  # so many places may stay without a match
        use = (rank <= first) | (t.n.to_numpy() <= COMMON * total)
        self.need = np.bincount(item[use], minlength=len(self.items)) - (self.length - self.least)
        pairs = t[use].drop_duplicates(["word", "item"]).sort_values(["word", "item"])
        self.of = pairs.item.to_numpy(np.int64)
        self.start = np.searchsorted(pairs.word.to_numpy(), np.arange(len(self.number) + 1))

    def passages(self, words: Places) -> Iterator[tuple[np.ndarray, ...]]:
        """Items, first words and ends of all passages that can reach the threshold, in pieces."""
        at = np.flatnonzero(words.word >= 0)
        k = words.word[at]
        fan = self.start[k + 1] - self.start[k]
        at, k, fan = at[fan > 0], k[fan > 0], fan[fan > 0]
        upto = np.concatenate([[0], np.cumsum(fan)])
        a = 0
        while a < len(at):
            z = int(np.searchsorted(upto, upto[a] + HITS))
            if z < len(at):  # whole documents
                z = int(np.searchsorted(at, words.first[words.doc[at[z]]]))
                z = z if z > a else int(np.searchsorted(at, words.first[words.doc[at[a]] + 1]))
            yield self._enough(words, *self._near(words, at[a:z], k[a:z], fan[a:z]))
            a = z

    def _near(self, words: Words, at: np.ndarray, k: np.ndarray, fan: np.ndarray) -> tuple[np.ndarray, ...]:
        skip = np.cumsum(fan) - fan
        item = self.of[np.repeat(self.start[k] - skip, fan) + np.arange(int(fan.sum()))]
        at = np.repeat(at, fan)
        key = words.doc[at] * len(self.items) + item
        order = np.argsort(key, kind="stable")
        key, at, item = key[order], at[order], item[order]
        last = np.arange(len(key)) + self.need[item] - 1
        inside = np.minimum(last, len(key) - 1)
        close = np.flatnonzero((last < len(key)) & (key[inside] == key) & (at[inside] - at < self.reach[item]))
        key, item, reach = key[close], item[close], self.reach[item[close]]
        doc = words.doc[at[close]]
        lo = np.maximum(at[inside[close]] - reach + 1, words.first[doc])
        hi = np.minimum(at[close] + reach, words.first[doc + 1])
        # Passages of one item that overlap are one.
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] > hi[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(key)) - 1 if len(first) else first
        return item[first], lo[first], hi[end]

    def _enough(self, words: Places, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """The passages that hold as many of their item's words as its threshold needs, in any order."""
        keep, at = np.zeros(len(item), bool), 0
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        while at < len(item):
            to = max(int(np.searchsorted(upto, upto[at] + HITS, side="right")) - 1, at + 1)
            size = (hi - lo)[at:to]
            place = np.arange(int(size.sum())) + np.repeat(lo[at:to] - (np.cumsum(size) - size), size)
            own, word = np.repeat(np.arange(at, to), size), words.word[place]
            own, word = own[word >= 0], word[word >= 0]
            key, n = np.unique(own * len(self.number) + word, return_counts=True)
            own = key // len(self.number)
            key = item[own] * len(self.number) + key % len(self.number)
            k = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
            matched = np.bincount(own - at, np.where(self.held[k] == key, np.minimum(n, self.times[k]), 0), to - at)
            keep[at:to] = matched >= self.least[item[at:to]]
            at = to
        return item[keep], lo[keep], hi[keep]


def align(passages: list[bytes], items: list[bytes]) -> np.ndarray:
    """Smith-Waterman score of each passage with its item, all pairs at once."""
    pairs = [(p.split(), q.split()) for p, q in zip(passages, items, strict=True)]
    wide, high = max((len(p) for p, _ in pairs), default=0), max((len(q) for _, q in pairs), default=0)
    code: dict[bytes, int] = {}
    left, right = np.full((len(pairs), wide), -1), np.full((len(pairs), high), -2)
    for k, (p, q) in enumerate(pairs):
        left[k, : len(p)] = [code.setdefault(w, len(code)) for w in p]
        right[k, : len(q)] = [code.setdefault(w, len(code)) for w in q]
    slope = -GAP * np.arange(1, wide + 1, dtype=np.int32)
    row = np.zeros((len(pairs), wide + 1), dtype=np.int32)
    best = np.zeros(len(pairs), dtype=np.int32)
    for j in range(high):
        step = np.where(left == right[:, j : j + 1], MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        # Gaps along the passage: a running maximum of scores with the gap costs added back.
        row[:, 1:] = np.maximum.accumulate(new + slope, axis=1) - slope
        if wide:
            best = np.maximum(best, row[:, 1:].max(axis=1))
    return best


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / CHUNK_BYTES * 1.2))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if part:
            yield [(r.item_id, r.text) for r in part]


def leak_scores(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``digest, item_id, score``: the best item of every distinct text that has one of at least the threshold, and of some others."""
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text")
    found = None
    for chunk in _chunks(benchmark):
        seeds = Seeds(chunk, threshold)
        if not seeds.items:
            continue

        def count(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            # The last number counts all words.
            total = np.zeros(len(seeds.number) + 1, np.int64)
            for b in slices(batches):
                word = Places(b["text"].to_pylist(), seeds.number).word
                total[:-1] += np.bincount(word + 1, minlength=len(total))[1:]
                total[-1] += len(word)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"seed": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

        counted = texts.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(len(seeds.number) + 1, np.int64)
        n[counted.seed.to_numpy(int)] = counted.n.to_numpy(int)
        seeds.rare(n[:-1], int(n[-1]))
        scored = _score(texts, seeds)
        found = scored if found is None else found.union(scored)
    if found is None:
        item = benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"digest string, item_id {item}, score double")
    # Cut, so that the join on it reads two plain shuffles: only then can Spark split the rows of a text that stands very often.
    return cut(found.groupBy("digest").agg(F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"), F.max("score").alias("score")))


def _score(texts: DataFrame, seeds: Seeds) -> DataFrame:
    items = [b" ".join(w) for _, w in seeds.items]

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, digests = Places(b["text"].to_pylist(), seeds.number), b["digest"].to_pylist()
            for item, lo, hi in seeds.passages(words):
                for at in range(0, len(item), PASSAGES):
                    part = slice(at, at + PASSAGES)
                    doc = words.doc[lo[part]]
                    ends = zip(doc.tolist(), (lo[part] - words.first[doc]).tolist(), (hi[part] - words.first[doc]).tolist(), strict=True)
                    yield from _scores([(digests[d], b" ".join(words.texts[d][a:z])) for d, a, z in ends], item[part].tolist())

    def _scores(found: list[tuple[str, bytes]], number: list[int]) -> Iterator[pa.RecordBatch]:
        # Pairs of similar size share a table of bounded size.
        order = sorted(range(len(number)), key=lambda r: len(found[r][1]) * len(items[number[r]]))
        out: list[float] = [0.0] * len(number)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(found[order[to]][1]) < CELLS:
                to += 1
            part = order[at:to]
            best = align([found[r][1] for r in part], [items[number[r]] for r in part])
            for r, s in zip(part, best.tolist(), strict=True):
                out[r] = s / (MATCH * int(seeds.length[number[r]]))
            at = to
        yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in found], pa.string()), "number": pa.array(number, pa.int64()), "score": pa.array(out, pa.float64())})

    ids = texts.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(seeds.items)], "number long, item_id long")
    return (
        texts.mapInArrow(passages, "digest string, number long, score double")
        .join(ids, "number")
        .select("digest", "item_id", "score")
    )


def judge(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id (null without an aligned passage), score and contaminated of every row of ``docs(doc_id, text)``."""
    keys = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    scores = keys.join(leak_scores(docs, benchmark, threshold), "digest", "left")
    score = F.coalesce("score", F.lit(0.0))
    return scores.select("doc_id", "item_id", score.alias("score"), (score >= threshold).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = leak_scores(docs, benchmark, threshold).where(F.col("score") >= threshold).select(F.col("digest").alias("__leak"))
    return docs.join(bad, F.sha2(docs["text"], 256) == F.col("__leak"), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
