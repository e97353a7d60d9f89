"""Periodic runs: stretches of a text in which the same words come round again and again.

A run is a stretch of words with smallest period q, at least ``times`` * q and ``least`` words long,
that no neighbouring word extends. Every such run begins at a copy of its Lyndon root, the
smallest rotation of its period under one of the two orders of words. So for either order a stack is built from right to
left: what it holds at a word is the longest Lyndon word that begins there, and the first copy of each root is
extended to both sides. Words are compared directly first and then by a rolling hash modulo
2^61 - 1: a binary search finds the longest common extension. The words of every run that is
returned are verified one by one; if the hash has failed, another base is taken. A text of n words takes n log n
steps, even if all its words are equal.

Before that, words that can't lie in any run are taken out: in a run of ``times`` periods every word
stands at least ``times`` times. So a text is cut at its rarer words, then each piece at the words that are
rare in it, until pieces hold none or are shorter than ``least``. No run reaches over such a cut, so this
loses nothing, and of ordinary prose next to nothing is left for the stack.

Each text is judged by itself in the task that read it; no row moves. Null and empty texts have no
words and no runs; repeated rows get the same runs; ties don't arise, as runs are sorted by start, then
period. Very long texts take memory in proportion to themselves. Other columns stay as they
are; own columns named n_words, runs or collapsed_text are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import WORD, load, schema_with, slices

TIMES, LEAST = 4, 6
PRIME = (1 << 61) - 1
#: Words that are compared one by one before the hash is asked.
DIRECT = 4
#: Most rounds of cutting at rare words; what is left then goes to the stack as it is.
ROUNDS = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Words:
    """Numbered words with the hashes of all prefixes."""

    def __init__(self, words: list[int], base: int):
        self.words, self.n = words, len(words)
        self.sums, self.powers = [0], [1]
        total, power = 0, 1
        for w in words:
            total, power = (total * base + w + 1) % PRIME, power * base % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def same(self, i: int, j: int, length: int) -> bool:
        """Whether by their hashes the words from i and from j are equal."""
        sums, power = self.sums, self.powers[length]
        return (sums[i + length] - sums[j + length] - (sums[i] - sums[j]) * power) % PRIME == 0

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        words, most, known = self.words, self.n - j, 0
        while known < most and known < DIRECT:
            if words[i + known] != words[j + known]:
                return known
            known += 1
        step = DIRECT
        while known + step <= most and self.same(i + known, j + known, step):
            known += step
            step *= 2
        step = min(step, most - known + 1)  # that many aren't all equal
        while step > 1:
            half = step // 2
            if self.same(i + known, j + known, half):
                known += half
                step -= half
            else:
                step = half
        return known

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        words, most, known = self.words, i, 0
        while known < most and known < DIRECT:
            if words[i - 1 - known] != words[j - 1 - known]:
                return known
            known += 1
        step = DIRECT
        while known + step <= most and self.same(i - known - step, j - known - step, step):
            known += step
            step *= 2
        step = min(step, most - known + 1)
        while step > 1:
            half = step // 2
            if self.same(i - known - half, j - known - half, half):
                known += half
                step -= half
            else:
                step = half
        return known

    def lyndon_ends(self, sign: int) -> list[int]:
        """For each word the end of the longest Lyndon word that begins there, in the order of the numbers times ``sign``."""
        words, n, ahead = self.words, self.n, self.ahead
        ends = [n] * n
        for i in range(n - 2, -1, -1):
            j, first = i + 1, words[i]
            while j < n:
                other = words[j]
                if first == other:
                    k = ahead(i, j)
                    if j + k == n:
                        break
                    if (words[i + k] - words[j + k]) * sign > 0:
                        break
                elif (first - other) * sign > 0:
                    break
                j = ends[j]
            ends[i] = j
        return ends

    def runs(self, times: int, least: int) -> set[tuple[int, int, int]]:
        """(start, end, period) of every run."""
        words, n, found = self.words, self.n, set()
        for sign in (1, -1):
            reached: dict[int, int] = {}  # by period: the end of the last run seen
            for i, j in enumerate(self.lyndon_ends(sign)):
                p = j - i
                if j >= n or words[i] != words[j] or reached.get(p, -1) >= j:
                    continue
                start, end = i - self.behind(i, j), j + self.ahead(i, j)
                reached[p] = end
                if end - start >= max(least, times * p):
                    found.add((start, end, p))
        return found

    def holds(self, start: int, end: int, p: int) -> bool:
        """Whether the words themselves make this a run that can't be extended."""
        words = self.words
        inner = words[start : end - p] == words[start + p : end]
        return inner and (start == 0 or words[start - 1] != words[start - 1 + p]) and (end == self.n or words[end] != words[end - p])


def runs_of(words: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbered words, sorted by start, then period; ``times`` is 2 or more."""
    for base in count(1_000_003, 7_654_321):
        text = Words(words, base)
        found = text.runs(times, least)
        if all(text.holds(*run) for run in found):
            return sorted((start, end - start, p) for start, end, p in found)
    raise AssertionError


def pieces(words: np.ndarray, owner: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Ranges of ``words`` outside of which no run lies; none crosses from one owner to another."""
    at, part, kinds = np.arange(len(words)), owner, int(words.max(initial=0)) + 1
    for _ in range(ROUNDS):
        if not len(at):
            return []
        _, place, n = np.unique(part.astype(np.int64) * kinds + words[at], return_inverse=True, return_counts=True)
        often = n[place] >= times
        old = part[often]
        at = at[often]
        fresh = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(old) != 0)])[: len(at)]
        part = np.cumsum(fresh) - 1
        long = np.bincount(part, minlength=1)[part] >= least
        settled = often.all() and long.all()
        at, part = at[long], part[long]
        if settled:
            break
    edges = np.flatnonzero(np.diff(part)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(at)]])
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, ends, strict=True) if b > a]


def find_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words) and collapsed_text.

    collapsed_text holds one period of every run: the words that no run contains behind its first
    period, joined by single spaces.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    kept = docs.drop("n_words", "runs", "collapsed_text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in rows["text"].to_pylist()]
            number: dict[bytes, int] = defaultdict(count().__next__)
            words = np.fromiter((number[w] for t in texts for w in t), np.int64)
            sizes = np.array([len(t) for t in texts])
            first = np.concatenate([[0], np.cumsum(sizes)])
            runs: list[list] = [[] for _ in texts]
            for a, b in pieces(words, np.repeat(np.arange(len(texts)), sizes), times, least):
                k = int(np.searchsorted(first, a, side="right")) - 1
                runs[k] += [(a - int(first[k]) + start, length, p) for start, length, p in runs_of(words[a:b].tolist(), times, least)]
            collapsed = []
            for found, text in zip(runs, texts, strict=True):
                found.sort(key=lambda r: (r[0], r[2]))
                keep = bytearray(b"\1") * len(text) if found else b""
                for start, length, p in found:
                    keep[start + p : start + length] = bytes(length - p)
                collapsed.append(b" ".join([w for w, stays in zip(text, keep, strict=True) if stays] if found else text).decode("utf-8", "replace"))
            spans = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            rows = rows.append_column("n_words", pa.array(sizes, pa.int64())).append_column("runs", pa.array(spans, pa.list_(_RUN)))
            yield rows.append_column("collapsed_text", pa.array(collapsed, pa.string()))

    return kept.mapInArrow(judge, schema_with(kept, n_words="long", runs="array<struct<start:long,length:long,period:long>>", collapsed_text="string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the documents, chosen by the hash of their ids, its end repeats a stretch of itself."""
    h = F.crc32(doc_id.cast("decimal(38,0)").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(copies, 1, n - a)), " ")

    # A list of one list, so that the words are found once however often they are used.
    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeated)
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), F.get(found, F.lit(0))).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones that of the smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        here, there = run["length"].cast("decimal(38,0)") * best["period"], best["length"].cast("decimal(38,0)") * run["period"]
        return F.when(best.isNull() | (here > there), run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed_text", strongest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
