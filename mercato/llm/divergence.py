"""How far sources of one language diverge in their use of words.

Two passes. The first finds the terms that stand in ``least`` documents of their language or more, which are kept: a task
counts a term's documents up to ``least`` and then passes over it, as more documents can't change the choice. It also
weighs what occurs in each of ``BUCKETS`` parts of the hash. For the second, kept terms are dealt by their hash to
shards of some ``SHARD_BYTES`` bytes, and so are the terms of the texts, in their order, padded by a delimiter on
each side. One task gets a shard's automaton (Aho-Corasick over the padded kept terms) and a share of
the texts' terms dealt to it, and counts occurrences. What comes out are sparse postings: a row for each
kept term and source that holds it. Neither the vocabulary nor a source is ever in one place; a
shard that very frequent terms make hot is dealt to several tasks by ``TASK_BYTES``, each with its own automaton.

Shares p and q are integers: 1 + floor(10^9 (n + 1) / (N + V)), n being the term's occurrences in the group, N those of all kept
terms there and V the number of kept terms. A term's divergence is floor((p - q)^2 / q). The sum over all
kept terms for a pair of sources needs postings only: terms that neither source holds all add the same, those
that one of them holds follow from how often each number of occurrences comes up there, and only those that both
hold are paired. So a term costs the square
of the number of sources that hold it, as the result itself has a row for each pair of sources.

Null text, lang and source count as ''. Empty texts make their group occur but add no term. Repeated rows
count as often as they stand. Ties rank by the other source's or the term's UTF-8 bytes. An empty table gives no rows. Very long texts
take memory in proportion to themselves. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import filterfalse, groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import cut, load, slices

LEAST, BEST = 3, 200
WHOLE = 1_000_000_000
#: Bytes of kept terms in one automaton (its nodes take some 50 bytes for each), and of texts that one task scans.
SHARD_BYTES, TASK_BYTES = 256_000, 12_000_000
#: Different terms that a task of the first pass holds before it hands its counts on.
HELD = 300_000
#: Parts of a language's terms by hash whose occurrences the first pass weighs.
BUCKETS = 4096
#: Terms whose bytes are gathered at a time.
GATHERED = 100_000
_DELIMITERS = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes to bytes: A-Z in lower case, delimiters to the space, all else as it is.
_PLAIN = bytes(32 if _DELIMITERS.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What keeps the first 0 to 8 bytes of a little-endian number, and odd numbers that mix bits.
_FIRST = np.array([256**k - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _joined(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of plain texts end to end as bytes, where their terms start and end, and how many terms each group has."""
    groups = [b" ".join(t) for t in texts]
    joined = np.frombuffer(b" ".join([b" " * 7, *groups, b" " * 8]), np.uint8)
    word = joined != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begins = 8 + np.cumsum([0, *(len(g) + 1 for g in groups)])
    return joined, starts, ends, np.diff(np.searchsorted(starts, begins))


def places(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 mixed bits of each term's length, first eight and last eight bytes. Where they agree, terms share a shard, not a count."""
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    size = ends - starts
    first = eight[starts] & _FIRST[np.minimum(size, 8)]
    last = np.where(size > 8, eight[ends - 8], 0)
    mixed = (first ^ (last + size.astype(np.uint64)) * _MIX[0]) * _MIX[1]
    mixed = (mixed ^ mixed >> np.uint64(29)) * _MIX[2]
    return mixed >> np.uint64(32)


def document_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term, bucket, n``: with a term, in how many documents of the language it stands; with a bucket, bytes of all occurrences there.

    A task counts a term up to ``least`` documents and hands it on; from then on it passes over the term. So sums
    below ``least`` are exact, and all others say that the term is kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, dict[bytes, int]] = defaultdict(dict)
        known: dict[str, set[bytes]] = defaultdict(set)
        ready: list[tuple[str, bytes]] = []
        weights: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS))

        def found(lang: str, words: list[bytes], n: list[int]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.nulls(len(words), pa.int32()), pa.array(n, pa.int64())], ["lang", "term", "bucket", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in open_.items():
                yield found(lang, list(held), list(held.values()))
            sure: dict[str, list[bytes]] = defaultdict(list)
            for lang, word in ready:
                sure[lang].append(word)
            for lang, words in sure.items():
                yield found(lang, words, [least] * len(words))
            open_.clear()
            ready.clear()

        for rows in slices(batches):
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(rows["lang"].to_pylist(), rows["text"].cast(pa.binary()).to_pylist(), strict=True):
                plain, held, passed = text.translate(_PLAIN), open_[lang], known[lang]
                texts[lang].append(plain)
                for word in set(filterfalse(passed.__contains__, plain.split())):
                    n = held.get(word, 0) + 1
                    if n < least:
                        held[word] = n
                    else:
                        held.pop(word, None)
                        passed.add(word)
                        ready.append((lang, word))
            joined, starts, ends, sizes = _joined(texts.values())
            bucket, size, upto = places(joined, starts, ends) * BUCKETS >> 32, ends - starts + 1, np.cumsum([0, *sizes])
            for lang, a, b in zip(texts, upto, upto[1:], strict=False):
                weights[lang] += np.bincount(bucket[a:b].astype(np.int64), size[a:b], BUCKETS)
            if len(ready) + sum(map(len, open_.values())) > HELD:
                yield from flush()
            if sum(map(len, known.values())) > HELD:
                known.clear()
        yield from flush()
        for lang, held in weights.items():
            some = np.flatnonzero(held)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(held[some].astype(np.int64))], ["lang", "term", "bucket", "n"])

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, term string, bucket int, n long")
    return counts.groupBy("lang", "term", "bucket").agg(F.sum("n").alias("n"))


def _place(shards: dict[str, int]):
    """Kept terms with their shard."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined, starts, ends, _ = _joined([b["term"].cast(pa.binary()).to_pylist()])
            n = np.array([shards[lang] for lang in b["lang"].to_pylist()], np.uint64)
            shard = places(joined, starts, ends) * n >> np.uint64(32)
            yield pa.record_batch([b["lang"], b["term"], pa.array(shard.astype(np.int32))], ["lang", "term", "shard"])

    return place


def _gather(joined: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return joined[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _deal(shards: dict[str, int], tasks: dict[tuple[str, int], int]):
    """Terms of the texts by shard, in their order, a space behind each: ``lang, shard, part, source, words``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts: dict[tuple[str, str], list[bytes]] = defaultdict(list)
            for lang, source, text in zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), rows["text"].cast(pa.binary()).to_pylist(), strict=True):
                if lang in shards:
                    texts[lang, source].append(text.translate(_PLAIN))
            joined, starts, ends, sizes = _joined(texts.values())
            n = np.array([shards[lang] for lang, _ in texts], np.int64)
            base = np.cumsum([0, *n])
            row = np.repeat(base[:-1], sizes) + (places(joined, starts, ends) * np.repeat(n, sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(row.astype(np.uint16) if base[-1] < 1 << 16 else row, kind="stable")
            size = ends - starts + 1
            bytes_ = np.bincount(row, size, base[-1]).astype(np.int64)
            starts, size = starts[order], size[order]
            words = np.concatenate([np.zeros(0, np.uint8), *(_gather(joined, starts[k : k + GATHERED], size[k : k + GATHERED]) for k in range(0, len(order), GATHERED))])
            some = np.flatnonzero(bytes_)
            upto = np.cumsum([0, *bytes_[some]])
            group = np.searchsorted(base, some, side="right") - 1
            lang, source = (pa.array([g[k] for g in texts], pa.string()).take(pa.array(group)) for k in (0, 1))
            shard = some - base[group]
            part = [zlib.crc32(words[a:b]) % tasks.get(of, 1) for a, b, of in zip(upto, upto[1:], zip(lang.to_pylist(), shard.tolist(), strict=True), strict=False)]
            dealt = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(words)])
            yield pa.record_batch([lang, pa.array(shard, pa.int32()), pa.array(part, pa.int32()), source, dealt], ["lang", "shard", "part", "source", "words"])

    return deal


def _scan(dealt: pa.Table, kept: pa.Table) -> pa.Table:
    """Occurrences of a shard's kept terms in the words dealt to it."""
    sources, terms_, counts = [], [], []
    if kept.num_rows and dealt.num_rows:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(kept["term"].to_pylist()):
            automaton.add_word(f" {term.encode().decode('latin-1')} ", k)
        automaton.make_automaton()
        dealt = dealt.select(["source", "words"]).sort_by("source")
        for source, rows in groupby(zip(dealt["source"].to_pylist(), dealt["words"], strict=True), itemgetter(0)):
            found = np.zeros(kept.num_rows, np.int64)
            for _, words in rows:
                hits = np.fromiter(map(itemgetter(1), automaton.iter(" " + words.as_py().decode("latin-1"))), np.int32)
                found += np.bincount(hits, minlength=kept.num_rows)
            some = np.flatnonzero(found)
            sources += [source] * len(some)
            terms_.append(some)
            counts.append(found[some])
    taken = kept.take(pa.array(np.concatenate([np.zeros(0, np.int64), *terms_])))
    n = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))
    return pa.table([taken["lang"], pa.array(sources, pa.string()), taken["term"], n], ["lang", "source", "term", "n"])


#: Rows of a side that is broadcast; beyond it Spark chooses.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def vocabulary(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, dict[str, int], dict[tuple[str, int], int]]:
    """``lang, term, shard``, the kept terms of each language dealt to shards; how many shards a language has, and tasks a shard.

    The driver gets a row for each language and each shard, never a term.
    """
    counted = cut(document_counts(docs, least).where((F.col("n") >= least) | F.col("term").isNull()))
    kept = counted.where("term is not null").select("lang", "term")
    sizes = kept.groupBy("lang").agg(F.ceil(F.sum(F.octet_length("term") + 2) / SHARD_BYTES).cast("int").alias("shards"))
    shards = {r.lang: r.shards for r in sizes.collect()}
    # A bucket's bytes count for every shard that it overlaps: one or two, unless shards outnumber buckets.
    sized = docs.sparkSession.createDataFrame(pd.DataFrame(list(shards.items()), columns=["lang", "shards"]), "lang string, shards long")
    weights = counted.where("term is null").join(small(sized), "lang").withColumn("shard", F.explode(F.expr(f"sequence(bucket * shards div {BUCKETS}, ((bucket + 1) * shards - 1) div {BUCKETS})")))
    tasks = {(r.lang, r.shard): math.ceil(r.n / TASK_BYTES) for r in weights.groupBy("lang", "shard").agg(F.sum("n").alias("n")).collect()}
    return kept.mapInArrow(_place(shards), "lang string, term string, shard int"), shards, tasks


def postings(docs: DataFrame, kept: DataFrame, shards: dict[str, int], tasks: dict[tuple[str, int], int]) -> DataFrame:
    """``lang, term, posts``: source and n, its occurrences, for each source that holds a kept term."""
    parts = docs.sparkSession.createDataFrame(pd.DataFrame([(*k, part) for k, n in tasks.items() for part in range(n)], columns=["lang", "shard", "part"]), "lang string, shard int, part int")
    dealt = docs.mapInArrow(_deal(shards, tasks), "lang string, shard int, part int, source string, words binary")
    each = kept.join(parts, ["lang", "shard"]).select("lang", "shard", "part", "term")
    key = ["lang", "shard", "part"]
    found = dealt.groupBy(*key).cogroup(each.groupBy(*key)).applyInArrow(_scan, "lang string, source string, term string, n long")
    # Dealt by term once: both groupings below find their rows together.
    summed = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("posts"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), in decimals where the product leaves 64 bits."""
    most = (2**63 - 1) // WHOLE - 1
    large = F.call_function("div", (n.cast("decimal(20,0)") + 1) * F.lit(WHOLE).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)"))
    return F.when(n < most, F.call_function("div", (n + 1) * WHOLE, total + kept)).otherwise(large.cast("long")) + 1


def far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources (part pair) and terms (part term) by divergence."""
    docs = named(docs)
    posted = cut(postings(docs, *vocabulary(docs, least)))
    each = posted.select("lang", "term", F.aggregate("posts", F.lit(0).cast("long"), lambda x, p: x + p["n"]).alias("all"), F.explode("posts").alias("post")).select("lang", "term", "all", "post.*")
    often = cut(each.groupBy("lang", "source", "n").agg(F.count("*").alias("m")))
    held = often.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("held"))
    sizes = posted.groupBy("lang").agg(F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "held", "kept")))
    groups = cut(groups.withColumn("none", F.when(F.col("total") + F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))))
    ranked = _pairs(groups, often, posted).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", _rank())
    ranked = ranked.unionByName(_terms(groups, each, best))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _pairs(groups: DataFrame, often: DataFrame, posted: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language."""
    one, other = groups.alias("a"), groups.alias("b")
    pairs = one.join(small(other), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.none").alias("p0"), F.col("b.none").alias("q0"), F.col("a.held").alias("p_held"), F.col("b.held").alias("q_held"), F.col("a.kept").alias("kept")
    )
    # As if all terms were held by neither, then by one only, then by both: each step corrects the one before.
    neither = pairs.select("lang", "source", "item", (far(F.col("p0"), F.col("q0")) * (F.col("kept") - F.col("p_held") - F.col("q_held"))).alias("value"))
    counted = often.join(small(groups), ["lang", "source"]).select("lang", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "m")
    zeros = small(groups.select("lang", F.col("source").alias("other"), F.col("none").alias("zero")))
    alone = counted.join(zeros, "lang").where("source <> other")
    first = alone.select("lang", "source", F.col("other").alias("item"), (far(F.col("p"), F.col("zero")) * F.col("m")).alias("value"))
    second = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), (far(F.col("zero"), F.col("p")) * F.col("m")).alias("value"))
    # Terms that both hold: their shares are found once a posting, and pairs are summed where they arise.
    shared = posted.where(F.size("posts") > 1).select("lang", "term", F.explode("posts").alias("post")).select("lang", "term", "post.*")
    shared = shared.join(small(groups), ["lang", "source"]).select("lang", "term", F.struct("source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.col("none").alias("p0")).alias("post"))
    lists = shared.groupBy("lang", "term").agg(F.collect_list("post").alias("posts"))
    both = lists.select("lang", "posts", F.explode("posts").alias("a"))
    both = both.select("lang", "a", F.explode(F.filter("posts", lambda x: x["source"] > F.col("a.source"))).alias("b"))

    def extra(one: str, other: str) -> Column:
        p, p0, q, q0 = (F.col(x) for x in (f"{one}.p", f"{one}.p0", f"{other}.p", f"{other}.p0"))
        return F.sum(far(p, q) - far(p, q0) - far(p0, q) + far(p0, q0))

    both = both.groupBy("lang", F.col("a.source").alias("one"), F.col("b.source").alias("other")).agg(extra("a", "b").alias("ab"), extra("b", "a").alias("ba")).withColumnsRenamed({"one": "a", "other": "b"})
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("row")).select("lang", "row.*")
    summed = neither.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def _terms(groups: DataFrame, each: DataFrame, best: int) -> DataFrame:
    """The terms that a source holds more than its language does, ranked."""
    whole = small(groups.groupBy("lang").agg(F.sum("total").alias("whole")))
    found = each.join(small(groups.select("lang", "source", "total", "kept")), ["lang", "source"]).join(whole, "lang")
    found = found.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("whole"), F.col("kept")).alias("q")).where("p > q")
    ranked = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value")).withColumn("rank", _rank())
    return ranked.where(F.col("rank") <= best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


SQL = r"""
with docs as (
    select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), words as (select id, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct id) >= 3),
sizes as (select lang, count(term) as v from (select distinct lang from docs) left join kept using (lang) group by lang),
posted as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term),
grid as (
    select g.lang, g.source, k.term, coalesce(n, 0) as n
    from (select distinct lang, source from docs) g join kept k on g.lang = k.lang
    left join posted p on p.lang = g.lang and p.source = g.source and p.term = k.term
), shares as (
    select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) as p
    from grid join sizes using (lang)
), whole as (
    select lang, term, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) as q
    from (select lang, term, sum(n) as n from grid group by lang, term) join sizes using (lang)
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
    from (select distinct lang, source from docs) a join (select distinct lang, source from docs) b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source
    left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by a.lang, a.source, b.source
), tops as (
    select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value
    from shares join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
    select *, row_number() over (partition by part, lang, source order by value desc, item) as rank from (select * from pairs union all select * from tops)
) where part = 'pair' or rank <= 200
"""
