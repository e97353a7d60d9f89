"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources, by code point with null last, weigh ``weights`` in turn and share the total number of
   words; a target stops at ``max_repeat`` times its source's size and the excess is shared again.
2. A source gives ``floor(target / size)`` whole copies of everything and one partial draw of the
   remaining words.
3. Documents fall into output shards and, within a shard, into virtual blocks by seeded hashes, many
   per source, so that no source, however large, is one group. The partial draw is an exact quota of
   words. A tree of hypergeometric draws splits it over the output shards, by what the source has in
   each, and then every shard's part over the shard's blocks, ``FANOUT`` children at a time.
4. A block permutes its documents by a seeded hash and takes words until its quota is used up; the
   document on the boundary gives its first words only. Blocks are disjoint and each belongs to
   one output shard, in which the copies are ordered by a seeded hash.

Defined results: a null text has size 0; documents without words take 0; a null source is a source
of its own, last; a null doc_id is kept and drawn like any other, and such rows are dealt by their
texts; repeated rows are drawn one by one; an empty table gives no rows; columns other than doc_id, text and source are kept by ``mix``
unless they clash with its own names, which it replaces.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import cut, load, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Documents in a virtual block, on average.
BLOCK_DOCS = 1000
#: Children of a node of the splitting tree.
FANOUT = 128
SEED = 7
#: Most sources whose plan, some 100 bytes each, is broadcast.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds target to ``sizes(source, source_size)``, one row per source.

    Water filling in closed form: in ascending order of cap/weight the first k sources are capped,
    where k is the least number for which the next source takes less than its cap. Works on one
    row per source only.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(rank) - 1) % len(weights) + 1)
    rows = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(max_repeat)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            # Words for each unit of weight if all sources before this one are capped.
            "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
        }
    ).withColumn("is_capped", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return rows.select("source", "source_size", "weight", F.least("cap", F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def _growth(m: int, k: int) -> float:
    """log(k! / m!) less (k - m) log m, without the cancellation of large logarithms."""
    if min(m, k) < 16:
        return math.lgamma(k + 1) - math.lgamma(m + 1) - (k - m) * math.log(max(m, 1))
    d = k - m
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (k + 0.5) * math.log1p(d / m) - d + tail(k) - tail(m)


def log_ratio(k: int, mode: int, good: int, bad: int, n: int) -> float:
    """log of p(k) / p(mode) of a hypergeometric law: n draws from good + bad."""
    d = k - mode
    cells = [(mode, k), (good - mode, good - k), (n - mode, n - k), (bad - n + mode, bad - n + k)]
    steps = math.log(max(cells[1][0], 1)) + math.log(max(cells[2][0], 1)) - math.log(max(cells[0][0], 1)) - math.log(max(cells[3][0], 1))
    if d and all(a > 0 for a, _ in cells):
        a, b, c, e = (x for x, _ in cells)
        steps = math.log1p((b * c - a * e) / (a * e))  # exact integers: near the mode the product is close to 1
    return d * steps - sum(_growth(a, b) for a, b in cells)


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact hypergeometric variate of counts of any size: how many of n draws from good + bad are good.

    Ratio of uniforms under the table-mountain hat of the law, by logarithms of ratios to the mode.
    """
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    if low >= high:
        return low
    mode = (n + 1) * (good + 1) // (total + 2)
    mean = n * good / total
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(mean * (bad / total) * ((total - n) / max(total - 1, 1)) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    whole, part = divmod(n * good, total)  # the mean, as a whole number and the rest
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = whole + math.floor(part / total + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_ratio(k, mode, good, bad, n):
            return k


def split_quota(sizes: np.ndarray, quota: int, seed: str) -> np.ndarray:
    """Splits an exact quota over children by halving the list with hypergeometric draws."""
    out = np.zeros(len(sizes), dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    todo = [(0, len(sizes), int(quota))]
    while todo:
        lo, hi, q = todo.pop()
        if q == 0 or lo == hi:
            continue
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}/{lo}-{hi}".encode(), digest_size=8).digest(), "little"))
        left = _draw(rng, int(sums[mid] - sums[lo]), int(sums[hi] - sums[mid]), q)
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _divider(seed: str):
    """Function that splits a node's quota over its children."""

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        name = f"{seed}/{rows.source_no.iloc[0]}/{rows.parent.iloc[0]}"
        return pd.DataFrame({"source_no": rows.source_no, "node": rows.node, "quota": split_quota(rows.words.to_numpy(), rows.quota.iloc[0], name)})

    return divide


def block_quotas(blocks: DataFrame, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """Splits every source's quota over its blocks.

    ``blocks(source_no, block, words)``, ``quotas(source_no, quota)``. A level of the tree divides
    block numbers by ``FANOUT``; a task works on one node with at most that many children.
    """
    levels = [blocks.select("source_no", F.col("block").alias("node"), "words")]
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most > 0:
        most //= FANOUT
        levels.append(levels[-1].groupBy("source_no", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sum("words").alias("words")))
    given = quotas.select("source_no", F.lit(0).cast("long").alias("node"), "quota")
    for depth in range(len(levels) - 2, -1, -1):
        children = levels[depth].withColumn("parent", F.floor(F.col("node") / FANOUT))
        given = (
            children.join(given.select("source_no", F.col("node").alias("parent"), "quota"), ["source_no", "parent"])
            .groupBy("source_no", "parent")
            .applyInPandas(_divider(f"{seed}/{depth}"), "source_no long, node long, quota long")
        )
    return given.select("source_no", F.col("node").alias("block"), "quota")


def shard_quotas(blocks: DataFrame, quotas: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """``source_no, shard, quota``: every source's quota split over the output shards.

    ``blocks(source_no, shard, block, words)``, ``quotas(source_no, quota)``.
    """
    shards = cut(blocks.groupBy("source_no", F.col("shard").alias("block")).agg(F.sum("words").alias("words")))
    return block_quotas(shards, quotas, seed).withColumnRenamed("block", "shard")


def draw(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, block_docs: int = BLOCK_DOCS, n_shards: int = 64, seed: int = SEED) -> DataFrame:
    """Adds source_size, target, copies, part, taken and shard to ``sizes(doc_id, source, size, spread)``; a column row is carried along.

    A document is taken ``copies`` times whole and its first ``part`` words once more. ``spread`` is a
    hash of the text, by which rows without a doc_id are dealt; it may be absent and is dropped.
    """
    sizes = sizes if "spread" in sizes.columns else sizes.withColumn("spread", F.lit(None).cast("long"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = cut(per_source)  # one row per source: read several times below
    goal = targets(plan.select("source", "source_size"), weights, max_repeat)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    plan = plan.select(F.col("source").alias("s"), "n_docs", number.alias("source_no")).join(goal, F.col("s").eqNullSafe(F.col("source")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(
        plan.select(
            "source_no", "s", "source_size", "target", copies.alias("copies"),
            F.ceil(F.col("n_docs") / (block_docs * n_shards)).alias("n_blocks"),
            F.least(F.round(F.col("target")).cast("long") - copies * F.col("source_size"), "source_size").alias("quota"),
        )
    )
    who = ["doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("spread"))]
    # A row per source. Up to this many are broadcast, which saves a shuffle by a skewed key; more are joined by shuffling.
    by_source = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    placed = (
        sizes.join(by_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 2), *who), F.lit(n_shards)))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *who), F.col("n_blocks")))
        .drop("s", "n_blocks")
    )
    blocks = cut(placed.where("quota > 0").groupBy("source_no", "shard", "block").agg(F.sum("size").alias("words")))
    by_shard = shard_quotas(blocks, plan.where("quota > 0").select("source_no", "quota"), n_shards, seed)
    # A source's part in a shard is split like a source of its own.
    part_no = (F.col("source_no") * n_shards + F.col("shard")).alias("source_no")
    quotas = block_quotas(blocks.select(part_no, "block", "words"), by_shard.select(part_no, "quota"), seed + 4)
    quotas = quotas.select(F.floor(F.col("source_no") / n_shards).alias("source_no"), (F.col("source_no") % n_shards).alias("shard"), "block", "quota")
    order = Window.partitionBy("source_no", "shard", "block").orderBy(F.xxhash64(F.lit(seed + 1), *who), "doc_id", "size", "spread").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.drop("quota")
        .join(quotas, ["source_no", "shard", "block"], "left")
        .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("quota", F.lit(0)) - F.col("before"))))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
        .drop("source_no", "block", "quota", "before", "spread")
    )


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: one row per copy taken, with copy, shard, place and the words it gives in text.

    ``place`` is a seeded random key; sorting by (shard, place) shuffles each shard locally.
    """
    seed = params.get("seed", SEED)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("spread"), F.struct(*docs.columns).alias("row"))
    drawn = draw(rows, **params).where("size > 0")
    none = F.array().cast("array<struct<copy:bigint,n:bigint>>")
    whole = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: F.struct(k.alias("copy"), F.col("size").alias("n"))))
    part = F.when(F.col("part") > 0, F.array(F.struct((F.col("copies") + 1).alias("copy"), F.col("part").alias("n"))))
    taken = drawn.withColumn("t", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(part, none))))
    # Each piece is a word with the white space before it.
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first_words = F.array_join(F.slice(pieces, 1, F.col("t.n").cast("int")), "")
    text = F.when(F.col("t.n") == F.col("size"), F.col("row.text")).otherwise(first_words)
    place = F.xxhash64(F.lit(seed + 3), "doc_id", F.col("t.copy"))
    added = {"text": text, "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("t.n"), "copy": F.col("t.copy"), "shard": F.col("shard"), "place": place}
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted once: the sizes are read several times below.
    docs = cut(load(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("spread")))
    return draw(docs).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "copies", "part", "shard", "source")
