"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.session import shared_folder

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in the folder that the session names, which all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Most rows and bytes of texts that a Python worker unpacks at a time from an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 500, 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows and bytes, whole rows always, so that what is built from texts stays small."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False)
        upto, at = np.concatenate([[0], np.cumsum(size)]), 0
        while at < b.num_rows:
            to = int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + SLICE_ROWS, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def schema_with(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` and columns of these names and types behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items())])


def _large_star(links: DataFrame, hubs: bool) -> DataFrame:
    """Larger neighbours of a node, linked to the smallest one around it."""
    both = links.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(
        links.select(F.col("lo").alias("node"), F.col("hi").alias("near"))
    )
    low = both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low"))
    low = cut(low) if hubs else low
    return both.where("near > node").join(low, "node").select(F.col("near").alias("hi"), F.col("low").alias("lo")).distinct()


def components(edges: DataFrame, max_rounds: int = 60, hubs: bool = False) -> DataFrame:
    """Connected components of the undirected graph ``edges(src, dst)``.

    Large-star / small-star rounds: every node ends up linked to the smallest node of its
    component. Minima are aggregated before each shuffle, so a node with very many neighbours
    costs one row per task there. With ``hubs``, these are written before they are joined: only then does
    the join read two plain shuffles, so that AQE can split the neighbours of one node.
    Returns ``node, component`` for the nodes that have an edge to another node; self loops and
    edges with a null end are ignored, and no edges give no rows.
    """
    links = (
        edges.select("src", "dst")
        .where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    links = cut(links)
    if links.isEmpty():
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    before = None
    for _ in range(max_rounds):
        large = _large_star(links, hubs)
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")), F.struct("hi", F.col("low").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        links = cut(small)
        after = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
