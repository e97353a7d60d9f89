"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` in the folder that the session names, which all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of the undirected graph ``edges(src, dst)``: the smallest node that each one reaches.

    Every round ties larger neighbours of a node to the smallest around it, then each node and its
    smaller neighbours to the smallest of those, which halves the depth of a chain. Raises if a graph
    doesn't settle. Nodes without an edge to another aren't listed; null ends are ignored.
    """
    pair = F.array_sort(F.array("src", "dst"))
    links = cut(edges.where("src <> dst").select(pair[1].alias("hi"), pair[0].alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        around = links.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(links.select("lo", "hi"))
        low = around.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = around.where("near > node").join(low, "node").select(F.col("near").alias("hi"), F.col("low").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        tied = large.join(low, "hi")
        links = cut(tied.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(tied.select("hi", "low")).where("hi <> lo").distinct())
        after = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == before:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select("lo", "lo").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
