"""Approximate nearest neighbours: NN-descent graphs and greedy graph search.

Equal vectors form a class that stands in the graph once. Classes are dealt by hash into shards of
some ``SHARD`` vectors, the bounded unit of work. A shard's graph starts from random-projection
leaves and is improved by NN-descent: Spark joins edges with the neighbour lists at their other end
(forward and sampled reverse edges), which gives every node the neighbours of its neighbours; the
best ``DEGREE`` stay. A query walks greedily through the graph of each shard with a beam of ``BEAM``
nodes, a block of queries at a time; its best nodes of all shards are scored again in double
precision on the original vectors and merged.

Cost: a query visits every shard, so a query set that grows with the table costs queries x shards;
within a shard it looks at a small part of the vectors only.

Defined results: null vectors, vectors with null or non-finite components and zero vectors take no
part; vectors of another dimension than the query's are no candidates; rows equal in vec_id and
vector count once; rows with a null vec_id take no part; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import cut, load

SHARD = 8192
QUERY_BLOCK = 4096
DEGREE = 24
ROUNDS = 2
TREES, LEAF = 4, 256
BEAM = 96
ENTRIES = 128
TOP = 20
SEED = 11
_KEY = ["dim", "shard"]


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32), pa.int32()))


def _sorted(table: pa.Table) -> pa.Table:
    """A shard's rows by vid: a row's place is its node number."""
    return table.sort_by("vid")


def _scaled(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """``x`` in doubles, divided by a power of two so that no product leaves their range; orders of inner products stay."""
    x = np.asarray(x, np.float64)
    _, power = np.frexp(np.abs(x).max(axis=axis, keepdims=True, initial=0.0))
    return np.ldexp(x, -power)


def _graph_rows(table: pa.Table, nodes: np.ndarray, near: list[np.ndarray]) -> pa.Table:
    n = len(nodes)
    return pa.table({"dim": pa.array(np.full(n, table["dim"][0].as_py()), pa.int32()), "shard": pa.array(np.full(n, table["shard"][0].as_py()), pa.int64()), "node": pa.array(nodes, pa.int32()), "near": _lists(near)})


_GRAPH = "dim int, shard long, node int, near array<int>"


def _best(x: np.ndarray, node: int, others: np.ndarray) -> np.ndarray:
    others = others[others != node]
    if len(others) > DEGREE:
        s = x[others] @ x[node]
        others = others[np.argpartition(-s, DEGREE - 1)[:DEGREE]]
    return others


def _start(table: pa.Table) -> pa.Table:
    """First graph of a shard: the best neighbours within random-projection leaves of bounded size."""
    x = _scaled(_matrix(_sorted(table)["embedding"]))
    rng = np.random.default_rng(SEED)
    n, found = len(x), [[] for _ in range(len(x))]
    for _ in range(TREES):
        leaves = [np.arange(n)]
        while max(map(len, leaves)) > LEAF:  # halve at the median of a random direction
            split = []
            for leaf in leaves:
                if len(leaf) <= LEAF:
                    split.append(leaf)
                else:
                    order = leaf[np.argsort(x[leaf] @ rng.normal(size=x.shape[1]), kind="stable")]
                    split += [order[: len(order) // 2], order[len(order) // 2 :]]
            leaves = split
        for leaf in leaves:
            s = x[leaf] @ x[leaf].T
            np.fill_diagonal(s, -np.inf)
            k = min(DEGREE, len(leaf) - 1)
            if k > 0:
                for node, top in zip(leaf.tolist(), leaf[np.argpartition(-s, k - 1, axis=1)[:, :k]], strict=True):
                    found[node].append(top)
    near = [_best(x, i, np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64)) for i, f in enumerate(found)]
    return _graph_rows(table, np.arange(n), near)


def _improve(table: pa.Table, offers: pa.Table) -> pa.Table:
    """Keeps the best of the neighbours of neighbours that the join offers each node."""
    if not table.num_rows:
        return pa.table({"dim": pa.array([], pa.int32()), "shard": pa.array([], pa.int64()), "node": pa.array([], pa.int32()), "near": pa.array([], pa.list_(pa.int32()))})
    x = _scaled(_matrix(_sorted(table)["embedding"]))
    lists = offers["offer"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    nodes = offers["node"].to_numpy()
    return _graph_rows(table, nodes, [_best(x, i, np.unique(flat[a:b])) for i, a, b in zip(nodes.tolist(), ends, ends[1:], strict=False)])


def neighbour_graph(classes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``dim, shard, node, near`` by NN-descent over ``classes(dim, shard, vid, embedding)``."""
    graph = cut(classes.groupBy(*_KEY).applyInArrow(_start, _GRAPH))
    for _ in range(rounds):
        forward = graph.select(*_KEY, "node", F.explode("near").alias("to"))
        # Sampled reverse edges, so that a node many point at has a short list too.
        rank = Window.partitionBy(*_KEY, "to").orderBy(F.xxhash64("node", "to"))
        back = forward.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= DEGREE).select(*_KEY, F.col("to").alias("node"), F.col("node").alias("to"))
        edges = forward.union(back).distinct()
        ends = edges.groupBy(*_KEY, F.col("node").alias("to")).agg(F.collect_list("to").alias("further"))
        offers = edges.join(ends, [*_KEY, "to"]).select(*_KEY, "node", F.array_append("further", F.col("to")).alias("further"))
        offers = offers.groupBy(*_KEY, "node").agg(F.array_distinct(F.flatten(F.collect_list("further"))).alias("offer"))
        graph = cut(classes.groupBy(*_KEY).cogroup(offers.groupBy(*_KEY)).applyInArrow(_improve, _GRAPH))
    return graph


def walk(x: np.ndarray, near: np.ndarray, q: np.ndarray, beam: int = BEAM, keep: int = TOP + 12) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of all queries at once: node numbers (-1: none) and scores, best first.

    ``near`` is padded with n, the number of a node that is never visited.
    """
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    first = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, beam))).astype(np.int64))
    node = np.broadcast_to(first, (m, len(first))).copy()
    score = q @ x[first].T
    seen[:, first] = True
    done = np.zeros(node.shape, bool)
    at_once = 4
    while True:
        if node.shape[1] > beam:
            top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            node, score, done = (np.take_along_axis(a, top, 1) for a in (node, score, done))
        open_score = np.where(done, -np.inf, score)
        step = np.argpartition(-open_score, min(at_once, open_score.shape[1]) - 1, axis=1)[:, :at_once]
        live = np.isfinite(np.take_along_axis(open_score, step, 1))
        active = live.any(axis=1)
        if not active.any():
            break
        np.put_along_axis(done, step, True, 1)
        here = np.where(live, np.take_along_axis(node, step, 1), n)
        new = near[here].reshape(m, -1)
        new.sort(axis=1)
        repeat = np.zeros(new.shape, bool)
        repeat[:, 1:] = new[:, 1:] == new[:, :-1]
        fresh = ~repeat & ~seen[rows, new]
        seen[rows, new] = True
        s = np.full(new.shape, -np.inf)
        r, c = np.nonzero(fresh)
        s[r, c] = np.einsum("ij,ij->i", q[r], x[new[r, c]])
        node, score = np.concatenate([node, new], 1), np.concatenate([score, s], 1)
        done = np.concatenate([done, ~fresh], 1)
    order = np.argsort(-score, axis=1)[:, :keep]
    node, score = np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)
    return np.where(np.isfinite(score), node, -1), score


_FOUND = "query_vid long, vid long, score double"


def _search(table: pa.Table, queries: pa.Table) -> pa.Table:
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if table.num_rows and queries.num_rows:
        table = _sorted(table)
        vid, exact = table["vid"].to_numpy(), _matrix(table["embedding"]).astype(np.float64)
        x, n = _scaled(exact), table.num_rows
        lists = table["near"].to_pylist()
        near = np.full((n + 1, 2 * DEGREE), n, np.int64)
        fill = np.zeros(n, np.int64)
        for i, a in enumerate(lists):
            near[i, : len(a)] = a
            fill[i] = len(a)
        for i, a in enumerate(lists):  # reverse edges as far as there is room
            for j in a:
                if fill[j] < 2 * DEGREE:
                    near[j, fill[j]] = i
                    fill[j] += 1
        q_vid, q_exact = queries["query_vid"].to_numpy(), _matrix(queries["q_embedding"]).astype(np.float64)
        for at in range(0, len(q_vid), 256):
            part = slice(at, at + 256)
            node, _ = walk(x, near, _scaled(q_exact[part], axis=1))
            r, c = np.nonzero(node >= 0)
            hit = node[r, c]
            for k, v in enumerate((q_vid[part][r], vid[hit], np.einsum("ij,ij->i", q_exact[part][r], exact[hit]))):
                out[k].append(v)
    return pa.table({name: pa.array(np.concatenate(v), kind) for name, v, kind in zip(("query_vid", "vid", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})


def nearest(table: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose vec_id is divisible by ``every``."""
    rows = cut(usable(table))
    # A class needs no more than top + 1 members in any answer; Spark limits them before the shuffle.
    member = rows.withColumn("k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    member = cut(member)
    classes = member.where("k = 1").select(F.col("vec_id").alias("vid"), "embedding", F.size("embedding").alias("dim"))
    shards = max(1, math.ceil(classes.count() / SHARD))
    classes = classes.withColumn("shard", F.pmod(F.xxhash64("vid"), F.lit(shards)))
    member = member.join(classes.select("vid", "embedding"), "embedding").select("vid", "vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).join(classes.select("vid", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("query_vid"))
    asked = classes.join(queries.select(F.col("query_vid").alias("vid")).distinct(), "vid", "left_semi").select(F.col("vid").alias("query_vid"), F.col("embedding").alias("q_embedding"), F.col("dim").alias("q_dim"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    graph = neighbour_graph(classes)
    number = F.row_number().over(Window.partitionBy(*_KEY).orderBy("vid")) - 1
    indexed = classes.withColumn("node", number).join(graph, [*_KEY, "node"], "left")
    indexed = indexed.select("dim", "shard", "vid", "embedding", F.coalesce("near", F.array().cast("array<int>")).alias("near"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_vid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    asked = asked.withColumnsRenamed({"q_dim": "to_dim", "shard": "to_shard", "block": "to_block"})
    found = indexed.groupBy(*_KEY, "block").cogroup(asked.groupBy("to_dim", "to_shard", "to_block")).applyInArrow(_search, _FOUND)
    by_class = Window.partitionBy("query_vid").orderBy(F.col("score").desc(), "vec_id")
    best = found.join(member, "vid").withColumn("k", F.row_number().over(by_class)).where(F.col("k") <= top + 1).select("query_vid", "vec_id", "score")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    answer = queries.join(best, "query_vid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(by_query))
    return answer.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
