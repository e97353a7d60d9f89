"""Near copies by SimHash: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The general form of the operator in ``simhash``: more fingerprint bits, and an exact check at the end.

1. Sign: ``PARTS`` x 32 majority bits over the distinct 5-word shingles of a text (A-Z without case),
   and 128 more to check with.
2. Candidates: a part gets the covering family of ``RADIUS`` = 5, 63 structured masks that keep 16 of
   its 32 bits. Two texts that differ in at most PARTS x 6 - 1 bits differ in at most 5 of some
   part, and so certainly meet in one of its tables. Two sets of similarity 0.8 differ in some 15 %
   of the bits, so few of those pairs lie beyond that radius, and most of these meet all the same.
3. Families: within a bucket, texts that differ in at most ``LIMIT`` of the 128 bits may be alike. A
   task looks at many buckets and gives out one row for each text that its buckets tie to another,
   never all pairs. The components of these rows are the families of texts that may be alike.
4. Check: a family's shingle sets come together once, and its pairs are compared by their whole sets,
   the most alike first; pairs that are linked already through others are skipped, since they can't
   change a component. A family beyond ``FAMILY_BYTES`` is dealt into blocks, and every pair of
   blocks is a task of its own.

Texts of one shingle set are one node. In a bucket that a hash sample of the nodes shows to be hot, all
nodes are tied to one by an ordinary join, so that no hot bucket is one group of a task; the family
that this gives is larger, the links are the same.

Defined results: null and empty texts have the empty set and are copies of each other; fewer words
than a shingle make one shingle of all words; a text of any length is taken whole; of equal texts, as
of all copies, the smallest doc_id stays; rows without a doc_id stay; of repeated rows with the kept
doc_id one stays; an empty table gives no rows; extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import UPPER, components, cut, slices
from mercato.llm.substring_dedup import Words

SHINGLE = 5
SIMILARITY = 0.8
PARTS, PART_BITS, RADIUS = 3, 32, 5
#: Fingerprints of 64 bits: those that the parts are cut from, and two to check with.
CUT, WORDS = (PARTS + 1) // 2, (PARTS + 1) // 2 + 2
#: Most differing bits of the 128 within a bucket, and of all in the check: four standard deviations beyond a similarity of 0.8.
LIMIT, LIMIT_ALL = 36, 62
#: Buckets up to so many nodes are compared all at once, unless more than so many pairs for each node are close.
SMALL, MANY = 512, 8
#: Bytes of the shingle sets of a block of a family.
FAMILY_BYTES = 16_000_000
#: Buckets of more nodes than this are hot.
BUCKET = 8192
#: Rows of many buckets that a Python call gets at once, and nodes that are dealt at once: some 110 and 70 MB at work.
CALL_ROWS, NODES = 500_000, 2000
#: Most ids, some 30 bytes each in memory, that are broadcast to find the texts to check; more are joined by shuffling.
BROADCAST_IDS = 500_000
#: One node in so many is sampled for hot buckets; these are kept in a bitmap of so many bits.
SAMPLE, HOT_BITS = 64, 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_U = np.uint64
_SALT = np.arange(1, WORDS + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)
#: Bit i has the vector 2 i + 1 of GF(2)^6. Any 5 of these leave a direction orthogonal to all of them; every direction but the first keeps half of the bits.
_FAMILY = np.array([sum(1 << i for i in range(PART_BITS) if (2 * i + 1 & v).bit_count() % 2) for v in range(1, 1 << RADIUS + 1)], dtype=np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, sorted within each text, and where each text begins in them."""
    words = Words([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])
    length = np.diff(words.first)
    places, hashes = [], []
    for n in range(1, SHINGLE + 1):
        at, h = words.grams(n)
        use = np.minimum(length[words.doc[at]], SHINGLE) == n
        places.append(words.doc[at[use]])
        hashes.append(_spread(h[use] + _U(n)))
    doc, h = np.concatenate(places), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    return [hashlib.md5(h[a:b].tobytes()).digest() for a, b in zip(first[:-1], first[1:], strict=True)]


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of 64 majority bits for each set of hashes."""
    out = np.zeros((len(first) - 1, 8 * WORDS), np.uint8)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        votes = np.zeros(64 * WORDS, np.int64)
        for at in range(a, b, 4096):  # bounded memory for very long texts
            raw = _spread(h[at : min(b, at + 4096), None] + _SALT).view(np.uint8)
            votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out[d] = np.packbits(2 * votes > b - a, bitorder="little")
    return out.view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, first = shingle_sets(b["text"].to_pylist())
        fps = pa.FixedSizeListArray.from_arrays(pa.array(signatures(h, first).view(np.int64).ravel(), pa.int64()), WORDS)
        fps = fps.cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "digest": pa.array(_digests(h, first), pa.binary()), "fps": fps})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, first = shingle_sets(b["text"].to_pylist())
        yield pa.RecordBatch.from_pydict({"digest": pa.array(_digests(h, first), pa.binary()), "shingles": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, the keys of their buckets (a column for each table), and their bits to check with."""
    table = np.arange(PARTS * len(_FAMILY), dtype=np.uint64) << _U(PART_BITS)
    for big in batches:
        for at in range(0, big.num_rows, NODES):
            b = big.slice(at, NODES)
            fps = b["fps"].flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            parts = [fps[:, p // 2, None] >> _U(PART_BITS * (p % 2)) & _FAMILY for p in range(PARTS)]
            yield b["node"].to_numpy(), _spread(np.concatenate(parts, axis=1) | table), fps[:, CUT:]


def _is_hot(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[(key & _U(HOT_BITS - 1)).astype(np.int64)]


_ROWS = "key long, node long"


def _rows_of(hot: np.ndarray, sampled: bool = False):
    """Function that gives a row to each node in each hot bucket, or in all buckets for a sample of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, key, _ in _keys(batches):
            r, c = np.nonzero((_spread(node.view(np.uint64)) % _U(SAMPLE) == 0)[:, None] & np.ones(key.shape, bool) if sampled else _is_hot(key, hot))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[r, c].view(np.int64)), "node": pa.array(node[r])})

    return run


def _packed(calls: int, hot: np.ndarray):
    """Function that packs the rows of all other buckets for each call: number, width of a step, first node, then steps between nodes, keys, bits to check with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, key, rest in _keys(batches):
            r, c = np.nonzero(~_is_hot(key, hot))
            k = key[r, c]
            call = ((k >> _U(32)) * _U(calls) >> _U(32)).astype(np.int64)
            order = np.argsort(call, kind="stable")  # nodes stay in order
            r, c, k, call = r[order], c[order], k[order].astype(np.uint32), call[order]
            edges = np.searchsorted(call, np.arange(calls + 1))
            some, data = np.flatnonzero(np.diff(edges)), []
            for a, z in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True):
                own = node[r[a:z]]
                step = np.diff(own, prepend=own[:1])
                short = step.min() >= 0 and step.max() < 1 << 16
                head = np.array([z - a, 2 if short else 8, own[0]], np.int64)
                data.append(head.tobytes() + step.astype(np.uint16 if short else np.int64).tobytes() + k[a:z].tobytes() + rest[r[a:z]].tobytes())
            yield pa.RecordBatch.from_pydict({"call": pa.array(some), "data": pa.array(data, pa.binary())})

    return run


def _unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, nodes, rests = [], [], []
    for x in data:
        n, width, start = np.frombuffer(x, np.int64, 3).tolist()
        nodes.append(start + np.cumsum(np.frombuffer(x, np.uint16 if width == 2 else np.int64, n, 24), dtype=np.int64))
        keys.append(np.frombuffer(x, np.uint32, n, 24 + n * width))
        rests.append(np.frombuffer(x, np.uint64, 2 * n, 24 + n * (width + 4)).reshape(-1, 2))
    return np.concatenate(keys).astype(np.int64), np.concatenate(nodes), np.concatenate(rests)


_PAIRS = "src long, dst long"


def _pairs(src: np.ndarray, dst: np.ndarray) -> pa.Table:
    """Distinct pairs, the smaller node first."""
    both = np.stack([np.minimum(src, dst), np.maximum(src, dst)], axis=1)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    return pa.table({"src": pa.array(both[new, 0], pa.int64()), "dst": pa.array(both[new, 1], pa.int64())})


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1]) <= LIMIT


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, with that one."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(node))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all() and (low[x] == low[y]).all():
            return node[low[low < np.arange(len(node))]], node[low < np.arange(len(node))]
        low = new


def _forest(rest: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the close pairs of a bucket."""
    left, edges = np.arange(len(rest)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _close(rest[left], rest[x])
            found = left[near].tolist()
            edges += [(x, y) for y in found]
            queue += found
            left = left[~near]
    return edges


def _meet(table: pa.Table) -> pa.Table:
    """Stars of the texts that the close pairs of many buckets tie together."""
    key, node, rest = _unpacked(table["data"].to_pylist())
    order = np.lexsort((node, key))
    key, node, rest = key[order], node[order], rest[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    bucket = np.repeat(np.arange(len(first)), size)
    room = np.where(size <= SMALL, size, 0)[bucket] - (np.arange(len(key)) - np.repeat(first, size))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active = np.flatnonzero(room > 1)
    for step in range(1, SMALL):  # rows at every distance of each other, all buckets at once
        active = active[room[active] > step]
        if not len(active):
            break
        i = active[_close(rest[active], rest[active + step])]
        left.append(i)
        right.append(i + step)
    i, j = np.concatenate(left), np.concatenate(right)
    many = (np.bincount(bucket[i], minlength=len(first)) > MANY * size) | (size > SMALL)
    keep = ~many[bucket[i]]
    edges = [(first[b] + x, first[b] + y) for b in np.flatnonzero(many).tolist() for x, y in _forest(rest[first[b] : first[b] + size[b]])]
    forest = np.array(edges, np.int64).reshape(-1, 2)
    return _pairs(*_stars(node[np.concatenate([i[keep], forest[:, 0]])], node[np.concatenate([j[keep], forest[:, 1]])]))


def _check(least: float):
    """Function of a family, or two blocks of it: a forest of the pairs whose sets are at least so similar."""

    def run(table: pa.Table) -> pa.Table:
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        lists = table["shingles"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        fps = table["fps"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        size, two = np.diff(at), table["i"][0].as_py() != table["j"][0].as_py()
        far, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(len(node) - 1):
            d = np.bitwise_count(fps[x + 1 :] ^ fps[x]).sum(axis=1, dtype=np.int64)
            can = (d <= LIMIT_ALL) & (np.minimum(size[x + 1 :], size[x]) >= least * np.maximum(size[x + 1 :], size[x]) - 1e-9)
            if two:
                can &= block[x + 1 :] != block[x]
            y = np.flatnonzero(can)
            far.append(d[y])
            a.append(np.full(len(y), x))
            b.append(x + 1 + y)
        order = np.argsort(np.concatenate(far), kind="stable")
        a, b = np.concatenate(a)[order], np.concatenate(b)[order]
        group, links = np.arange(len(node)), []
        for lo in range(0, len(a), 2000):
            x, y = a[lo : lo + 2000], b[lo : lo + 2000]
            apart = group[x] != group[y]
            for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if group[p] != group[q]:
                    n, m = size[p], size[q]
                    both = len(np.intersect1d(flat[at[p] : at[p + 1]], flat[at[q] : at[q + 1]], assume_unique=True))
                    if both >= least * (n + m - both) - 1e-9:
                        links.append((node[p], node[q]))
                        group[group == group[q]] = group[p]
        found = np.array(links, np.int64).reshape(-1, 2)
        return _pairs(found[:, 0], found[:, 1])

    return run


def _hot_bits(nodes: DataFrame, bucket: int) -> np.ndarray:
    """A bitmap of fixed size over key mod HOT_BITS: the buckets that a hash sample of the nodes shows to be hot, and those that share their bits."""
    sampled = nodes.mapInArrow(_rows_of(np.zeros(0, bool), sampled=True), _ROWS)
    hot = sampled.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(bucket // SAMPLE, 1))
    bit = F.pmod("key", F.lit(HOT_BITS))
    maps = hot.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((HOT_BITS // 32768 + 1) * 32768, bool)
    for r in maps:
        at = (r["at"] - 1) * 32768 if r["at"] > 0 else 0
        out[at + 1 : at + 32769] |= np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[: len(out) - at - 1].astype(bool)
        if r["at"] == 0:
            out[0] = True
    return out[:HOT_BITS]


def components_of(docs: DataFrame, least: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, component_id``: one row per row of ``docs(doc_id, text)``; the smallest doc_id of its near copies."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {id_type}, digest binary, fps array<long>"))
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("fps").alias("fps"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    signed = nodes.select("node", "fps")
    hot = _hot_bits(signed, bucket)
    calls = max(1, nodes.count() * PARTS * len(_FAMILY) // CALL_ROWS)
    pairs = signed.mapInArrow(_packed(calls, hot), "call long, data binary").groupBy("call").applyInArrow(_meet, _PAIRS)
    if hot.any():
        rows_hot = signed.mapInArrow(_rows_of(hot), _ROWS)
        heads = rows_hot.groupBy("key").agg(F.min("node").alias("src"))
        pairs = pairs.union(rows_hot.join(heads, "key").where("src < node").select("src", F.col("node").alias("dst")))
    family = components(pairs, hubs=True).select("node", F.col("component").alias("family"))
    # The whole sets of the nodes that may be like another, each once.
    wanted = cut(nodes.join(family, "node").select("node", "digest", "first_id", "fps", "family"))
    owner = wanted.where("first_id is not null").select(F.col("first_id").alias("__id"))
    owner = F.broadcast(owner) if owner.count() <= BROADCAST_IDS else owner
    texts = docs.select("doc_id", "text").join(owner, F.col("doc_id") == F.col("__id"), "left_semi")
    sets = cut(texts.mapInArrow(_whole, "digest binary, shingles array<long>").dropDuplicates(["digest"]).join(wanted.drop("first_id"), "digest").drop("digest"))
    blocks = sets.groupBy("family").agg(F.ceil(F.sum(F.size("shingles")) * 8 / F.lit(FAMILY_BYTES)).alias("n"))
    dealt = sets.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("n", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("family", "i", "j", "block", "node", "fps", "shingles")
    groups = components(dealt.groupBy("family", "i", "j").applyInArrow(_check(least), _PAIRS), hubs=True)
    member = nodes.select("digest", "node", "first_id").join(groups, "node", "left").select("digest", "first_id", F.coalesce("component", "node").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "digest").join(member.join(smallest, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each component of ``docs``: that of its smallest doc_id, with its columns."""
    owners = components_of(docs.where("doc_id is not null"), least).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(owners, docs["doc_id"] == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
