"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 hashes (seed 42) of 3-word shingles. Links: two
fingerprints that differ in at most ``RADIUS`` bits.

Search: every bit gets a vector of RADIUS + 1 coordinates over GF(2). A table for each of the
2^(RADIUS+1) - 1 non-zero directions v keeps the bits whose vector has inner product 1 with v. The
vectors of at most RADIUS differing bits leave some v orthogonal to all of them, so that every pair
within the radius agrees in that table: no pair is missed, whatever the data.

Only distinct fingerprints are compared. A bucket of one table with more than ``BUCKET``
fingerprints is refined by a further family of masks over the bits that it has not fixed, again a
covering family, until it is small. A family fixes about half of the bits still free, so buckets
end at 2^free fingerprints at the latest: with at most ``FREE_BITS`` bits free a bucket can't hold
more than 2^FREE_BITS different ones. Within a bucket only a spanning forest of its links leaves
the task, never all pairs.

The query's contract fixes 3-word shingles and 3 bits. ``simhash_copies`` is the form for shingles of
five words and a similarity of 0.8, which the pipeline uses.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle of all words; a text of any length is taken whole; ties (equal
fingerprints) are linked; repeated rows share a component; a null doc_id
keeps a row with its fingerprint's component, which is null only if no row of the component has a
doc_id; an empty table gives no rows; extra columns are ignored by ``components_of`` and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import UPPER, components, cut, load

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 8192
FREE_BITS = 13
#: Rows of many small buckets that a Python call gets at once.
CALL_ROWS = 20_000
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]
    h = np.array(hashes, dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * set_in > len(h)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of ``docs(doc_id, text)``."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.col("text")).alias("fp"))


def masks(fixed: int = 0, radius: int = RADIUS) -> list[int]:
    """The covering family over the bits that are not ``fixed``: 2^(radius+1) - 1 masks of kept bits.

    Free bits get the non-zero vectors in turn, so each mask keeps 8 of every 15 bits.
    """
    free = [i for i in range(64) if not fixed >> i & 1]
    n = (1 << radius + 1) - 1
    vector = {bit: k % n + 1 for k, bit in enumerate(free)}
    return [sum(1 << b for b in free if (vector[b] & v).bit_count() % 2) for v in range(1, n + 1)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(rows: DataFrame, families: dict[int, list[int]]) -> DataFrame:
    """Rows (fp, fixed) once for each mask of the family of what they have fixed: (fixed, value, fp)."""
    out = F.lit(None).cast("array<struct<fixed:bigint,value:bigint>>")
    for fixed, family in families.items():
        tables = F.array(*[F.struct(F.lit(_long(fixed | m)).alias("fixed"), F.col("fp").bitwiseAND(F.lit(_long(fixed | m))).alias("value")) for m in family])
        out = F.when(F.col("fixed") == F.lit(_long(fixed)), tables).otherwise(out)
    return rows.select("fp", F.explode(out).alias("k")).select("k.fixed", "k.value", "fp")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among at most 2^FREE_BITS (or BUCKET) fingerprints."""
    label = np.arange(len(fps))
    edges = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        for g in np.unique(label[near]).tolist():
            if g != label[i]:
                edges.append((int(fps[near[label[near] == g][0]]), int(fps[i])))
                label[label == label[i]] = g
    return edges


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``src, dst`` links that connect the distinct fingerprints of ``fps(fp)`` as all pairs within the radius would."""
    rows = fps.select("fp", F.lit(0).cast("long").alias("fixed"))
    families = {0: masks(0, radius)}
    found = None
    while True:
        buckets = _keyed(rows, families)
        sizes = buckets.groupBy("fixed", "value").agg(F.count("*").alias("n")).where("n > 1")
        small = F.col("n") <= BUCKET
        if done := all(64 - (f | m).bit_count() <= FREE_BITS for f, fam in families.items() for m in fam):
            small = F.lit(True)

        def link(group: pd.DataFrame) -> pd.DataFrame:
            edges = []
            for _, fps in group.sort_values("fp").groupby(["fixed", "value"], sort=False).fp:
                edges += _forest(fps.to_numpy().view(np.uint64), radius)
            return pd.DataFrame(np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])

        sizes = cut(sizes)
        near = sizes.where(small)
        calls = max(1, (near.agg(F.sum("n")).first()[0] or 0) // CALL_ROWS)
        groups = buckets.join(near, ["fixed", "value"]).withColumn("call", F.pmod(F.xxhash64("fixed", "value"), F.lit(calls)))
        pairs = groups.groupBy("call").applyInPandas(link, "src long, dst long").distinct()
        found = pairs if found is None else found.union(pairs)
        if done:
            return found
        hot = cut(sizes.where(~small))
        if hot.isEmpty():
            return found
        rows = cut(buckets.join(hot, ["fixed", "value"]).select("fp", "fixed").distinct())
        # A mask of a hot bucket is one of at most 15 for each mask of the level before.
        used = {r.fixed & (1 << 64) - 1 for r in hot.select("fixed").distinct().collect()}
        families = {f: masks(f, radius) for f in sorted(used)}


def components_of(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs(doc_id, text)``."""
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(classes.select("fp"), radius))
    # The component of a fingerprint, and the smallest doc_id in it.
    member = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(member.join(smallest, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``docs``: that of its smallest doc_id, with its columns.

    Rows without a doc_id stay; of repeated rows with that doc_id one stays.
    """
    owners = components_of(docs.select("doc_id", "text"), radius).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(owners, docs["doc_id"] == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components_of(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
