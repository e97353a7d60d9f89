"""Registered queries of the keyed store: laid out from the catalog, then looked up and written to, beside SQL over the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.plans import change_queries, stream_queries
from mercato.plans.adapter import CATALOG, CATALOG_SQL, catalog
from mercato.session import shared_folder
from mercato.sources.keyed_store import KeyedStore, key_of
from mercato.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _store(spark: SparkSession, rows: DataFrame) -> KeyedStore:
    return KeyedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 32).create(rows)


@register("store_lookup", f"WITH {CATALOG_SQL} SELECT url, name, price FROM catalog WHERE url IN ('p7', 'p11', 'p150')")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products by key; one asked for twice and one that doesn't exist."""
    return _store(spark, catalog(spark, sf_dir)).by_keys([key_of(u) for u in ("p7", "p11", "p150", "p7", "none")]).select("url", "name", "price")


@register("store_lookup_many", f"WITH {CATALOG_SQL} SELECT url, price, name FROM catalog WHERE url IN (SELECT 'p' || o_orderkey FROM orders)")
def store_lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a whole table of URLs, most of which don't exist."""
    urls = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("url"))
    return _store(spark, catalog(spark, sf_dir)).by_urls(urls).select("url", "price", "name")


@register("store_upserts", change_queries.ORACLES["upsert_snapshot"])
def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after a batch that came twice."""
    current, batch = change_queries._state(spark, sf_dir), change_queries._batch(spark, sf_dir).drop("seq")
    store = _store(spark, current)
    store.upsert(batch)
    store.upsert(batch)
    return store.read().select(*current.columns)


@register("store_soft_delete", f"WITH {CATALOG_SQL} SELECT url, site, active AND NOT (site IN (SELECT site FROM catalog WHERE seq % 3 = 0 AND seq % 46 < 9) AND NOT (seq % 3 = 0 AND seq % 46 < 9)) AS active FROM catalog")
def store_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over some sites no longer lists."""
    rows = catalog(spark, sf_dir).select("url", "site", "seq", "active")
    store = _store(spark, rows)
    store.soft_delete(rows.where("seq % 3 = 0 and seq % 46 < 9"))
    return store.read().select("url", "site", "active")


@register("stream_store_upserts", stream_queries.ORACLES["stream_upserts"])
def stream_store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after a stream of finished sites that rewrites only the buckets it touches."""
    first = catalog(spark, sf_dir).where("seq % 4 <> 3").withColumn("locked_by", F.when(F.col("seq") % 10 == 1, F.lit("human"))).select(*stream_queries._SNAPSHOT)
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/par[t].parquet").selectExpr(*CATALOG).where("seq % 3 = 0")
    batch = rows.selectExpr("url", "site", "name", "price + 5 AS price", "'new' AS category", "CASE WHEN seq % 2 = 0 THEN '' ELSE 'wide' END AS fit", "seq AS ord")
    store = _store(spark, first)
    ingest.upserts_in_place(batch, store, f"{store.folder}-state").trigger(availableNow=True).start().awaitTermination()
    return store.read().select(*first.columns)
