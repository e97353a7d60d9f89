"""Queries over trends, picks, caches, merges and small lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import curation
from mercato.operators.backfill import EmbeddingCache
from mercato.plans.adapter import CATALOG_SQL, catalog
from mercato.plans.price_queries import _rounded
from mercato.session import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _r(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


@register(
    "top_categories",
    f"WITH {CATALOG_SQL} SELECT coalesce(nullif(trim(category), ''), 'General') AS category, count(*) AS n, {_r('avg(price)')} AS mean, {_r('quantile_cont(price, 0.5)')} AS median, {_r('quantile_cont(price, 0.25)')} AS q1, {_r('quantile_cont(price, 0.75)')} AS q3, {_r('stddev_pop(price) / avg(price) * 100')} AS cv FROM catalog WHERE price > 0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12",
)
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(curation.top_categories(catalog(spark, sf_dir)))


@register(
    "picks",
    f"""WITH {CATALOG_SQL}, n AS (SELECT * FROM catalog WHERE trim(coalesce(category, '')) <> ''),
    lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score, price, url) AS k FROM n) WHERE k = 1 ORDER BY score, price, url LIMIT 5),
    hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, price, url) AS k FROM n WHERE coalesce(segment, 'standard') IN ('premium', 'standard') AND score BETWEEN 40 AND 75) WHERE k = 1 ORDER BY score DESC, price, url LIMIT 4)
    SELECT 'budget' AS kind, url FROM lo UNION ALL SELECT 'premium', url FROM hi""",
)
def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.picks(catalog(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).where("seq % 2 = 0")
    return rows.select("url", F.lit("abcdefgh").cast("binary").alias("embedding"), F.when(F.col("seq") % 3 == 0, 3).otherwise(2).alias("dim"), F.when(F.col("seq") % 5 == 0, "v1").otherwise("v2").alias("model_version"))


_HELD = "held AS (SELECT url FROM catalog WHERE seq % 2 = 0 AND seq % 3 <> 0 AND seq % 5 <> 0)"


@register("pending_embeddings", f"WITH {CATALOG_SQL}, {_HELD} SELECT url FROM catalog WHERE active AND trim(coalesce(image, '')) <> '' AND url NOT IN (SELECT url FROM held)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.pending(catalog(spark, sf_dir), _cache(spark, sf_dir), "v2").select("url")


@register("embedding_coverage", f"WITH {CATALOG_SQL}, {_HELD} SELECT count(*) AS products, count(*) FILTER (WHERE url IN (SELECT url FROM held)) AS cached, floor(count(*) FILTER (WHERE url IN (SELECT url FROM held)) * 1000 / count(*) + 0.5e0) / 10 AS pct FROM catalog")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.coverage(catalog(spark, sf_dir), _cache(spark, sf_dir), "v2")


def _one_hot():
    """A model for the test tables: the place of the one is the sum of the bytes by 8."""
    return lambda images: [[float(k == sum(x.encode()) % 8) for k in range(8)] for x in images]


@register(
    "embedding_backfill",
    f"""WITH {CATALOG_SQL}, {_HELD}, p AS (SELECT url, list_sum(list_transform(string_split(image, ''), lambda x: ascii(x))) % 8 AS k FROM catalog WHERE active AND trim(coalesce(image, '')) <> '' AND url NOT IN (SELECT url FROM held))
    SELECT url, 8 AS dim, repeat('00000000', CAST(k AS INT)) || '0000803F' || repeat('00000000', CAST(7 - k AS INT)) AS embedding FROM p UNION ALL SELECT url, 2, hex('abcdefgh') FROM held""",
)
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of this version after two runs, the second of which finds nothing to do."""
    store = EmbeddingCache(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    store.add(_cache(spark, sf_dir))
    rows = catalog(spark, sf_dir)
    for _ in range(2):
        store.backfill(rows, _one_hot, "v2", wave_rows=max(1, rows.count() // 3))
    return store.current("v2").select("url", "dim", F.hex("embedding").alias("embedding"))


@register(
    "image_candidates",
    f"WITH {CATALOG_SQL} SELECT url, confidence FROM (SELECT *, (seq % 100) / 100e0 AS confidence FROM catalog) WHERE trim(coalesce(image, '')) <> '' AND (confidence < 0.75 OR lower(trim(coalesce(category, ''))) IN ('', 'otros') OR trim(coalesce(gender, '')) = '') ORDER BY confidence, url LIMIT 400",
)
def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumn("confidence", (F.col("seq") % 100) / 100.0)
    return curation.image_candidates(rows, ["", "otros"]).select("url", "confidence")


@register(
    "merge_scores",
    f"""WITH {CATALOG_SQL}, s AS (SELECT url AS pid, CASE WHEN seq % 3 = 0 THEN 'Refined' ELSE '' END AS category, (seq % 10) / 10e0 AS cc, CASE seq % 4 WHEN 0 THEN 'mujer' WHEN 1 THEN 'unisex' ELSE 'hombre' END AS gender, (seq % 7) / 6e0 AS gc, CASE WHEN seq % 2 = 0 THEN CAST(seq % 50 AS INT) END AS composite, CASE WHEN seq % 5 = 0 THEN 'wide' ELSE '' END AS fit FROM catalog WHERE seq % 3 <> 1)
    SELECT c.url, CASE WHEN s.category <> '' AND cc >= 0.8 THEN s.category ELSE c.category END AS category, CASE WHEN trim(coalesce(c.gender, '')) = '' AND s.gender IN ('hombre', 'mujer') AND gc >= 0.8 THEN s.gender ELSE c.gender END AS gender, coalesce(composite, c.score) AS score, CASE WHEN coalesce(s.fit, '') <> '' THEN s.fit ELSE c.fit END AS fit FROM catalog c LEFT JOIN s ON c.url = s.pid""",
)
def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    seq = F.col("seq")
    new = rows.where("seq % 3 <> 1").select(
        F.col("url").alias("pid"),
        F.when(seq % 3 == 0, "Refined").otherwise("").alias("category"),
        ((seq % 10) / 10.0).alias("category_confidence"),
        F.when(seq % 4 == 0, "mujer").when(seq % 4 == 1, "unisex").otherwise("hombre").alias("gender"),
        ((seq % 7) / 6.0).alias("gender_confidence"),
        F.when(seq % 2 == 0, (seq % 50).cast("int")).alias("composite"),
        F.lit(None).cast("int").alias("percentile"),
        F.when(seq % 5 == 0, "wide").otherwise("").alias("fit"),
        *[F.lit("").alias(c) for c in ("print", "neckline", "color")],
    )
    return curation.merge_scores(rows, new).select("url", "category", "gender", "score", "fit")


_COLOURS = ", ".join(f"({k}, '{n}', {r}, {g}, {b})" for k, (n, (r, g, b)) in enumerate(curation.PALETTE.items()))


@register("nearest_colour", f"WITH {CATALOG_SQL}, p(k, name, pr, pg, pb) AS (VALUES {_COLOURS}), c AS (SELECT url, seq * 7 % 256 AS r, seq * 13 % 256 AS g, seq * 29 % 256 AS b FROM catalog) SELECT url, name AS color FROM (SELECT url, name, row_number() OVER (PARTITION BY url ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), k) AS i FROM c CROSS JOIN p) WHERE i = 1")
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return catalog(spark, sf_dir).select("url", curation.nearest_colour(seq * 7 % 256, seq * 13 % 256, seq * 29 % 256).alias("color"))


@register("saved_items", f"WITH {CATALOG_SQL}, i AS (SELECT DISTINCT 'p' || (event_id % 3000 + 1) AS url FROM events) SELECT i.url, price AS price_now, NOT coalesce(active, false) AS discontinued FROM i LEFT JOIN catalog USING (url)")
def saved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("p"), (F.col("event_id") % 3000 + 1).cast("string")).alias("url")).distinct()
    return curation.saved_items(items, catalog(spark, sf_dir))


@register("external_prices", "SELECT site, CAST(day AS VARCHAR) AS day, price FROM (SELECT 'p' || l_partkey AS url, 's' || l_suppkey AS site, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price FROM lineitem) WHERE url = 'p5' AND price > 0 ORDER BY day DESC, price, site LIMIT 20")
def external_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    offers = lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"))
    return curation.external_prices(offers, "p5").select("site", F.col("day").cast("string").alias("day"), "price")


@register("small_classes", f"WITH {CATALOG_SQL}, n AS (SELECT category, count(*) AS n FROM catalog WHERE category IS NOT NULL GROUP BY category) SELECT url, CASE WHEN n < 350 AND c.category LIKE '% %' THEN split_part(c.category, ' ', 1) ELSE c.category END AS category FROM catalog c JOIN n USING (category)")
def small_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).where("category is not null").select("url", "category")
    parents = rows.select("category", F.element_at(F.split("category", " "), 1).alias("parent")).distinct().where(F.contains("category", F.lit(" ")))
    return curation.merge_small_classes(rows, parents, 350)


@register("renormalized", f"WITH {CATALOG_SQL} SELECT count(*) AS reviewed, count(*) FILTER (WHERE seq % 10 <> 1 AND (seq % 6 = 0 AND category IS DISTINCT FROM 'x')) AS changed, count(*) FILTER (WHERE seq % 10 = 1) AS locked FROM catalog")
def renormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    before = rows.withColumn("locked_by", F.when(F.col("seq") % 10 == 1, F.lit("human")))
    after = rows.withColumn("category", F.when(F.col("seq") % 6 == 0, "x").otherwise(F.col("category")))
    return curation.renormalized(before, after, ["category", "gender"])
