"""Catalog, history and feedback tables over the star-schema test tables.

The same expressions are given to Spark and, as common table expressions, to the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = [
    "'p' || p_partkey AS url",
    "p_partkey AS seq",
    "p_name AS name",
    "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN ' ' ELSE p_brand END AS brand",
    "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_type END AS category",
    "p_retailprice AS price",
    "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * (1 + (p_partkey % 60) / 100e0) END AS original_price",
    "'Site ' || (p_partkey % 23) AS site",
    "CASE p_partkey % 6 WHEN 0 THEN 'hombre' WHEN 1 THEN 'mujer' WHEN 2 THEN 'Unisex' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'infantil' END AS gender",
    "CASE p_partkey % 5 WHEN 0 THEN 'premium' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'budget' ELSE 'standard' END AS segment",
    "CASE p_partkey % 4 WHEN 0 THEN 'tecnologia' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'indumentaria' END AS vertical",
    "CASE WHEN p_partkey % 9 = 0 THEN p_size % 5 ELSE 1 END AS units",
    "p_partkey % 10 = 0 AS gym",
    "p_partkey % 11 <> 0 AS active",
    "CASE p_partkey % 7 WHEN 0 THEN 'S,M,L' WHEN 1 THEN 'xl,42' WHEN 2 THEN '38.5,40,M' WHEN 3 THEN '' ELSE 'Unico' END AS size_list",
    "CASE p_partkey % 8 WHEN 0 THEN 'all_time_low' WHEN 1 THEN 'verified_deal,below_market' WHEN 2 THEN 'trending' ELSE '' END AS badge_list",
    "CASE p_partkey % 13 WHEN 0 THEN 'running' WHEN 1 THEN 'invierno' WHEN 2 THEN '' ELSE NULL END AS sub_category",
    "CASE p_partkey % 4 WHEN 0 THEN 'oversize' WHEN 1 THEN 'slim' WHEN 2 THEN '' ELSE 'regular' END AS fit",
    "CASE p_partkey % 3 WHEN 0 THEN 'estampado' WHEN 1 THEN 'liso' ELSE '' END AS print",
    "CASE p_partkey % 5 WHEN 0 THEN 'redondo' ELSE '' END AS neckline",
    "CASE p_partkey % 6 WHEN 0 THEN 'rojo' WHEN 1 THEN 'verde' WHEN 2 THEN 'negro' WHEN 3 THEN 'azul' ELSE '' END AS color",
    "CAST(p_partkey * 37 % 101 AS INT) AS score",
    "p_partkey % 13 = 0 AS deal",
    "CASE p_partkey % 3 WHEN 0 THEN 'bajando' WHEN 1 THEN 'estable' ELSE '' END AS trend",
    "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '//img/' || p_partkey ELSE 'https://img/' || p_partkey END AS image",
]
HISTORY = ["'p' || l_partkey AS url", "CAST(l_shipdate AS DATE) AS day", "floor(l_extendedprice / l_quantity * 100) / 100e0 AS unit_price"]
FEEDBACK = [
    "event_id",
    "'p' || (event_id % 1500 + 1) AS url",
    "CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'view' END AS kind",
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").selectExpr(*CATALOG)
    return rows.selectExpr("* EXCEPT (size_list, badge_list)", "split(size_list, ',') AS sizes", "split(badge_list, ',') AS badges")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change history: one price for each url and day."""
    return _read(spark, sf_dir, "lineitem").selectExpr(*HISTORY).groupBy("url", "day").agg({"unit_price": "min"}).withColumnRenamed("min(unit_price)", "price")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*FEEDBACK)


CATALOG_SQL = f"catalog AS (SELECT * , string_split(size_list, ',') AS sizes, string_split(badge_list, ',') AS badges FROM (SELECT {', '.join(CATALOG)} FROM part))"
HISTORY_SQL = f"history AS (SELECT url, day, min(unit_price) AS price FROM (SELECT {', '.join(HISTORY)} FROM lineitem) GROUP BY url, day)"
FEEDBACK_SQL = f"feedback AS (SELECT {', '.join(FEEDBACK)} FROM events)"
