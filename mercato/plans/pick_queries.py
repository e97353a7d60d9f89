"""Registered queries of random outfits and of substring search by postings, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import optimize, picks
from mercato.operators.substrings import SubstringIndex
from mercato.plans.adapter import CATALOG_SQL, catalog
from mercato.session import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


ORDER = ["torso", "piernas", "pies"]
_SLOT = "CASE seq % 3 WHEN 0 THEN 'torso' WHEN 1 THEN 'piernas' ELSE 'pies' END"
REQUESTS = ["o_orderkey AS request", "o_orderkey AS seed", "CASE WHEN o_custkey % 5 = 0 THEN 0e0 ELSE 3000e0 + o_custkey % 1000 END AS budget", "CASE o_custkey % 4 WHEN 0 THEN 'Hombre' WHEN 1 THEN 'mujer' WHEN 2 THEN 'unisex' END AS gender"]


def _outfits_sql() -> str:
    """A table expression for each slot: every request's candidates with their keys, then the smallest."""
    fits = "(wanted IN ('', 'unisex') OR own IN ('', 'unisex') OR own = wanted)"
    steps, before = [], "req"
    for k, slot in enumerate(ORDER):
        harmony = ["1e0"]
        for j in range(k):
            apart = f"abs(list_position({optimize.WHEEL}, p.color) - list_position({optimize.WHEEL}, color{j}))"
            harmony.append(f"CASE WHEN p.print = 'estampado' AND print{j} = 'estampado' THEN 0.5e0 ELSE 1e0 END")
            harmony.append(f"CASE WHEN p.fit = fit{j} AND p.fit IN ('oversize', 'entallado') AND p.slot IN ('torso', 'piernas') AND '{ORDER[j]}' IN ('torso', 'piernas') THEN 0.7e0 ELSE 1e0 END")
            harmony.append(f"CASE WHEN least({apart}, {len(optimize.WHEEL)} - {apart}) > {optimize.HARMONY} THEN 0.7e0 ELSE 1e0 END")
        u = f"((('0x' || substr(md5(seed || '|{slot}|' || p.url), 1, 13))::BIGINT + 0.5e0) / {1 << 52})"
        weight = f"(least(greatest(p.score / 50e0, 0.5e0), 2.5e0) * {' * '.join(harmony)} / (1 + abs(p.price - centre) / greatest(centre * 0.3e0, 1e0)))"
        steps.append(
            f"c{k} AS (SELECT r.request, CASE WHEN budget <= 0 OR p.price <= lef THEN 0 ELSE 1 END AS dear, CASE WHEN {fits} AND abs(p.price - centre) <= centre * 0.3e0 THEN 0 WHEN {fits} THEN 1 WHEN own IN ('', 'unisex') THEN 2 ELSE 3 END AS step, -ln({u}) / {weight} AS key, p.* FROM {before} r JOIN pool p ON p.slot = '{slot}')"
        )
        steps.append(f"m{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY dear, step, key, url) AS first FROM c{k}) WHERE first = 1 AND dear = 0 AND step < 3)")
        steps.append(f"s{k} AS (SELECT r.* REPLACE (r.lef - coalesce(m.price, 0) AS lef), m.url AS url{k}, m.price AS price{k}, m.fit AS fit{k}, m.print AS print{k}, m.color AS color{k} FROM {before} r LEFT JOIN m{k} m USING (request))")
        before = f"s{k}"
    out = " UNION ALL ".join(f"SELECT request, '{slot}' AS slot, url{k} AS url, price{k} AS price FROM {before} WHERE url{k} IS NOT NULL" for k, slot in enumerate(ORDER))
    score = "100 - score + CASE WHEN deal THEN 25 ELSE 0 END + CASE WHEN list_contains(badges, 'verified_deal') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'all_time_low') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'below_market') THEN 10 ELSE 0 END + CASE WHEN coalesce(nullif(trim(trend), ''), 'estable') <> 'estable' THEN 8 ELSE 0 END"
    return f"""WITH {CATALOG_SQL}, el AS (SELECT *, {_SLOT} AS slot, {score} AS opp FROM catalog WHERE lower(trim(coalesce(gender, ''))) <> 'infantil'),
    pool AS (SELECT slot, url, price, CAST(opp AS DOUBLE) AS score, coalesce(fit, '') AS fit, coalesce(print, '') AS print, coalesce(color, '') AS color, lower(trim(coalesce(gender, ''))) AS own FROM el QUALIFY row_number() OVER (PARTITION BY slot ORDER BY opp DESC, price, url) <= {optimize.SHORTLIST}),
    asked AS (SELECT {", ".join(REQUESTS)} FROM orders), g AS (SELECT DISTINCT lower(trim(coalesce(gender, ''))) AS wanted FROM asked),
    mid AS (SELECT wanted, list_sort(list(price))[count(*) // 2 + 1] AS centre FROM g JOIN pool ON {fits} GROUP BY wanted),
    req AS (SELECT request, seed, budget, budget AS lef, m.wanted, centre FROM asked a JOIN mid m ON m.wanted = lower(trim(coalesce(a.gender, '')))), {", ".join(steps)} {out}"""


@register("weighted_outfits", _outfits_sql())
def weighted_outfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outfit for each order, as a request with a seed, a budget and a gender of its own."""
    rows = catalog(spark, sf_dir).withColumn("category", F.expr(_SLOT))
    slots = spark.createDataFrame([(s, s, False) for s in ORDER], "category string, slot string, gated boolean")
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*REQUESTS)
    found = picks.weighted_outfits(requests, optimize.eligible(rows, slots, None), ORDER)
    return found.select("request", F.explode("picks").alias("p")).select("request", "p.slot", "p.url", "p.price")


_NEEDLES = "SELECT substr(p_type, 2, 5) AS needle FROM part UNION SELECT upper(substr(p_brand, 7)) FROM part UNION SELECT p_name FROM part UNION SELECT 'no such name'"


@register("substring_search", f"WITH {CATALOG_SQL}, needles AS (SELECT DISTINCT lower(needle) AS needle FROM ({_NEEDLES}) WHERE needle <> '') SELECT needle, url FROM catalog JOIN needles ON contains(lower(name), needle)")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose name contains a piece of a type, a brand's digits or a whole name, for all of these at once."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    needles = part.select(F.explode(F.array(F.substring("p_type", 2, 5), F.upper(F.substring("p_brand", 7, 9)), "p_name", F.lit("no such name"))).alias("needle"))
    rows = catalog(spark, sf_dir).select("url", "name")
    index = SubstringIndex(spark, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}").create(rows)
    return index.rows(rows, needles).select(F.col("__needle").alias("needle"), "url")
