"""Queries over training rows, label rules, guesses of models, backfills and combos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import classify, curation, optimize, similarity, upsert
from mercato.plans.adapter import CATALOG_SQL, catalog
from mercato.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_literal, values)) + "]"


def _of(values: list[str], place: str) -> str:
    """SQL of both engines: the value at ``place`` modulo their number."""
    return f"CASE ({place}) % {len(values)} " + " ".join(f"WHEN {k} THEN {_literal(v)}" for k, v in enumerate(values)) + " END"


@register(
    "training_rows",
    f"WITH {CATALOG_SQL}, r AS (SELECT url, name, category FROM catalog WHERE active AND trim(coalesce(name, '')) <> '' AND trim(coalesce(category, '')) <> '' AND category NOT LIKE 'STANDARD%TIN') SELECT * FROM r WHERE category IN (SELECT category FROM r GROUP BY category HAVING count(*) >= 12)",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    generic = [f"STANDARD {x} TIN" for x in ("ANODIZED", "BRUSHED", "BURNISHED", "PLATED", "POLISHED")]
    return classify.training_rows(rows, generic)


_NAMES = ["Remera Negra talle XL hombre", "  Zapatilla Azul size 42,5 ", "Buzo gris M unisex", "Campera T. 40 mujer roja", "Jean ROJO l", "Pantalón xxl beige", "Gorra  dorado  masculino", "Short"]


@register(
    "training_text",
    f"WITH {CATALOG_SQL}, w(k, t) AS (VALUES (0, 'remera negra'), (1, 'zapatilla'), (2, 'buzo'), (3, 'campera roja'), (4, 'jean'), (5, 'pantalon'), (6, 'gorra'), (7, 'short')) SELECT url, trim(t || ' ' || seq) AS text FROM catalog JOIN w ON seq % 8 = k",
)
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(f"concat({_of(_NAMES, 'seq')}, ' ', seq)")
    return catalog(spark, sf_dir).select("url", curation.training_text(name).alias("text"))


_FILED = ["Zapatilla", " remera ", "Jean", "Ojotas", "Indumentaria", "Mochila", "Gorra", "Pantalon", "Campera", "Otros"]
_SOLD = ["Sandalia de tiras negra", "Botin futbol", "REMERA lisa", "Campera puffer", "Jean baggy cargo", "Chomba pique polo", "Chaleco inflable", "Bermuda walk short", "Riñonera waist bag", "Billetera cuero", "Gorro lana", "Algo"]
_RULES = " ".join(f"WHEN list_contains({_list(wrong)}, lower(trim(filed))) AND len(list_filter({_list(words)}, lambda w: contains(lower(sold), w))) > 0 THEN {_literal(right)}" for words, wrong, right in curation.CORRECTIONS)


@register("label_corrections", f"WITH {CATALOG_SQL}, r AS (SELECT url, {_of(_FILED, 'seq')} AS filed, {_of(_SOLD, 'seq // 3')} AS sold FROM catalog) SELECT url, CASE {_RULES} ELSE trim(filed) END AS category FROM r")
def label_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).selectExpr("url", f"{_of(_FILED, 'seq')} AS filed", f"{_of(_SOLD, 'seq div 3')} AS sold")
    return rows.select("url", curation.corrected_label(F.col("sold"), F.col("filed")).alias("category"))


_NOW = ["Zapatilla Running", "Remera", "Conjunto", "Otros", "Jean", "Pantalon", "", "Gorra", "Cinturón", "Ojotas", "Desconocida"]
_GUESSES = ["Zapatilla", "Remera", "Pantalon", "Buzo", "", "Gorra", "Monitor", "Campera", "Otra", "Cinturon", "Jean", "Ojotas", "Mochila"]
_GENERIC = ["otros", "indumentaria", "general"]
_LABELS = [g for g in _GUESSES if g not in ("", "Mochila")]
#: Guesses and their confidences as SQL of both engines; ``//`` is the whole division.
_GUESSED = [f"{_of(_NOW, 'seq')} AS category", f"{_of(_GUESSES, 'seq // 11')} AS text_guess", "(seq * 7 % 41) / 40e0 AS text_confidence", f"{_of(_GUESSES, 'seq // 7')} AS image_guess", "(seq * 11 % 41) / 40e0 AS image_confidence"]


@register(
    "ensemble_override",
    f"""WITH {CATALOG_SQL}, r AS (SELECT url, {', '.join(_GUESSED)} FROM catalog), kinds(c, kind) AS (VALUES {', '.join(f"({_literal(c)}, {_literal(k)})" for k, listed in classify.KINDS.items() for c in listed)}), parents(c, parent) AS (VALUES {', '.join(f"({_literal(c)}, {_literal(p)})" for c, p in classify.PARENTS.items())}),
    g AS (SELECT *, image_guess IN ({_list(_LABELS)[1:-1]}) AND image_confidence > text_confidence AS by_image FROM r), s AS (SELECT *, CASE WHEN by_image THEN image_guess ELSE nullif(text_guess, '') END AS guess, CASE WHEN by_image THEN image_confidence ELSE text_confidence END AS conf, lower(category) IN ('', {_list(_GENERIC)[1:-1]}) AS generic FROM g),
    j AS (SELECT s.*, a.kind AS own_kind, b.kind AS guess_kind, parent FROM s LEFT JOIN kinds a ON a.c = translate(lower(s.category), 'óáú', 'oau') LEFT JOIN kinds b ON b.c = translate(lower(s.guess), 'óáú', 'oau') LEFT JOIN parents p ON p.c = lower(s.category)),
    m AS (SELECT *, guess IS NOT NULL AND guess <> category AND lower(category) <> 'conjunto' AND conf >= 0.82 AND (generic OR conf >= 0.92) AND (own_kind IS NULL OR guess_kind IS NULL OR own_kind = guess_kind) AND (parent IS NULL OR lower(guess) <> parent) AND (NOT by_image OR generic OR text_confidence < 0.75) AS may FROM j)
    SELECT url, CASE WHEN may THEN guess ELSE category END AS category, CASE WHEN may THEN category END AS category_before, CASE WHEN may THEN round(conf, 3) END AS category_confidence FROM m""",
)
def ensemble_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).selectExpr("url", *[x.replace("//", "div") for x in _GUESSED])
    return classify.ensemble(rows, _GENERIC, _LABELS).select("url", "category", "category_before", "category_confidence")


@register(
    "demand_threshold",
    f"WITH {CATALOG_SQL}, s AS (SELECT count(*) AS size FROM catalog GROUP BY name), l AS (SELECT list(size ORDER BY size DESC) AS sizes, quantile_cont(size, 0.5) AS median, count(*) AS n FROM s) SELECT CAST(greatest(8, least(sizes[greatest(1, CAST(floor(n * 0.1) AS BIGINT))], 3 * median)) AS DOUBLE) AS threshold FROM l",
)
def demand_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = catalog(spark, sf_dir).groupBy("name").agg(F.count("*").alias("size"))
    return similarity.demand_threshold(sizes)


@register("fk_violations", f"WITH {CATALOG_SQL} SELECT url, brand FROM catalog WHERE brand IS NOT NULL AND brand NOT IN (SELECT brand FROM catalog WHERE seq % 2 = 1 AND brand IS NOT NULL AND brand > 'Brand#3')")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    lookup = rows.where("seq % 2 = 1 and brand > 'Brand#3'").select(F.col("brand").alias("name")).distinct()
    return upsert.fk_violations(rows, lookup, "brand", "name").select("url", "brand")


# Categories that shops invented, and those of the closed vocabulary that they became.
CLOSED = {"Abrigos": "Campera", "Coat": "Campera", "Bufandon": "Bufanda", "Remeron": "Remera", "Mini": "Bolso", "Neceser": "Bolso", "Pc": "PC", "Porta": "Otros", "Cooling": "Otros", "Tarjetas": "Otros", "Indumentaria": "Otros"}
_OPEN = [*CLOSED, "Remera", "PC"]


@register("category_backfill", f"WITH {CATALOG_SQL}, n(old, new) AS (VALUES {', '.join(f'({_literal(a)}, {_literal(b)})' for a, b in CLOSED.items())}), r AS (SELECT url, CASE WHEN seq % 15 <> 0 THEN {_of(_OPEN, 'seq')} END AS category FROM catalog) SELECT url, coalesce(new, category) AS category FROM r LEFT JOIN n ON category = old")
def category_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).selectExpr("url", f"CASE WHEN seq % 15 <> 0 THEN {_of(_OPEN, 'seq')} END AS category")
    return upsert.renamed_values(rows, "category", CLOSED)


@register("site_brand_backfill", f"WITH {CATALOG_SQL}, r AS (SELECT url, site, CASE WHEN seq % 2 = 0 THEN site ELSE brand END AS brand FROM catalog) SELECT url, CASE WHEN brand = site AND brand NOT IN ('Site 2', 'Site 4') THEN '' ELSE brand END AS brand FROM r")
def site_brand_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumn("brand", F.when(F.col("seq") % 2 == 0, F.col("site")).otherwise(F.col("brand")))
    return upsert.without_site_brands(rows, ["Site 2", "Site 4"]).select("url", "brand")


@register("child_backfill", f"WITH {CATALOG_SQL}, x AS (SELECT url, unnest(sizes) AS size, generate_subscripts(sizes, 1) AS place FROM catalog) SELECT url, place, size FROM x WHERE size <> ''")
def child_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.child_rows(catalog(spark, sf_dir), "sizes", "size")


@register("protecting_favourites", f"WITH {CATALOG_SQL} SELECT DISTINCT 'p' || (event_id % 3000 + 1) AS url FROM events WHERE 'p' || (event_id % 3000 + 1) IN (SELECT url FROM catalog)")
def protecting_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    favourites = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("p"), (F.col("event_id") % 3000 + 1).cast("string")).alias("url")).distinct()
    return upsert.protecting(catalog(spark, sf_dir), favourites)


@register("json_rows", f"""WITH {CATALOG_SQL} SELECT '{{"url":"' || url || '","site":"' || site || '","score":' || score || coalesce(',"gender":"' || gender || '"', '') || '}}' AS json FROM catalog""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_page(catalog(spark, sf_dir).select("url", "site", "score", "gender"))


_UNITS = [" g", " ml", " capsulas", ""]
_KIND = "'kind ' || (seq % 7)"


@register(
    "combos",
    f"""WITH {CATALOG_SQL}, {'r AS (SELECT *, ' + _KIND + ' AS kind, seq % 4 AS f, seq % 900 + 1 AS amount, CASE brand WHEN ' + "'Brand#23' THEN 0 WHEN 'Brand#11' THEN 1 ELSE 2 END AS rank FROM catalog)"},
    b AS (SELECT * FROM r QUALIFY rank = min(rank) OVER (PARTITION BY kind)), c AS (SELECT kind, f AS common FROM (SELECT kind, f, count(*) AS n FROM b WHERE f < 3 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, f) = 1),
    s AS (SELECT b.*, CASE WHEN f = common THEN price / amount END AS per, 100 - score + CASE WHEN deal THEN 25 ELSE 0 END + CASE WHEN list_contains(badges, 'verified_deal') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'all_time_low') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'below_market') THEN 10 ELSE 0 END + CASE WHEN coalesce(nullif(trim(trend), ''), 'estable') <> 'estable' THEN 8 ELSE 0 END AS opp FROM b LEFT JOIN c USING (kind))
    SELECT kind, url, price FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY per NULLS LAST, opp DESC, price, url) = 1""",
)
def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumns({"kind": F.expr(_KIND), "name": F.expr(f"'Item ' || (seq % 900 + 1) || {_of(_UNITS, 'seq')}")})
    return optimize.combo(rows, ["Brand#23", "Brand#11"])
