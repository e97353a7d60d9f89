"""Registered queries of the name and price parsers, each beside its SQL, over texts made from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import normalize as n
from mercato.functions import prices, text
from mercato.operators import history, upsert
from mercato.plans.adapter import CATALOG_SQL, catalog

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


PHRASES = [
    "Remera oversize Nike de mujer talle M", "Zapatillas running Adidas Ultraboost", "Buzo canguro niños", "Campera inflable Columbia para hombre", "Pack x3 Medias deportivas", "Calza térmica running",
    "Notebook Lenovo 15 pulgadas", "Proteína Whey 1kg", "Conjunto deportivo gym", "Short de baño Quiksilver", "Set de 2 Remeras", "Jean baggy azul 42", "Perfume 100 ml", "Remera + Short Puma training",
    "Gorro de natación", "Mochila trekking 40L", "Zapatilla urbana Vans w", "Camisa de hombre (slim)", "Corpiño deportivo push up", "3 boxers", "Pantalón cargo unisex", "Barra proteica 12 unidades",
    "Teclado mecánico RGB", "Female top", "Buzo talle 36 a 44", "Bermuda y Musculosa running", "Placa de video GeForce 12345678", "Creatina ENA 300 g", "Medias de compresión New Balance", "", "Producto original 2,5 kg edicion invierno",
]
PRICES = ["$ 1.234,56", "12.500", "1,299.99", "ARS 45.000,00", "$99", "null", "2.5", "7,5", "1.234.567", "1,234,567", "", "abc", "U$S 1.250,5", "10.00", "nan 500", "0", "999999999", "$ 3.499"]
WORDS = ["Remeras", "calzado", "Nutricion", "Otros", "Accesorios de mujer", "Electro"]
_pick = lambda options, step: "CASE p_partkey % {} {} END".format(len(options), " ".join("WHEN {} THEN '{}'".format(k * step % len(options), o) for k, o in enumerate(options)))
COLUMNS = [
    "p_partkey AS seq",
    f"{_pick(PHRASES, 1)} || CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name WHEN 1 THEN ' ' || p_brand ELSE '' END AS name",
    f"CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {_pick(WORDS, 1)} END AS raw",
    "CASE p_partkey % 8 WHEN 0 THEN 'Hombre' WHEN 1 THEN ' Mujer ' WHEN 2 THEN NULL ELSE '' END AS raw_gender",
    f"{_pick(PRICES, 5)} AS price_text",
    "CASE p_partkey % 6 WHEN 0 THEN 'small,M' WHEN 1 THEN ' xl ,XL,talle unico' WHEN 2 THEN '38.5,40 eur,,3xl' WHEN 3 THEN 'extra large,Default Title' ELSE 'T-42/demasiado largo,S' END AS size_list",
    "'https://shop' || (p_partkey % 7) || '.example/p/' || p_partkey || '?a=1' AS url",
    "'Site ' || (p_partkey % 9) AS site",
]
NAMES_SQL = f"names AS (SELECT {', '.join(COLUMNS)} FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*COLUMNS)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]"


def _fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{text.ACCENTED}', '{text.PLAIN}')"


TAXONOMY = n.Taxonomy()
_PADDED = "' ' || {} || ' '"


def _pad(x: str) -> str:
    return f"(' ' || {_fold(x)} || ' ')"


def _rule(x: str, rules) -> str:
    pairs = ", ".join(f"{{'c': {_quoted(c)}, 'k': {_quoted(k)}}}" for c, k in rules)
    return f"list_filter([{pairs}], lambda r: contains({_pad(x)}, r.k))[1].c"


def _untextile(x: str) -> str:
    words = "|".join(f" {w} " for w in TAXONOMY.not_textile)
    return f"regexp_matches(' ' || substr({_fold(x)}, 1, 35) || ' ', '{words}')"


def _set_sql(x: str) -> str:
    of = lambda cs: [r for r in TAXONOMY.rules if r[0] in cs]
    found = _rule(x, TAXONOMY.rules)
    return f"CASE WHEN {_untextile(x)} THEN NULL WHEN {_rule(x, of(n.TORSO))} IS NOT NULL AND {_rule(x, of(n.LEGS))} IS NOT NULL AND {found} NOT IN ({_list(n.SUPPLEMENTS)[1:-1]}) THEN 'Conjunto' ELSE {found} END"


_CATEGORY = f"coalesce({_set_sql('name')}, {_set_sql('raw')}, CASE WHEN regexp_matches({_fold('trim(name)')}, '\\d+\\s*(g|ml|kg|mg|oz|l)\\s*$') THEN 'Alimentos' END, 'Otros')"
_CATS = f"WITH {NAMES_SQL}, cats AS (SELECT *, {_CATEGORY} AS category FROM names)"


def _cats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).withColumn("category", n.category(F.col("raw"), F.col("name"), TAXONOMY))


@register("name_category", f"{_CATS} SELECT seq, category FROM cats")
def name_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cats(spark, sf_dir).select("seq", "category")


_ALL = f"(coalesce({_fold('raw_gender')}, '') || ' ' || {_fold('name')})"


@register(
    "name_gender",
    f"""{_CATS}, t AS (SELECT *, {_fold("name")} AS f, {_ALL} AS a FROM cats) SELECT seq, CASE WHEN regexp_matches(a, 'nino|nina|kids|infantil|bebe') THEN 'infantil'
    WHEN f LIKE '%de mujer%' OR f LIKE '%para mujer%' THEN 'mujer' WHEN f LIKE '%de hombre%' OR f LIKE '%para hombre%' THEN 'hombre'
    WHEN category IN ({_list(n.FEMININE)[1:-1]}) AND NOT regexp_matches(f, ' hombre|masculino|caballero') THEN 'mujer'
    WHEN regexp_matches(a, 'hombre|masculino| men|male|caballero|varones') THEN 'hombre' WHEN regexp_matches(a, 'mujer|femenino|women|female|dama') THEN 'mujer'
    WHEN regexp_matches(a, 'unisex|neutro') THEN 'unisex' WHEN regexp_matches(a, 'wmns|w | w\\)') THEN 'mujer' WHEN trim(coalesce(raw_gender, '')) <> '' THEN lower(trim(raw_gender))
    WHEN category = 'Calza' THEN 'mujer' ELSE '' END AS gender FROM t""",
)
def name_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cats(spark, sf_dir).select("seq", n.gender(F.col("raw_gender"), F.col("name"), F.col("category")).alias("gender"))


_BRAND = f"coalesce(list_filter({_list(n.BRANDS)}, lambda b: regexp_matches(lower(name), '\\b' || regexp_escape(lower(b)) || '\\b'))[1], '')"


@register("name_brand", f"WITH {NAMES_SQL} SELECT seq, {_BRAND} AS brand FROM names")
def name_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", n.brand(F.col("name"), tuple(n.BRANDS)).alias("brand"))


_PLURALS = "|".join([*(w + "s" for w in n.COUNTED if w != "pantalon"), "pantalones"])
_words = lambda cs: "|".join(k.strip() for c, k in TAXONOMY.rules if c in cs)
_GAP = r"[^+/]{0,28}?(?:\+|/|\by\b|\be\b).{0,28}?"
_number = lambda pattern: f"TRY_CAST(nullif(regexp_extract(t, {_quoted(pattern)}, 1), '') AS INT)"


@register(
    "name_units",
    f"""WITH {NAMES_SQL}, x AS (SELECT *, {_pad("name")} AS t FROM names), c AS (SELECT *, coalesce({_number(n.PACK)}, {_number(n.PACK_TIMES)}, {_number(rf"\b(\d{{1,2}})\s+(?:{_PLURALS})\b")}, {_number(n.PIECES)}) AS k FROM x)
    SELECT seq, CAST(CASE WHEN regexp_matches(t, {_quoted(n.NO_PACK)}) OR {_untextile("name")} THEN 1 WHEN k IS NOT NULL THEN CASE WHEN k BETWEEN 2 AND 12 THEN k ELSE 1 END
    WHEN regexp_matches(t, {_quoted(f"(?:{_words(n.TORSO)}){_GAP}(?:{_words(n.LEGS)})")}) OR regexp_matches(t, {_quoted(f"(?:{_words(n.LEGS)}){_GAP}(?:{_words(n.TORSO)})")}) THEN 2 ELSE 1 END AS INT) AS units FROM c""",
)
def name_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", n.units(F.col("name"), TAXONOMY).alias("units"))


_OWN = [f"WHEN category = {_quoted(c)} AND {f'regexp_matches(t, {_quoted(f" (?:{w}) ")})' if w else 'true'} THEN {_quoted(s)}" for c, subs in n.SUB_CATEGORIES.items() for s, w in subs.items()]
_SPORT = [f"WHEN regexp_matches(t, {_quoted(f' (?:{w}) ')}) AND {'NOT contains(' + _fold('category') + ", 'running')" if s == 'running' else 'true'} THEN {_quoted(s)}" for s, w in n.SPORTS.items()]


@register("name_sub_category", f"{_CATS}, x AS (SELECT *, {_pad('name')} AS t FROM cats) SELECT seq, CASE WHEN trim(name) = '' THEN '' {' '.join(_OWN)} {' '.join(_SPORT)} ELSE '' END AS sub_category FROM x")
def name_sub_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cats(spark, sf_dir).select("seq", n.sub_category(F.col("name"), F.col("category")).alias("sub_category"))


_TEXTILE = _list([*n.SHOES, *n.TORSO, *n.LEGS, *n.UNDERWEAR, *n.ACCESSORIES])[1:-1]
_FORCED = "CASE seq % 5 WHEN 0 THEN 'tecnologia' WHEN 1 THEN 'suplementos' END"
_VERTICAL = f"""CASE WHEN forced = 'tecnologia' AND category NOT IN ({_TEXTILE}) THEN 'tecnologia' WHEN category IN ({_list(n.SUPPLEMENTS)[1:-1]}) THEN 'suplementos'
    WHEN forced = 'suplementos' AND category NOT IN ({_TEXTILE}) THEN 'suplementos' WHEN category IN ({_TEXTILE}) THEN 'indumentaria' WHEN seq % 3 = 0 THEN 'hogar' ELSE 'indumentaria' END"""


@register(
    "name_vertical",
    f"""{_CATS}, v AS (SELECT *, {_BRAND} AS brand, {_VERTICAL} AS vertical FROM (SELECT *, {_FORCED} AS forced FROM cats))
    SELECT seq, vertical, category NOT IN ({_list([*n.SHOES, "Suplemento", "Alimentos"])[1:-1]}) AND vertical <> 'suplementos' AND (regexp_matches({_fold("name")}, '{"|".join(TAXONOMY.gym_words)}') OR lower(brand) IN ({_list(TAXONOMY.gym_brands)[1:-1]}) OR regexp_matches(regexp_replace(lower(site), '[^a-z0-9]', '', 'g'), '{"|".join(TAXONOMY.gym_sites)}')) AS gym FROM v""",
)
def name_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cats(spark, sf_dir).withColumns({"forced": F.expr(_FORCED), "brand": n.brand(F.col("name"), tuple(n.BRANDS))})
    rows = rows.withColumn("vertical", n.vertical(F.col("category"), F.col("forced"), F.when(F.col("seq") % 3 == 0, "hogar")))
    gym = n.is_gym(F.col("name"), text.site_key(F.col("site")), F.col("category"), F.col("vertical"), F.col("brand"), TAXONOMY)
    return rows.select("seq", "vertical", gym.alias("gym"))


_SIZE_MAP = "CASE lower(trim(x)) " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in text.SIZES.items()) + " ELSE CASE WHEN length(regexp_replace(upper(trim(x)), '[^A-Z0-9./]', '', 'g')) <= 6 THEN regexp_replace(upper(trim(x)), '[^A-Z0-9./]', '', 'g') ELSE '' END END"


@register(
    "name_sizes",
    f"WITH {NAMES_SQL}, e AS (SELECT seq, unnest(string_split(size_list, ',')) AS x, generate_subscripts(string_split(size_list, ','), 1) AS i FROM names), m AS (SELECT seq, min(i) AS i, {_SIZE_MAP} AS s FROM e GROUP BY seq, s HAVING trim(s) <> '') SELECT seq, string_agg(s, ',' ORDER BY i) AS sizes FROM m GROUP BY seq",
)
def name_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", F.array_join(text.sizes(F.split("size_list", ",")), ",").alias("sizes")).where("sizes <> ''")


_CLEAN = "name"
for _pattern in text.UNSEARCHED:
    _CLEAN = f"regexp_replace({_CLEAN}, {_quoted('(?i)' + _pattern)}, '', 'g')"


@register(
    "search_queries",
    f"""WITH {NAMES_SQL}, c AS (SELECT seq, trim(regexp_replace(regexp_replace({_CLEAN}, '[,/|()\\[\\]]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS t FROM names), w AS (SELECT *, regexp_extract(t, '^(.{{0,20}}) ', 1) AS whole FROM c)
    SELECT seq, CASE WHEN trim(t) = '' THEN (SELECT substr(name, 1, 40) FROM names WHERE names.seq = w.seq) WHEN length(t) > 20 THEN trim(CASE WHEN length(whole) > 15 THEN whole ELSE substr(t, 1, 20) END) ELSE t END AS query FROM w""",
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", text.search_query(F.col("name"), 20).alias("query"))


@register(
    "url_helpers",
    f"WITH {NAMES_SQL} SELECT seq, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS domain, regexp_replace(regexp_replace({_fold('name')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(site), '[^a-z0-9]', '', 'g') AS site_key FROM names",
)
def url_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", text.domain(F.col("url")).alias("domain"), text.slug(F.col("name")).alias("slug"), text.site_key(F.col("site")).alias("site_key"))


_PRICED = f"WITH {NAMES_SQL}, d AS (SELECT seq, price_text AS raw, regexp_replace(price_text, '[^0-9.,]', '', 'g') AS d FROM names), p AS (SELECT *, length(d) - length(replace(d, '.', '')) AS dots, length(d) - length(replace(d, ',', '')) AS commas, length(d) - strpos(d, '.') AS tail FROM d)"
_COMMA = "replace(replace({0}, '.', ''), ',', '.')"


def _price_sql(text_sql: str, most: str, valid: str = "true") -> str:
    return f"{_PRICED}, v AS (SELECT seq, CASE WHEN {valid} THEN TRY_CAST({text_sql} AS DOUBLE) END AS v FROM p) SELECT seq, CASE WHEN v > 0 AND {most} THEN v END AS price FROM v"


@register("price_local", _price_sql(f"CASE WHEN commas = 1 THEN {_COMMA.format('d')} WHEN dots = 1 AND commas = 0 AND tail <= 2 THEN d ELSE replace(replace(d, '.', ''), ',', '') END", "v < 1e8", r"NOT regexp_matches(raw, '(?i)\b(nan|null|undefined|none)\b')"))
def price_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", prices.local_price(F.col("price_text")).alias("price"))


@register("price_listing", _price_sql(f"CASE WHEN dots > 0 AND commas > 0 THEN {_COMMA.format('d')} WHEN commas = 1 THEN replace(d, ',', '.') WHEN commas > 1 THEN replace(d, ',', '') WHEN dots > 1 OR dots = 1 AND tail = 3 THEN replace(d, '.', '') ELSE d END", "true"))
def price_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", prices.listing_price(F.col("price_text")).alias("price"))


@register("price_tech", _price_sql(f"CASE WHEN commas = 1 THEN {_COMMA.format('d')} ELSE replace(replace(d, '.', ''), ',', '') END", "v < 2e8"))
def price_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", prices.tech_price(F.col("price_text")).alias("price"))


_SHOP = "regexp_replace(regexp_replace(raw, '[A-Za-z$€£]', '', 'g'), '\\s+', '', 'g')"


@register(
    "price_shop",
    f"""{_PRICED}, s AS (SELECT seq, {_SHOP} AS s FROM p), v AS (SELECT seq, TRY_CAST(CASE WHEN regexp_matches(s, ',\\d\\d$') THEN {_COMMA.format("s")} WHEN regexp_matches(s, '\\.\\d\\d$') AND length(s) - length(replace(s, '.', '')) = 1 THEN replace(s, ',', '')
    WHEN regexp_matches(s, '\\.\\d\\d$') THEN {_COMMA.format("s")} ELSE replace(replace(s, '.', ''), ',', '') END AS DOUBLE) AS v FROM s) SELECT seq, CASE WHEN v > 0 THEN v END AS price FROM v""",
)
def price_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("seq", prices.shop_price(F.col("price_text")).alias("price"))


_LOCKS = "SELECT url, 'Locked' AS category, CASE WHEN seq % 2 = 0 THEN 'mujer' END AS gender FROM catalog WHERE seq % 12 = 0"


@register("locked_overlay", f"WITH {CATALOG_SQL}, locks AS ({_LOCKS}) SELECT c.url, CASE WHEN l.url IS NOT NULL THEN l.category ELSE c.category END AS category, CASE WHEN l.url IS NOT NULL THEN l.gender ELSE c.gender END AS gender FROM catalog c LEFT JOIN locks l USING (url)")
def locked_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    locks = rows.where("seq % 12 = 0").select("url", F.lit("Locked").alias("category"), F.when(F.col("seq") % 2 == 0, "mujer").alias("gender"))
    return upsert.apply_locks(rows, locks).select("url", "category", "gender")


@register(
    "refreshed_snapshot",
    f"WITH {CATALOG_SQL} SELECT url, CASE WHEN seq % 5 = 0 OR seq % 7 = 0 THEN price * 2 ELSE price END AS derived FROM catalog WHERE seq % 11 <> 3",
)
def refreshed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    previous = rows.where("seq % 7 <> 0").select("url", F.col("price").alias("derived"))
    now = rows.where("seq % 11 <> 3")
    return upsert.refresh(previous, now, rows.where("seq % 5 = 0"), lambda r: r.select("url", (F.col("price") * 2).alias("derived")))


@register(
    "inflation_factor",
    "WITH ix AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1), r AS (SELECT value, row_number() OVER (ORDER BY day DESC) AS k FROM ix) SELECT m.months, floor(coalesce((SELECT value FROM r WHERE k = 1) / (SELECT value FROM r WHERE k = m.months + 1 AND value > 0), pow(1.04, m.months)) * 1e6 + 0.5) / 1e6 AS factor FROM (VALUES (3), (12), (500)) m(months)",
)
def inflation_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    index = orders.groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    found = [(m, float(history.inflation_factor(index, m, 0.04))) for m in (3, 12, 500)]
    return spark.createDataFrame(found, "months int, factor double").select("months", (F.floor(F.col("factor") * 1e6 + 0.5) / 1e6).alias("factor"))
