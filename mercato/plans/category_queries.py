"""Registered queries of the keyword cascade and of the whole normaliser, beside their SQL.

Names join keywords of the taxonomy with the part table's own words, so that every category and every guard comes up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import normalize as n
from mercato.operators import cascade
from mercato.plans import name_queries as q

QUERIES: dict = {}
ORACLES: dict = {}
KEYWORDS = cascade.default_keywords()
#: Keywords, and pairs of which only both together name a category.
WORDS = sorted({k for _, k in KEYWORDS} | {"footwear skate", "zapatilla crossfit", "tenis trail", "calzado urbana", "footwear 300 ml", "copa cancha", "reef slide"})
RAW = [*cascade.ALIASES, "Collar ", "Kit de VCP", "vcp > Mini / x", "Shop | Abrigos", "Cosas", "  "]
SHOPS = ("vcp", "shop")
RULES = cascade.Cascade(shops=SHOPS)


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _names(pick) -> list[str]:
    """Columns over part; ``pick`` makes SQL for the element of a fixed list at an expression."""
    one, two = pick(WORDS, "p_partkey + CAST(floor(p_partkey / 5) AS INT)"), pick(WORDS, "p_partkey * 7 + CAST(floor(p_partkey / 11) AS INT)")
    ends = "CASE p_partkey % 9 WHEN 1 THEN ' 500 g' WHEN 2 THEN ' talle 38' WHEN 3 THEN ' de hombre' WHEN 4 THEN ' x 3 unidades' ELSE '' END"
    return [
        "p_partkey AS seq",
        f"CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || {one} WHEN 1 THEN {one} || ' Ñandú ' || {two} WHEN 2 THEN upper({one}) || ' ' || p_brand WHEN 3 THEN {two} || ' ' || p_type || ' ' || {one} ELSE p_name END || {ends} AS name",
        f"CASE p_partkey % 4 WHEN 0 THEN {pick(RAW, 'p_partkey')} WHEN 1 THEN {two} WHEN 2 THEN p_type END AS raw",
        "CASE p_partkey % 8 WHEN 0 THEN 'Hombre' WHEN 1 THEN ' Mujer ' WHEN 2 THEN NULL ELSE '' END AS raw_gender",
        "CASE p_partkey % 6 WHEN 0 THEN 'small,M' WHEN 1 THEN ' xl ,XL,talle unico' WHEN 2 THEN '38.5,40 eur,,3xl' WHEN 3 THEN 'extra large,Default Title' ELSE 'T-42/demasiado largo,S' END AS size_list",
        "'Site ' || (p_partkey % 5) AS site",
    ]


_SPARK = _names(lambda words, at: f"array({', '.join(map(q._quoted, words))})[CAST(({at}) % {len(words)} AS INT)]")
_DUCK = _names(lambda words, at: f"{q._list(words)}[CAST(({at}) % {len(words)} AS INT) + 1]")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*_SPARK)


def _category_sql(steps) -> str:
    """Common table expressions from names to ``cats``, which adds category."""
    rules = ", ".join(f"({q._quoted(g)}, {q._quoted(k)})" for g, k in KEYWORDS)
    any_of = lambda gs: " OR ".join([f"list_has_any(groups, {q._list([g for g in gs if g != 'weight'])})"] * any(g != "weight" for g in gs) + ["weighs"] * ("weight" in gs))
    whens = " ".join(f"WHEN {' AND '.join(f'({any_of(need)})' for need in s.needs)}{f' AND NOT ({any_of(s.lacks)})' if s.lacks else ''} THEN {q._quoted(s.category)}" for s in steps)
    veto = "|".join(cascade.NOT_TEXTILE)
    weighs = lambda x: f"regexp_matches(trim({x}), '(?i)\\d+\\s*(g|ml|kg|mg|oz|l)\\s*$')"
    aliases = "CASE {} " + " ".join(f"WHEN {q._quoted(k)} THEN {q._quoted(v)}" for k, v in cascade.ALIASES.items()) + " END"
    cleaned = f"trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\b({'|'.join(SHOPS)})\\b', '', 'gi'), '[>|/\\\\]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"
    return f"""names AS (SELECT {", ".join(_DUCK)} FROM part), rules(g, k) AS (VALUES {rules}),
    texts AS (SELECT DISTINCT t FROM (SELECT name AS t FROM names UNION ALL SELECT raw FROM names) WHERE t IS NOT NULL),
    held AS (SELECT t, coalesce(list(DISTINCT g) FILTER (g IS NOT NULL), []) AS groups, {weighs("t")} AS weighs FROM texts LEFT JOIN rules ON contains({q._pad("t")}, k) GROUP BY t),
    judged AS (SELECT t, CASE WHEN trim(t) = '' OR regexp_matches(substr({q._fold("t")}, 1, 35), '(?:^| )(?:{veto}) |^(?:{veto})$') THEN NULL {whens} END AS c FROM held),
    cats AS (SELECT names.*, coalesce(a.c, b.c, CASE WHEN trim(raw) <> '' THEN coalesce({aliases.format(f"lower(string_split({cleaned}, ' ')[1])")}, {aliases.format(f"lower({cleaned})")}) END, CASE WHEN {weighs("name")} THEN 'Alimentos' END, 'Otros') AS category
        FROM names LEFT JOIN judged a ON a.t = name LEFT JOIN judged b ON b.t = raw)"""


_CATS = _category_sql(cascade.default_steps())


@register("category_cascade", f"WITH {_CATS} SELECT seq, category FROM cats")
def category_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.categorize(names(spark, sf_dir), cascade=RULES, raw="raw").select("seq", "category")


@register(
    "keyword_groups",
    f"WITH {_CATS} SELECT g AS keyword_group, count(DISTINCT t) AS texts FROM texts JOIN rules ON contains({q._pad('t')}, k) GROUP BY g",
)
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many different texts each group of keywords stands."""
    rows = names(spark, sf_dir)
    groups = list(dict.fromkeys(g for g, _ in KEYWORDS))
    hits = cascade.group_hits(rows.select(F.explode(F.array("name", "raw")).alias("text")), cascade.keyword_table(rows), groups)
    held = F.array(*(F.when(F.get("hits", F.lit(k // cascade.BITS)).bitwiseAND(F.lit(1 << (k % cascade.BITS))) != 0, g) for k, g in enumerate(groups)))
    return hits.select(F.explode(F.array_compact(held)).alias("keyword_group")).groupBy("keyword_group").agg(F.count("*").alias("texts"))


def _part(name: str, prefix: str) -> str:
    """What the SQL of a name query does with the rows of ``names`` or ``cats``."""
    return "(WITH one AS (SELECT 1)" + q.ORACLES[name].removeprefix(prefix) + ")"


_BARE = f"WITH {q.NAMES_SQL}"


@register(
    "normalized_names",
    f"""WITH {_CATS}, genders AS {_part("name_gender", q._CATS)}, subs AS {_part("name_sub_category", q._CATS)}, sold AS {_part("name_vertical", q._CATS)},
    packs AS {_part("name_units", _BARE)}, brands AS {_part("name_brand", _BARE)}, measured AS {_part("name_sizes", _BARE)}
    SELECT seq, category, gender, coalesce(sizes, '') AS sizes, brand, vertical, gym, units, sub_category
    FROM cats JOIN genders USING (seq) JOIN subs USING (seq) JOIN sold USING (seq) JOIN packs USING (seq) JOIN brands USING (seq) LEFT JOIN measured USING (seq)""",
)
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole normaliser, from raw rows to every derived column."""
    sites = spark.createDataFrame([("site0", "tecnologia"), ("site1", "suplementos")], "site_key string, forced_vertical string")
    rows = names(spark, sf_dir).select("seq", "name", F.col("raw").alias("category"), F.col("raw_gender").alias("gender"), F.split("size_list", ",").alias("sizes"), F.lit(None).cast("string").alias("brand"), F.when(F.col("seq") % 3 == 0, "hogar").alias("vertical"), "site")
    done = n.normalize(cascade.categorize(rows, cascade=RULES), sites=sites, categorized=True)
    return done.select("seq", "category", "gender", F.array_join("sizes", ",").alias("sizes"), "brand", "vertical", "gym", "units", "sub_category")
