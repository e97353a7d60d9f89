"""Registered queries of the text classifier over the catalog's names; grams, weights and split beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import cascade, text_model
from mercato.operators.graph import cut
from mercato.plans import category_queries as names
from mercato.plans import name_queries as q

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a keyword of their category among other words."""
    rows = names.names(spark, sf_dir).select(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("url"), "name", "raw")
    return cascade.categorize(rows, cascade=names.RULES, raw="raw", to="category").where("category <> 'Otros'").select("url", "name", "category")


_ROWS = f"{names._CATS}, labelled AS (SELECT 'p' || seq AS url, name, category FROM cats WHERE category <> 'Otros')"


@register(
    "text_split",
    f"""WITH {_ROWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(url), url) AS k, count(*) OVER (PARTITION BY category) AS n FROM labelled)
    SELECT url, category, n > 1 AND k <= greatest(floor(n * 0.2 + 0.5), 1) AS held_out FROM ranked""",
)
def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_model.stratified(_rows(spark, sf_dir)).select("url", "category", "held_out")


@register(
    "text_grams",
    f"""WITH names AS (SELECT {', '.join(names._DUCK)} FROM part),
    words AS (SELECT 'p' || seq AS url, ' ' || unnest(list_filter(regexp_split_to_array({q._fold('name')}, '\\s+'), lambda w: w <> '')) || ' ' AS w, generate_subscripts(list_filter(regexp_split_to_array({q._fold('name')}, '\\s+'), lambda w: w <> ''), 1) AS place FROM names),
    grams AS (SELECT url, substr(w, i::BIGINT, n::BIGINT) AS gram FROM words, generate_series(2, 5) AS lengths(n), generate_series(1, 60) AS places(i) WHERE n <= length(w) AND i <= length(w) - n + 1),
    counts AS (SELECT url, gram, count(*) AS n FROM grams GROUP BY url, gram),
    kept AS (SELECT gram, ln(((SELECT count(*) FROM names) + 1) / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY gram HAVING count(*) >= 2 ORDER BY sum(n) DESC, gram LIMIT 3000),
    raw AS (SELECT url, gram, (1 + ln(n)) * idf AS w FROM counts JOIN kept USING (gram))
    SELECT url, gram, floor(w / sqrt(sum(w * w) OVER (PARTITION BY url)) * 10000 + 0.500001) / 10000 AS weight FROM raw""",
)
def text_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names.names(spark, sf_dir).select(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("url"), "name")
    found = text_model.weights(rows, text_model.vocabulary(rows, most=3000))
    return found.select("url", "gram", (F.floor(F.col("weight") * 10000 + 0.500001) / 10000).alias("weight"))


@register("text_classifier")
def text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses for held-out names by a model of the others."""
    rows = cut(text_model.stratified(_rows(spark, sf_dir)))
    model = text_model.fit(rows.where("not held_out"))
    return text_model.predict(model, rows.where("held_out")).select("url", "category", "guess", "confidence")
