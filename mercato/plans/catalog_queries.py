"""Queries over the catalog: search, facets, picks, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import text
from mercato.functions.prices import discount_pct, unit_price
from mercato.operators import ranking, search
from mercato.operators.search import CatalogFilter
from mercato.plans.adapter import CATALOG_SQL, FEEDBACK_SQL, catalog, feedback

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


UNIT = "price / greatest(coalesce(units, 1), 1)"
IMAGE = "CASE WHEN starts_with(coalesce(image, ''), '//') THEN 'https:' || image ELSE coalesce(image, '') END"

#: Filters that between them use every predicate; each becomes a query of the matching rows.
FILTERS = {
    "site_brand": (CatalogFilter(site="site 3", brands=("Brand#11", "brand#23", "")), "lower(site) = 'site 3' AND lower(coalesce(brand, '')) IN ('brand#11', 'brand#23')"),
    "sizes": (CatalogFilter(sizes=("m", "42"), gender="MUJER"), "len(list_filter(sizes, lambda x: lower(x) IN ('m', '42'))) > 0 AND lower(coalesce(gender, '')) = 'mujer'"),
    "badges_segment": (CatalogFilter(badges=("below_market",), segment="standard"), "list_contains(badges, 'below_market') AND lower(coalesce(nullif(segment, ''), 'standard')) = 'standard'"),
    "vertical_price": (CatalogFilter(vertical="indumentaria", price_min=900.0, price_max=1200.0), f"lower(coalesce(nullif(vertical, ''), 'indumentaria')) = 'indumentaria' AND {UNIT} >= 900 AND {UNIT} <= 1200"),
    "gym_packs": (CatalogFilter(gym=True, packs=True, segment=" "), "gym AND units > 1"),
    "category": (CatalogFilter(categories=("ECONOMY", "standard anodized tin foo")), "category IS NOT NULL AND (lower(category) IN ('economy', 'standard anodized tin foo') OR starts_with(lower(category), 'economy ') OR starts_with(lower(category), 'standard anodized tin foo ') OR starts_with('economy', lower(category) || ' ') OR starts_with('standard anodized tin foo', lower(category) || ' '))"),
    "visual_text": (CatalogFilter(fit="slim", print="liso", sub_categories=("running", "invierno"), text="A"), "lower(fit) = 'slim' AND lower(print) = 'liso' AND lower(coalesce(sub_category, '')) IN ('running', 'invierno') AND contains(lower(coalesce(name, '')), 'a')"),
    "wildcard_text": (CatalogFilter(text="%"), "contains(lower(coalesce(name, '')), '%')"),
}


def _filter_query(f: CatalogFilter):
    return lambda spark, sf_dir: search.matching(catalog(spark, sf_dir), f).select("url", "name", "price")


for _name, (_filter, _where) in FILTERS.items():
    QUERIES[f"filter_{_name}"] = _filter_query(_filter)
    ORACLES[f"filter_{_name}"] = f"WITH {CATALOG_SQL} SELECT url, name, price FROM catalog WHERE active AND {_where}"

ORDERS = {
    "price_asc": "price, url",
    "price_desc": "price DESC, url",
    "name_asc": "lower(coalesce(name, '')), url",
    "score": "score DESC, url",
    "discount": "(original_price - price) / nullif(original_price, 0) * 100 DESC NULLS LAST, url",
}


def _order_query(order: str):
    return lambda spark, sf_dir: search.search(catalog(spark, sf_dir), CatalogFilter(), order, 2, 25).select("place", "url", "price")


for _order, _by in ORDERS.items():
    QUERIES[f"page_{_order}"] = _order_query(_order)
    ORACLES[f"page_{_order}"] = f"WITH {CATALOG_SQL} SELECT place, url, price FROM (SELECT *, CAST(row_number() OVER (ORDER BY {_by}) AS INT) AS place FROM catalog WHERE active) WHERE place BETWEEN 26 AND 50"

FLAGSHIP = CatalogFilter(segment="standard", price_min=900.0, gender="hombre")


@register(
    "catalog_search",
    f"WITH {CATALOG_SQL}, hit AS (SELECT * FROM catalog WHERE active AND lower(coalesce(nullif(segment, ''), 'standard')) = 'standard' AND {UNIT} >= 900 AND lower(coalesce(gender, '')) = 'hombre')"
    f" SELECT CAST(row_number() OVER (ORDER BY price, url) AS INT) AS place, (SELECT count(*) FROM hit) AS total, substr(md5(url), 1, 16) AS product_key, url, name, price, round({UNIT}, 4) AS unit_price, {IMAGE} AS image, round((original_price - price) / nullif(original_price, 0) * 100, 4) AS discount_pct FROM hit ORDER BY price, url LIMIT 48",
)
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: one enriched page and the total. The total is one row; the page is cut before it is enriched."""
    rows = catalog(spark, sf_dir)
    page = search.search(rows, FLAGSHIP, "price_asc", 1, 48)
    return page.crossJoin(search.count(rows, FLAGSHIP)).select(
        "place",
        "total",
        text.product_key(F.col("url")).alias("product_key"),
        "url",
        "name",
        "price",
        F.round(unit_price(F.col("price"), F.col("units")), 4).alias("unit_price"),
        text.image_url(F.col("image")).alias("image"),
        F.round(discount_pct(F.col("price"), F.col("original_price")), 4).alias("discount_pct"),
    )


_SIZE_SORT = "CASE WHEN list_position(['XS','S','M','L','XL','XXL','XXXL','3XL','4XL'], upper(key)) > 0 THEN 0 WHEN regexp_full_match(key, '[0-9]+([.][0-9]+)?') THEN 1 ELSE 2 END, CASE WHEN list_position(['XS','S','M','L','XL','XXL','XXXL','3XL','4XL'], upper(key)) > 0 THEN list_position(['XS','S','M','L','XL','XXL','XXXL','3XL','4XL'], upper(key)) ELSE coalesce(try_cast(key AS DOUBLE), 0) END, lower(key)"
_FACET_UNION = " UNION ALL ".join(
    [
        "SELECT 'gender' AS facet, lower(trim(gender)) AS key FROM a",
        "SELECT 'category', upper(left(trim(category), 1)) || lower(substr(trim(category), 2)) FROM a",
        "SELECT 'brand', trim(brand) FROM a",
        "SELECT 'sub_category', trim(sub_category) FROM a",
        "SELECT 'size', trim(unnest(sizes)) FROM a",
        "SELECT 'badge', trim(unnest(badges)) FROM a",
        *[f"SELECT '{x}', trim({x}) FROM a" for x in search.VISUAL],
    ]
)


@register(
    "facets",
    f"WITH {CATALOG_SQL}, a AS (SELECT * FROM catalog WHERE active), n AS (SELECT facet, key, count(*) AS n FROM ({_FACET_UNION}) WHERE coalesce(key, '') <> '' GROUP BY facet, key),"
    f" p AS (SELECT *, CASE WHEN facet = 'size' THEN row_number() OVER (PARTITION BY facet ORDER BY {_SIZE_SORT}, key) WHEN facet = 'sub_category' THEN row_number() OVER (PARTITION BY facet ORDER BY key) ELSE row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) END AS place FROM n)"
    " SELECT facet, key, n, CAST(place AS INT) AS place FROM p WHERE facet <> 'brand' OR place <= 30",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(catalog(spark, sf_dir))


@register("summary", f"WITH {CATALOG_SQL} SELECT min(price) AS price_min, max(price) AS price_max, count(*) AS total, count(*) FILTER (WHERE gym) AS n_gym, count(*) FILTER (WHERE units > 1) AS n_packs FROM catalog WHERE active")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(catalog(spark, sf_dir))


@register("counts_by", f"WITH {CATALOG_SQL} SELECT 'site' AS kind, site AS key, count(*) AS n FROM catalog WHERE active GROUP BY site UNION ALL SELECT 'vertical', coalesce(nullif(trim(vertical), ''), 'indumentaria'), count(*) FROM catalog WHERE active GROUP BY 2")
def counts_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts_by(catalog(spark, sf_dir))


@register("point_lookup", f"WITH {CATALOG_SQL} SELECT url, name, price FROM catalog WHERE substr(md5(url), 1, 16) = substr(md5('p7'), 1, 16)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return search.by_key(catalog(spark, sf_dir), hashlib.md5(b"p7").hexdigest()[:16]).select("url", "name", "price")


@register("full_scan", f"WITH {CATALOG_SQL} SELECT url, price, coalesce(nullif(segment, ''), 'standard') AS segment, coalesce(nullif(trim(vertical), ''), 'indumentaria') AS vertical, greatest(coalesce(units, 1), 1) AS units, array_to_string(sizes, '|') AS sizes FROM catalog WHERE active")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_scan(catalog(spark, sf_dir)).select("url", "price", "segment", "vertical", "units", F.array_join("sizes", "|").alias("sizes"))


@register("words_search", f"WITH {CATALOG_SQL} SELECT url, price FROM catalog WHERE active AND (contains(lower(name), 'a') OR contains(lower(coalesce(brand, '')), 'a')) ORDER BY price, url LIMIT 20")
def words_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.words_search(catalog(spark, sf_dir), "á").select("url", "price")


@register("first_of_each", f"WITH {CATALOG_SQL} SELECT url, price FROM (SELECT *, row_number() OVER (PARTITION BY site || '|' || lower(trim(name)) ORDER BY seq) AS k FROM catalog WHERE price > 0) WHERE k = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_of_each(search.valid(catalog(spark, sf_dir))).select("url", "price")


@register(
    "csv_rows",
    f"WITH {CATALOG_SQL} SELECT url, site, name, CAST(floor(price) AS BIGINT) AS price, array_to_string(sizes, '|') AS sizes FROM catalog WHERE active",
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mercato.sources.sinks import csv_rows as rows

    return rows(catalog(spark, sf_dir)).select("url", "site", "name", "price", "sizes")


@register(
    "brands",
    f"""WITH {CATALOG_SQL}, r AS (SELECT * REPLACE (trim(brand) AS brand) FROM catalog WHERE trim(coalesce(brand, '')) <> ''),
    b AS (SELECT brand, count(*) AS n, list_sort(list(price))[count(*) // 2 + 1] AS median, min(price) AS low, max(price) AS high FROM r GROUP BY brand HAVING count(*) >= 2),
    c AS (SELECT brand, category, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, category) AS k FROM r WHERE category IS NOT NULL GROUP BY brand, category),
    t AS (SELECT brand, string_agg(category, ', ' ORDER BY k) AS top_categories FROM c WHERE k <= 3 GROUP BY brand),
    p AS (SELECT brand, url AS best_url, {IMAGE} AS best_image, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN image IS NULL THEN 1 ELSE 0 END, CASE WHEN image IS NOT NULL THEN CASE WHEN score > 0 THEN score ELSE 999 END END, price, url) AS k FROM r)
    SELECT b.*, top_categories, best_url, best_image FROM b LEFT JOIN t USING (brand) JOIN p USING (brand) WHERE k = 1 ORDER BY n DESC, brand LIMIT 100""",
)
def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.brands(catalog(spark, sf_dir))


@register(
    "best_of_category",
    f"""WITH {CATALOG_SQL}, r AS (SELECT *, CASE WHEN image IS NOT NULL THEN 1 ELSE 0 END AS pic, CASE WHEN score > 0 THEN score ELSE 999 END AS rs, coalesce(segment, 'standard') AS sg FROM catalog WHERE category IS NOT NULL AND lower(coalesce(gender, '')) <> 'infantil'),
    l AS (SELECT category, count(*) AS n FROM r GROUP BY category ORDER BY n DESC, category LIMIT 40),
    v AS (SELECT r.*, l.n, row_number() OVER (PARTITION BY category ORDER BY 1 - pic, CASE WHEN pic = 1 THEN rs END, price, url) AS vp FROM r JOIN l USING (category)),
    f AS (SELECT *, vp = 1 AS f0,
      (sg IN ('premium', 'standard') AND score BETWEEN 30 AND 65 AND pic = 1) AS t1, list_contains(badges, 'all_time_low') AS t2, list_contains(badges, 'verified_deal') AS t3 FROM v),
    g AS (SELECT *, t1 AND row_number() OVER (PARTITION BY category, t1 ORDER BY price, url) = 1 AS f1, t2 AND row_number() OVER (PARTITION BY category, t2 ORDER BY price, url) = 1 AS f2, t3 AND row_number() OVER (PARTITION BY category, t3 ORDER BY price, url) = 1 AS f3 FROM f),
    h AS (SELECT *, CASE WHEN f0 THEN 'valor' WHEN f1 THEN 'premium' WHEN f2 THEN 'histLow' WHEN f3 THEN 'oferta' WHEN pic = 1 THEN 'top' END AS label, CASE WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 WHEN f3 THEN 3 ELSE 4 END AS rk FROM g),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY rk, vp) AS INT) AS place FROM h WHERE label IS NOT NULL)
    SELECT category, n, place, label, url, price FROM o WHERE place <= 10""",
)
def best_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_of_category(catalog(spark, sf_dir))


@register("category_medians", f"WITH {CATALOG_SQL} SELECT category, count(*) AS n, round(list_sort(list({UNIT}))[count(*) // 2 + 1], 4) AS median FROM catalog WHERE category IS NOT NULL GROUP BY category")
def category_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.category_medians(catalog(spark, sf_dir)).withColumn("median", F.round("median", 4))


_MODEL = "model AS (SELECT coalesce(c.brand, '') AS brand, coalesce(c.category, '') AS category, count(*) FILTER (WHERE kind = 'like') AS likes, arg_max(kind, event_id) = 'dislike' AS vetoed FROM feedback f JOIN catalog c USING (url) WHERE kind IN ('like', 'dislike') GROUP BY 1, 2)"


@register("feedback_model", f"WITH {CATALOG_SQL}, {FEEDBACK_SQL}, {_MODEL} SELECT * FROM model")
def feedback_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.feedback_model(feedback(spark, sf_dir), catalog(spark, sf_dir))


_OPPORTUNITY = "100 - score + CASE WHEN deal THEN 25 ELSE 0 END + CASE WHEN list_contains(badges, 'verified_deal') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'all_time_low') THEN 15 ELSE 0 END + CASE WHEN list_contains(badges, 'below_market') THEN 10 ELSE 0 END + CASE WHEN coalesce(nullif(trim(trend), ''), 'estable') <> 'estable' THEN 8 ELSE 0 END"


@register(
    "recommend",
    f"WITH {CATALOG_SQL}, {FEEDBACK_SQL}, {_MODEL} SELECT c.url, round(({_OPPORTUNITY}) * least(1 + least(coalesce(likes, 0), 5) * 0.15e0, 1.75e0), 4) AS final FROM catalog c LEFT JOIN model m ON coalesce(c.brand, '') = m.brand AND coalesce(c.category, '') = m.category WHERE lower(coalesce(gender, '')) <> 'infantil' AND NOT coalesce(vetoed, false)",
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    found = ranking.recommend(rows, ranking.feedback_model(feedback(spark, sf_dir), rows))
    return found.select("url", F.round("final", 4).alias("final"))


@register(
    "broaden_gender",
    f"WITH {CATALOG_SQL}, g AS (SELECT url, category, lower(trim(coalesce(gender, ''))) AS g FROM catalog), f AS (SELECT *, max(CASE WHEN g IN ('', 'unisex', 'mujer') THEN 1 ELSE 0 END) OVER (PARTITION BY coalesce(category, '')) AS af, max(CASE WHEN g = 'unisex' THEN 1 ELSE 0 END) OVER (PARTITION BY coalesce(category, '')) AS au FROM g) SELECT url FROM f WHERE CASE WHEN af = 1 THEN g IN ('', 'unisex', 'mujer') WHEN au = 1 THEN g = 'unisex' ELSE true END",
)
def broaden_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.broaden_gender(catalog(spark, sf_dir), "mujer").select("url")


@register(
    "yield_alerts",
    f"WITH {CATALOG_SQL}, b AS (SELECT site, count(*) AS n FROM catalog GROUP BY site), a AS (SELECT site, count(*) AS n FROM catalog WHERE seq % 3 = 0 AND site <> 'Site 2' GROUP BY site) SELECT b.site, b.n AS n_before, coalesce(a.n, 0) AS n_now, CASE WHEN coalesce(a.n, 0) = 0 THEN 'total' ELSE 'partial' END AS alert FROM b LEFT JOIN a USING (site) WHERE b.n >= 20 AND coalesce(a.n, 0) < b.n * 0.5",
)
def yield_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir)
    count = lambda x: x.groupBy("site").agg(F.count("*").alias("n"))
    return ranking.yield_alerts(count(rows), count(rows.where("seq % 3 = 0 and site <> 'Site 2'")))


@register("extraction", f"WITH {CATALOG_SQL} SELECT site, count(*) AS total, count(*) FILTER (WHERE seq % 5 > 0 AND price > 0) AS valid, count(*) FILTER (WHERE NOT (seq % 5 > 0 AND price > 0)) AS misses FROM catalog GROUP BY site")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.extraction(catalog(spark, sf_dir).withColumn("name", F.when(F.col("seq") % 5 > 0, F.lit("x"))))


@register(
    "text_keys",
    f"WITH {CATALOG_SQL} SELECT url, regexp_replace(lower(site), '[^a-z0-9]', '', 'g') AS site_key, substr(md5(url), 1, 16) AS product_key, {IMAGE} AS image FROM catalog",
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("url", text.site_key(F.col("site")).alias("site_key"), text.product_key(F.col("url")).alias("product_key"), text.image_url(F.col("image")).alias("image"))
