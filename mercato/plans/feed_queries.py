"""Registered queries of the feed readers: shop payloads made from the part table, parsed back, beside SQL over that table.

Shops are the remainders of the part's key; a page holds ten places of a shop, so that the first page
of shop 0 is a short one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import shared_folder
from mercato.sources import feeds, sinks
from mercato.sources.feed_store import FeedStore

QUERIES: dict = {}
ORACLES: dict = {}

PLACES = [
    "p_partkey AS k",
    "p_name AS name",
    "p_type AS type",
    "p_retailprice AS price",
    "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END AS high",
    "'shop' || (p_partkey % 40) AS site",
    "'https://shop' || (p_partkey % 40) || '.example' AS base_url",
    "CAST(floor(floor(p_partkey / 40) / 10) AS INT) + 1 AS page",
]
PLACES_SQL = f"places AS (SELECT {', '.join(PLACES)} FROM part)"


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*PLACES)


def _pages(spark: SparkSession, sf_dir: str, item: str, payload: str) -> DataFrame:
    """Payloads: ``payload`` is SQL over ``items``, the page's values of the SQL expression ``item`` in order."""
    rows = _places(spark, sf_dir).selectExpr("site", "base_url", "page", "k", f"{item} AS item")
    rows = rows.groupBy("site", "base_url", "page").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("rows"))
    return rows.selectExpr("*", "transform(rows, r -> r.item) AS items").selectExpr("site", "base_url", "page", f"{payload} AS payload")


_OUT = ["site", "url", "name", "price", "original_price", "category"]


def _sql(url: str, category: str = "type", price: str = "price", high: str = "high", where: str = "true", name: str = "name") -> str:
    return f"WITH {PLACES_SQL} SELECT site, {url} AS url, {name} AS name, {price} AS price, {high} AS original_price, {category} AS category FROM places WHERE {where}"


@register(
    "feed_shopify",
    _sql("base_url || '/products/h' || k", where="page <= 20 AND NOT EXISTS (SELECT 1 FROM (SELECT site AS s, page AS p FROM places GROUP BY ALL HAVING count(*) < 10) short WHERE s = places.site AND p < places.page)"),
)
def feed_shopify(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('title', name, 'handle', 'h' || k, 'product_type', type, 'variants', array(named_struct('price', CAST(price AS STRING), 'compare_at_price', CAST(high AS STRING), 'option1', 'M')))"
    return feeds.shopify(_pages(spark, sf_dir, item, "to_json(named_struct('products', items))"), per_page=10).select(*_OUT)


@register(
    "feed_gender",
    f"WITH {PLACES_SQL} SELECT 'https://s/products/h' || k AS url, CASE WHEN k % 8 IN (2, 3, 5, 6) THEN 'unisex' WHEN k % 8 IN (0, 7) THEN 'hombre' WHEN k % 8 = 1 THEN 'mujer' ELSE '' END AS gender FROM places",
)
def feed_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = "CASE k % 8 WHEN 0 THEN array('Hombre') WHEN 1 THEN array('x', 'DAMAS') WHEN 2 THEN array('hombre', 'mujer') WHEN 3 THEN array('Women') WHEN 5 THEN array('hombre', 'neutro') WHEN 7 THEN array('varones') ELSE array('x') END"
    item = f"named_struct('title', 'Item ' || k, 'handle', 'h' || k, 'product_type', CASE WHEN k % 8 = 6 THEN 'Unisex' ELSE 'x' END, 'tags', {tags}, 'variants', array(named_struct('price', CAST(price AS STRING))))"
    pages = _places(spark, sf_dir).selectExpr("CAST(k AS STRING) AS site", "'https://s' AS base_url", "1 AS page", f"to_json(named_struct('products', array({item}))) AS payload")
    return feeds.shopify(pages).select("url", "gender")


@register("feed_vtex", _sql("base_url || '/t' || k || '/p'"))
def feed_vtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = "array(named_struct('commertialOffer', named_struct('Price', 0D, 'ListPrice', 9D)), named_struct('commertialOffer', named_struct('Price', price, 'ListPrice', coalesce(high, price))))"
    item = f"named_struct('productName', name, 'linkText', 't' || k, 'categories', array('/x/', '/x/' || type || '/'), 'items', array(named_struct('sellers', {offers})))"
    return feeds.vtex(_pages(spark, sf_dir, item, "to_json(items)")).select(*_OUT)


@register("feed_tiendanube", _sql("base_url || '/n' || k"))
def feed_tiendanube(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('name', name, 'canonical_url', base_url || '/n' || k, 'categories', array(named_struct('name', type)), 'variants', array(named_struct('price', CAST(price AS STRING), 'compare_at_price', CAST(high AS STRING), 'values', array('unique'))))"
    return feeds.tiendanube(_pages(spark, sf_dir, item, "to_json(items)")).select(*_OUT)


@register("feed_rpc_store", _sql("base_url || '/d' || k || '/' || k", "'Cat ' || page", where="page <= 30"))
def feed_rpc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('item_id', CAST(k AS INT), 'item_desc', name, 'item_desc4link', 'd' || k, 'prli_price', CAST(price AS STRING), 'strikeThroughPrice_original', high)"
    inner = "to_json(named_struct('scName', 'Cat ' || page, 'data', named_struct('page', page, 'items', items)))"
    return feeds.rpc_store(_pages(spark, sf_dir, item, f"to_json(named_struct('d', {inner}))")).select(*_OUT)


@register("feed_product_cards", _sql("base_url || '/c' || k", high="CAST(NULL AS DOUBLE)"))
def feed_product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = "replace(to_json(named_struct('id', CAST(k AS STRING), 'name', name, 'category', type, 'price', price)), '\"', '&quot;')"
    item = f"""'<div class="product-box"><a href="/c' || k || '" onclick="enhancedClick(' || {data} || ')"><img src="i.png"></a></div>'"""
    return feeds.product_cards(_pages(spark, sf_dir, item, "array_join(items, '')")).select(*_OUT)


@register("feed_plugin_cards", _sql("base_url || '/w' || k", "CAST(NULL AS VARCHAR)", "floor(price)", "floor(high)"))
def feed_plugin_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = "coalesce('<del><bdi>$' || CAST(floor(high) AS STRING) || ',00</bdi></del>', '')"
    item = f"""'<li class="product x"><a href="' || base_url || '/w' || k || '"><h2 class="t">' || name || '</h2></a>' || {struck} || '<ins><bdi>$' || CAST(floor(price) AS STRING) || ',00</bdi></ins></li>'"""
    return feeds.plugin_cards(_pages(spark, sf_dir, item, "'<ul>' || array_join(items, '') || '</ul>'")).select(*_OUT)


@register("feed_state_pages", _sql("base_url || '/s' || k"))
def feed_state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('name', name, 'slug', 's' || k, 'category', type, 'price', price, 'listPrice', high, 'image', named_struct('url', 'i' || k))"
    state = "to_json(named_struct('props', named_struct('name', 'page', 'list', named_struct('products', items))))"
    return feeds.state_pages(_pages(spark, sf_dir, item, f"""'<html><script id="__NEXT_DATA__" type="application/json">' || {state} || '</script></html>'""")).select(*_OUT)


@register("feed_commerce_cards", _sql("'/e' || k", "CAST(NULL AS VARCHAR)", high="floor(high)"))
def feed_commerce_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = """coalesce('<h6 class="tachado_1">$' || CAST(floor(high) AS STRING) || '</h6>', '')"""
    item = f"""'<div class="card card-ecommerce"><img src="/i.png"><h5 class="card-title x"><a href="/e' || k || '">' || name || '</a></h5>' || {struck} || '<b data-precio="' || price || '"></b></div>'"""
    return feeds.commerce_cards(_pages(spark, sf_dir, item, "array_join(items, '')")).select(*_OUT)


@register(
    "feed_three_tables",
    f"WITH {PLACES_SQL} SELECT 's' AS site, 'https://s/producto/item-' || k || '_' || k AS url, 'Item ' || k AS name, price, high AS original_price, CASE WHEN k % 7 = 0 THEN 'Cat ' || (k % 5) ELSE 'Sub ' || (k % 7) END AS category, 'Brand ' || (k % 25) AS brand, 'a' || k AS image FROM places WHERE k % 4 <> 0 AND k % 9 <> 0",
)
def feed_three_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _places(spark, sf_dir).selectExpr(
        "k AS id_producto", "'Item ' || k AS nombre", "k % 5 AS id_categoria", "100 + k % 7 AS id_subcategoria", "k % 25 AS id_marca", "coalesce(high, price) AS precioLista",
        "CASE WHEN high IS NULL THEN 0D ELSE price END AS precioEspecial", "CAST(NULL AS DOUBLE) AS precioListaAnterior", "array(named_struct('nombre', 'b' || k, 'orden', 2), named_struct('nombre', 'a' || k, 'orden', 1)) AS imagenes", "CAST(k % 4 AS INT) AS stock", "k % 9 <> 0 AS vendible",
    )
    cats = spark.range(5).selectExpr("id", "'Cat ' || id AS nombre").union(spark.range(1, 7).selectExpr("100 + id", "'Sub ' || id"))
    return feeds.three_feeds(products, cats, spark.range(25).selectExpr("id", "'Brand ' || id AS nombre"), "s", "https://s")


@register("feed_index_series", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS day, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def feed_index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.count("*").alias("n"))
    texts = months.groupBy(F.year("day")).agg(F.collect_list(F.array(F.col("day").cast("string"), F.col("n").cast("string"))).alias("data")).select(F.to_json(F.struct("data")).alias("payload"))
    return feeds.index_series(texts).select(F.col("day").cast("string").alias("day"), "value")


@register("feed_index_fallback", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS day, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def feed_index_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point in the first source, so that the second one counts, which has the other form."""
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(F.count("*").alias("n"))
    point = F.struct(F.col("day").cast("string").alias("fecha"), F.col("n").alias("valor"))
    second = months.groupBy(F.year("day")).agg(F.to_json(F.collect_list(point)).alias("payload"))
    first = spark.range(1).selectExpr("""'{"data": [["1990-01-01", "7"], ["x", "8"]]}' AS payload""")
    return feeds.index_series(first, second).select(F.col("day").cast("string").alias("day"), "value")


@register(
    "feed_market_search",
    f"WITH {PLACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY site, page ORDER BY k) AS i FROM places WHERE k % 6 <> 0) SELECT site || '/' || page AS url, name AS title, price, 'm' || k AS link, 'new' AS condition FROM r WHERE i <= 8",
)
def feed_market_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('title', name, 'price', CASE WHEN k % 6 = 0 THEN 0D ELSE price END, 'permalink', 'm' || k, 'condition', 'new')"
    pages = _pages(spark, sf_dir, item, "to_json(named_struct('results', items))")
    return feeds.market_search(pages.selectExpr("site || '/' || page AS url", "payload"))


_HOSTS = "CASE k % 4 WHEN 0 THEN 'https://a.myshopify.com' WHEN 1 THEN 'https://b.vtex.com' WHEN 2 THEN 'https://c/wp-content' ELSE 'https://d' END"


@register(
    "site_platform",
    f"WITH {PLACES_SQL} SELECT k, 'Shop-' || k AS site, CASE WHEN k % 6 = 0 THEN 'own' ELSE CASE k % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'vtex' WHEN 2 THEN 'woocommerce' ELSE 'tiendanube' END END AS platform FROM places",
)
def site_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir).selectExpr("k", "'Shop-' || k AS site", f"{_HOSTS} AS url")
    lookup = rows.where("k % 3 = 0").selectExpr("'shop' || k AS site_key", "CASE WHEN k % 6 = 0 THEN 'own' ELSE '' END AS platform")
    found = feeds.platform(rows, lookup)
    return found.select(F.regexp_extract("site", r"(\d+)", 1).cast("long").alias("k"), "site", "platform")


@register("feed_price_range", f"WITH {PLACES_SQL} SELECT k, price FROM places WHERE price BETWEEN 920 AND 960")
def feed_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.in_range(_places(spark, sf_dir).select("k", "price"), 920.0, 960.0)


@register(
    "payload_retention",
    f"WITH {PLACES_SQL}, p AS (SELECT k AS id FROM places WHERE k % 3 <> 0) SELECT id FROM p ORDER BY id DESC LIMIT 10",
)
def payload_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = """'{"scores":{"a":1},"tendencias":{}}'"""
    rows = _places(spark, sf_dir).selectExpr("k AS id", f"CASE WHEN k % 3 = 0 THEN 'junk' ELSE {good} END AS payload")
    return sinks.retain(rows.where("id % 3 = 1"), rows.where("id % 3 <> 1"), 10).select("id")


_STORED = "site IN ('shop1', 'shop3', 'shop8') AND price BETWEEN 905 AND 990"


@register("feed_stored_range", _sql("base_url || '/t' || k || '/p'", where=_STORED))
def feed_stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed products of all sites stored once, then read for some sites and a price range."""
    item = "named_struct('productName', name, 'linkText', 't' || k, 'categories', array('/x/' || type || '/'), 'items', array(named_struct('sellers', array(named_struct('commertialOffer', named_struct('Price', price, 'ListPrice', coalesce(high, price)))))))"
    store = FeedStore(spark, f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}")
    store.put(feeds.vtex(_pages(spark, sf_dir, item, "to_json(items)")))
    return store.read(["shop1", "shop3", "shop8"], 905.0, 990.0).select(*_OUT)
