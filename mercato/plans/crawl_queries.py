"""Registered queries of discovery and crawling, over shops whose pages are made from the part table, beside their SQL.

A shop has a flat category and two with leaves; its start page links twice to a category, to a denied
page and back to itself. Behind its last page a leaf shows that page again and then a ghost, which no reader may find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources import crawl, feeds, paging

QUERIES: dict = {}
ORACLES: dict = {}

#: Order of the categories on a shop's pages.
TREE = ["audio-video/parlantes", "audio-video/auriculares", "audio-video/tv", "notebooks", "perifericos/mouse", "perifericos/teclados"]
_LEAF = """CASE k % 3 WHEN 0 THEN 'notebooks' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'perifericos/mouse' ELSE 'perifericos/teclados' END
    ELSE CASE CAST(floor(k / 3) AS INT) % 3 WHEN 0 THEN 'audio-video/parlantes' WHEN 1 THEN 'audio-video/auriculares' ELSE 'audio-video/tv' END END"""
SHOPS = "SELECT p_partkey AS id, p_partkey % 20 AS shop, CAST(floor(p_partkey / 20) AS INT) AS k, p_name AS name, p_retailprice AS price FROM part"
ITEMS = f"""shops AS ({SHOPS}), owned AS (SELECT id, shop, {_LEAF} AS leaf, name, price FROM shops UNION ALL SELECT id, shop, 'perifericos/mouse', name, price FROM shops WHERE k % 10 = 0 AND k % 6 <> 4),
    placed AS (SELECT *, row_number() OVER (PARTITION BY shop, leaf ORDER BY id) AS r FROM owned),
    paged AS (SELECT *, CAST(floor((r - 1) / 4) AS INT) + 1 AS page FROM placed),
    ends AS (SELECT shop, leaf, max(page) AS n FROM paged GROUP BY shop, leaf),
    items AS (SELECT shop, leaf, page, r, id, name, price FROM paged UNION ALL SELECT p.shop, p.leaf, n + 1, r, id, name, price FROM paged p JOIN ends e ON p.shop = e.shop AND p.leaf = e.leaf AND p.page = n
        UNION ALL SELECT shop, leaf, n + 2, 1, -shop, 'ghost', CAST(1 AS DOUBLE) FROM ends)"""


def register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def shop_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored pages and seeds."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = _sql(spark, part, f"WITH {ITEMS} SELECT * FROM items")
    base = F.concat(F.lit("https://shop"), F.col("shop").cast("string"), F.lit(".example"))
    link = lambda path: F.concat(F.lit('<a href="'), base, F.lit(f'/{path}"></a>'))
    card = F.format_string('<div class="product-box"><a href="/p/%d" onclick="enhancedClick({&quot;id&quot;:&quot;%d&quot;,&quot;name&quot;:&quot;%s&quot;,&quot;price&quot;:%s})"><img src="/i/%d.jpg"></a></div>', "id", "id", "name", F.col("price").cast("string"), "id")
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", card.alias("card")))), lambda x: x["card"]), "")
    url = F.concat(base, F.lit("/"), "leaf", F.when(F.col("page") > 1, F.concat(F.lit("?page="), F.col("page").cast("string"))).otherwise(F.lit("/")))
    listings = items.groupBy("shop", "leaf", "page").agg(cards.alias("payload")).select("shop", url.alias("url"), F.concat("payload", link("carrito"), link("notebooks"), link("audio-video/")).alias("payload"))
    shops = items.select("shop").distinct()
    tops = list(dict.fromkeys(t.split("/")[0] for t in TREE))
    start = shops.select("shop", F.concat(base, F.lit("/")).alias("url"), F.concat(link("carrito"), *map(link, tops), link(tops[0]), link("")).alias("payload"))
    inner = [shops.select("shop", F.concat(base, F.lit(f"/{t}")).alias("url"), F.concat(link(t), link("contacto/"), *(link(x + "/") for x in TREE if x.startswith(f"{t}/"))).alias("payload")) for t in tops if t not in TREE]
    pages = listings.unionByName(start)
    for x in inner:
        pages = pages.unionByName(x)
    site = F.concat(F.lit("shop"), F.col("shop").cast("string")).alias("site")
    return pages.select(site, "url", "payload"), shops.select(site, base.alias("base_url"))


def _sql(spark: SparkSession, part: DataFrame, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=part)


_ORDER = "CASE leaf " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(TREE)) + " END"
_URL = "'https://shop' || shop || '.example'"
_WORDS = "array_to_string(list_transform(string_split(split_part(leaf || '/' || leaf, '/', -1), '-'), lambda w: upper(w[1]) || w[2:]), ' ')"
_KEPT = f"""{ITEMS}, firsts AS (SELECT shop, leaf, id, min(page) AS page FROM items GROUP BY shop, leaf, id),
    new AS (SELECT DISTINCT shop, leaf, page FROM firsts), walk AS (
        SELECT shop, leaf, page FROM new WHERE page = 1 UNION ALL SELECT n.shop, n.leaf, n.page FROM walk w JOIN new n ON n.shop = w.shop AND n.leaf = w.leaf AND n.page = w.page + 1),
    kept AS (SELECT i.* FROM items i JOIN walk USING (shop, leaf, page))"""


@register(
    "crawl_products",
    f"""WITH RECURSIVE {_KEPT} SELECT 'shop' || shop AS site, {_URL} || '/p/' || id AS url, name, price, {_WORDS} AS category, {_URL} || '/' || leaf AS leaf_url, page
    FROM (SELECT *, row_number() OVER (PARTITION BY shop, id ORDER BY {_ORDER}, page) AS first FROM kept) WHERE first = 1""",
)
def crawl_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(*shop_pages(spark, sf_dir)).select("site", "url", "name", "price", "category", "leaf_url", "page")


@register(
    "crawl_tree",
    f"""WITH RECURSIVE shops AS ({SHOPS}), links(parent, child, place) AS (VALUES ('', 'carrito', 0), ('', 'audio-video', 1), ('', 'notebooks', 2), ('', 'perifericos', 3), ('', 'audio-video', 4),
        ('audio-video', 'audio-video/parlantes', 2), ('audio-video', 'audio-video/auriculares', 3), ('audio-video', 'audio-video/tv', 4), ('perifericos', 'perifericos/mouse', 2), ('perifericos', 'perifericos/teclados', 3), ('audio-video', 'audio-video', 0)),
    tree AS (SELECT '' AS path, 0 AS depth UNION SELECT child, depth + 1 FROM tree JOIN links ON path = parent WHERE child NOT IN ('carrito', 'contacto') AND child <> parent AND depth < 2),
    roots AS (SELECT DISTINCT shop FROM shops)
    SELECT DISTINCT 'shop' || shop AS site, {_URL} || '/' || path AS url, depth, NOT EXISTS (SELECT 1 FROM links WHERE parent = path AND child <> path) AS leaf FROM roots, tree WHERE depth > 0""",
)
def crawl_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.discover(*shop_pages(spark, sf_dir)).select("site", "url", F.size("slugs").alias("depth"), "leaf")


_PAGES = "SELECT p_partkey % 40 AS shop, CAST(floor(p_partkey / 40) AS INT) AS page, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey >= 40"
#: What page tells the last: nothing on every third, else a number that shrinks on some pages.
_TOLD = "CASE WHEN (page + shop) % 3 = 0 THEN NULL ELSE shop + 3 - CASE WHEN page > shop % 7 THEN page % 4 ELSE 0 END END"


@register(
    "feed_last_page",
    f"""WITH RECURSIVE pages AS (SELECT *, {_TOLD} AS told FROM ({_PAGES})), walk AS (
        SELECT shop, page, coalesce(told, 1) AS last FROM pages WHERE page = 1 UNION ALL
        SELECT p.shop, p.page, coalesce(p.told, w.last) FROM walk w JOIN pages p ON p.shop = w.shop AND p.page = w.page + 1 AND p.page <= w.last)
    SELECT 'shop' || shop AS site, name, price, page FROM walk JOIN pages USING (shop, page)""",
)
def feed_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages that tell their last page, read up to it."""
    pages = _sql(spark, spark.read.parquet(f"{sf_dir}/part.parquet"), f"SELECT *, {_TOLD} AS told FROM ({_PAGES})")
    product = F.struct(F.col("name").alias("productName"), F.concat(F.lit("t"), F.col("page").cast("string")).alias("linkText"), F.array(F.struct(F.array(F.struct(F.struct(F.col("price").alias("Price")).alias("commertialOffer"))).alias("sellers"))).alias("items"))
    told = F.when(F.col("told").isNotNull(), F.struct(F.struct(F.col("told").alias("index")).alias("last")))
    pages = pages.select(F.concat(F.lit("shop"), F.col("shop").cast("string")).alias("site"), F.lit("https://s").alias("base_url"), "page", F.to_json(F.struct(F.array(product).alias("products"), told.alias("pagination"))).alias("payload"))
    return feeds.vtex_search(pages).select("site", "name", "price", "page")


@register(
    "feed_next_links",
    f"""WITH RECURSIVE pages AS (SELECT *, (page * 7 + shop) % 11 <> 3 AS linked FROM ({_PAGES})), walk AS (
        SELECT shop, page, linked FROM pages WHERE page = 1 UNION ALL SELECT p.shop, p.page, p.linked FROM walk w JOIN pages p ON p.shop = w.shop AND p.page = w.page + 1 WHERE w.linked)
    SELECT 'shop' || shop AS site, page FROM walk""",
)
def feed_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages that are read while they link to a later one."""
    pages = _sql(spark, spark.read.parquet(f"{sf_dir}/part.parquet"), f"SELECT *, (page * 7 + shop) % 11 <> 3 AS linked FROM ({_PAGES})")
    forms = F.element_at(F.array(*map(F.lit, ["/c?page=", "/c?a=1&mpage=", "/c/p/", "/c/page/"])), (F.col("page") % 4 + 1).cast("int"))
    back = F.concat(F.lit('<a href="/c?page='), F.col("page").cast("string"), F.lit('">'))
    payload = F.concat(back, F.when(F.col("linked"), F.concat(F.lit('<a class="x" href="'), forms, (F.col("page") + 1).cast("string"), F.lit('/">'))).otherwise(""))
    pages = pages.select(F.concat(F.lit("shop"), F.col("shop").cast("string")).alias("site"), "page", payload.alias("payload"))
    return paging.until_unlinked(pages, ["site"]).select("site", "page")
