"""Shop feeds as DataFrames: JSON and HTML payloads in, product rows out.

A payload table has ``site, base_url, page, payload``; all readers return ``site, url, name, price,
original_price, category, sizes, image``. Fetching is outside: payloads come from files.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from mercato.functions.prices import listing_price, local_price, shop_price, tech_price
from mercato.functions.text import slug
from mercato.sources.paging import until_last

OUTPUT = ["site", "url", "name", "price", "original_price", "category", "sizes", "image"]
SHOPIFY = "products array<struct<title:string,handle:string,product_type:string,tags:string,images:array<struct<src:string>>,options:array<struct<name:string,values:array<string>>>,variants:array<struct<price:string,compare_at_price:string,option1:string>>>>"
VTEX = "array<struct<productName:string,linkText:string,categories:array<string>,items:array<struct<images:array<struct<imageUrl:string>>,sellers:array<struct<commertialOffer:struct<Price:double,ListPrice:double>>>>>>>"
TIENDANUBE = "array<struct<name:string,canonical_url:string,categories:array<struct<name:string>>,images:array<struct<src:string>>,variants:array<struct<price:string,compare_at_price:string,values:array<string>>>>>"
RPC = "scName string, data struct<page:int,pagesTotal:int,items:array<struct<item_id:int,item_desc:string,item_desc4link:string,prli_price:string,strikeThroughPrice_original:double>>>"
LINKS, AMOUNTS = ("url", "link", "slug"), ("price", "salePrice")
# Parts of a type, title or tag that name a gender.
FOR_MEN = "hombre hombres masculino masculina men man male caballero varones".split()
FOR_WOMEN = "mujer mujeres femenino femenina women woman female dama damas".split()
FOR_ALL = "unisex unisexo neutro".split()
CARD = "id string, name string, category string, brand string, price double"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder as payloads; the site is the folder's name, the page the file's number."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("file"))
    return files.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("site"),
        F.concat(F.lit("https://"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).alias("base_url"),
        F.coalesce(F.regexp_extract("file", r"(\d+)\.[a-z]+$", 1).try_cast("int"), F.lit(1)).alias("page"),
        F.col("value").alias("payload"),
    )


def in_range(rows: DataFrame, low: float = 0.0, high: float = 1e12) -> DataFrame:
    return rows.where(F.col("price").between(low, high))


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def told_gender(*texts: Column) -> Column:
    """Gender that the parts of texts name anywhere: unisex before all and for both, blank for none."""
    text = F.lower(F.concat_ws("\n", *texts))
    names = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    men, women = names(FOR_MEN), names(FOR_WOMEN)
    return F.when(names(FOR_ALL) | (men & women), "unisex").when(men, "hombre").when(women, "mujer").otherwise("")


def _done(rows: DataFrame, *more: str) -> DataFrame:
    """Products with name, URL and price; each URL of a site once, from its first page."""
    order = Window.partitionBy("site", "url").orderBy("page", "place")
    good = rows.where("coalesce(name, '') <> '' and coalesce(url, '') <> '' and price > 0")
    return good.withColumn("k", F.row_number().over(order)).where("k = 1").select(*OUTPUT, *more)


def shopify(pages: DataFrame, per_page: int = 250, most_pages: int = 20) -> DataFrame:
    """``products.json`` pages up to and including the first short one; the first variant has the price. Adds gender, from type, title and tags."""
    parsed = pages.where(F.col("page") <= most_pages).select("site", "base_url", "page", F.from_json("payload", SHOPIFY).products.alias("products"))
    before = Window.partitionBy("site").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    parsed = parsed.withColumn("ended", F.coalesce(F.max(F.coalesce(F.size("products"), F.lit(0)) < per_page).over(before), F.lit(False))).where("not ended")
    rows = parsed.select("site", "base_url", "page", F.posexplode("products").alias("place", "p"))
    sized = F.filter("p.options", lambda o: F.lower(o["name"]).isin("talle", "size", "talla"))
    option1 = F.filter(F.array_distinct(F.transform("p.variants", lambda v: v["option1"])), lambda x: F.lower(x) != "default title")
    sizes = F.when(F.size(sized) > 0, option1).otherwise(F.coalesce(_first(F.col("p.options"))["values"], F.array().cast("array<string>")))
    variant = _first(F.col("p.variants"))
    return _done(
        rows.select("site", "page", "place", F.concat("base_url", F.lit("/products/"), "p.handle").alias("url"), F.col("p.title").alias("name"), local_price(variant["price"]).alias("price"), local_price(variant["compare_at_price"]).alias("original_price"), F.col("p.product_type").alias("category"), sizes.alias("sizes"), _first(F.col("p.images"))["src"].alias("image"), told_gender(F.col("p.product_type"), F.col("p.title"), F.col("p.tags")).alias("gender")),
        "gender",
    )


def vtex(pages: DataFrame) -> DataFrame:
    """Search API pages: the first offer with a price, the list price if it is higher, the last category of the path."""
    rows = pages.select("site", "base_url", "page", F.posexplode(F.from_json("payload", VTEX)).alias("place", "p"))
    offers = F.filter(F.flatten(F.transform("p.items", lambda i: F.transform(i["sellers"], lambda s: s["commertialOffer"]))), lambda o: o["Price"] > 0)
    price, listed = _first(offers)["Price"], _first(offers)["ListPrice"]
    parts = F.filter(F.split(F.try_element_at("p.categories", F.lit(-1)), "/"), lambda x: F.trim(x) != "")
    return _done(
        rows.select("site", "page", "place", F.concat("base_url", F.lit("/"), "p.linkText", F.lit("/p")).alias("url"), F.col("p.productName").alias("name"), price.alias("price"), F.when(listed > price, listed).alias("original_price"), F.try_element_at(parts, F.lit(-1)).alias("category"), F.array().cast("array<string>").alias("sizes"), _first(_first(F.col("p.items"))["images"])["imageUrl"].alias("image"))
    )


def vtex_search(pages: DataFrame) -> DataFrame:
    """Search pages of the newer form, {"products": [...], "pagination": {"last": {"index": n}}}, up to the last page that they tell.

    Products are those of ``vtex``; page is the one that shows them first.
    """
    told = F.get_json_object("payload", "$.pagination.last.index").try_cast("int")
    read = until_last(pages.where(F.get_json_object("payload", "$.products[0]").isNotNull()), told, ["site"])
    key = F.to_json(F.struct("site", "page"))
    rows = vtex(read.select(key.alias("site"), "base_url", "page", F.get_json_object("payload", "$.products").alias("payload")))
    rows = rows.withColumn("told", F.from_json("site", "site string, page int")).withColumns({"site": F.col("told.site"), "page": F.col("told.page")})
    first = Window.partitionBy("site", "url").orderBy("page")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select(*OUTPUT, "page")


def tiendanube(pages: DataFrame) -> DataFrame:
    """Store API pages: first variant's price, first category, first values of the variants as sizes unless unique."""
    rows = pages.select("site", "base_url", "page", F.posexplode(F.from_json("payload", TIENDANUBE)).alias("place", "p"))
    variant = _first(F.col("p.variants"))
    sizes = F.filter(F.array_distinct(F.transform("p.variants", lambda v: _first(v["values"]))), lambda x: F.lower(x) != "unique")
    image = F.regexp_replace(_first(F.col("p.images"))["src"], r"-(\d+x\d+|thumb)(?=\.)", "")
    return _done(
        rows.select("site", "page", "place", F.col("p.canonical_url").alias("url"), F.col("p.name").alias("name"), listing_price(variant["price"]).alias("price"), listing_price(variant["compare_at_price"]).alias("original_price"), _first(F.col("p.categories"))["name"].alias("category"), sizes.alias("sizes"), image.alias("image"))
    )


def rpc_store(pages: DataFrame, most_pages: int = 30) -> DataFrame:
    """Category RPC pages whose ``d`` holds JSON text; a payload that doesn't parse raises."""
    inner = F.coalesce(F.get_json_object("payload", "$.d"), F.col("payload"))
    parsed = pages.where(F.col("page") <= most_pages).select("site", "base_url", "page", F.from_json(inner, RPC, {"mode": "FAILFAST"}).alias("r"))
    rows = parsed.select("site", "base_url", "page", F.col("r.scName").alias("category"), F.posexplode("r.data.items").alias("place", "p"))
    price = F.coalesce(F.col("p.prli_price").try_cast("double"), tech_price(F.col("p.prli_price")))
    listed = F.col("p.strikeThroughPrice_original")
    url = F.concat("base_url", F.lit("/"), F.coalesce(F.nullif("p.item_desc4link", F.lit("")), slug(F.col("p.item_desc"))), F.lit("/"), F.col("p.item_id").cast("string"))
    return _done(rows.select("site", "page", "place", url.alias("url"), F.col("p.item_desc").alias("name"), price.alias("price"), F.when(listed > price, listed).alias("original_price"), "category", F.array().cast("array<string>").alias("sizes"), F.lit(None).cast("string").alias("image")))


def three_feeds(products: DataFrame, categories: DataFrame, brands: DataFrame, site: str, base_url: str) -> DataFrame:
    """Products joined to their category and brand names: on sale and in stock, special before list price, the first image by order."""
    p = products.where("vendible and stock > 0")
    price = F.when(F.col("precioEspecial") > 0, F.col("precioEspecial")).otherwise(F.col("precioLista"))
    original = F.when(F.col("precioLista") > F.col("price"), F.col("precioLista")).otherwise(F.col("precioListaAnterior"))
    names = lambda t, i, n: t.select(F.col("id").alias(i), F.col("nombre").alias(n))
    p = p.withColumn("price", price).join(names(categories, "id_subcategoria", "sub_name"), "id_subcategoria", "left").join(names(categories, "id_categoria", "cat_name"), "id_categoria", "left").join(names(brands, "id_marca", "brand"), "id_marca", "left")
    image = F.array_min(F.transform("imagenes", lambda i: F.struct(i["orden"].alias("orden"), i["nombre"].alias("nombre"))))["nombre"]
    url = F.concat(F.lit(base_url + "/producto/"), slug(F.col("nombre")), F.lit("_"), F.col("id_producto").cast("string"))
    return p.where("price > 0").select(F.lit(site).alias("site"), url.alias("url"), F.col("nombre").alias("name"), "price", original.alias("original_price"), F.coalesce("sub_name", "cat_name").alias("category"), "brand", image.alias("image"))


def product_cards(pages: DataFrame) -> DataFrame:
    """Static shop pages: a card for each ``product-box``, with its data as JSON in a click handler."""
    text = F.replace(F.replace("payload", F.lit("&quot;"), F.lit('"')), F.lit('\\"'), F.lit('"'))
    cards = F.slice(F.split(text, "product-box"), 2, 1_000_000)
    rows = pages.select("site", "base_url", "page", F.posexplode(cards).alias("place", "card"))
    data = F.from_json(F.regexp_extract("card", r"enhancedClick\((\{.*?\})\)", 1), CARD)
    href = F.regexp_extract("card", r'href="([^"]+)"', 1)
    rows = rows.withColumn("d", data)
    url = F.when(href.startswith("http"), href).otherwise(F.concat("base_url", F.when(href.startswith("/"), "").otherwise("/"), href))
    return _done(rows.select("site", "page", "place", url.alias("url"), F.col("d.name").alias("name"), F.col("d.price").alias("price"), F.lit(None).cast("double").alias("original_price"), F.col("d.category").alias("category"), F.array().cast("array<string>").alias("sizes"), F.regexp_extract("card", r'src="([^"]+)"', 1).alias("image")))


def plugin_cards(pages: DataFrame) -> DataFrame:
    """Shop-plugin listings: title, link and struck price of each list item of class product."""
    items = F.regexp_extract_all("payload", F.lit(r'(?s)<li[^>]*class="[^"]*\bproduct\b[^"]*".*?</li>'), F.lit(0))
    rows = pages.select("site", "base_url", "page", F.posexplode(items).alias("place", "card"))
    tagless = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    amounts = F.filter(F.transform(F.regexp_extract_all("card", F.lit(r"(?s)<bdi>(.*?)</bdi>"), F.lit(1)), lambda x: shop_price(F.regexp_replace(x, "<[^>]+>|&#36;|&nbsp;", ""))), lambda x: x.isNotNull())
    price, high = F.array_min(amounts), F.array_max(amounts)
    return _done(rows.select("site", "page", "place", F.regexp_extract("card", r'href="([^"]+)"', 1).alias("url"), tagless(F.regexp_extract("card", r"(?s)<h[23][^>]*>(.*?)</h[23]>", 1)).alias("name"), price.alias("price"), F.when(high > price, high).alias("original_price"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("sizes"), F.regexp_extract("card", r'<img[^>]*src="([^"]+)"', 1).alias("image")))


@F.pandas_udf(ArrayType(StringType()))
def _products(states: pd.Series) -> pd.Series:
    """JSON objects, at any depth, that have a name, a link and a price, in page order; a product's own parts aren't searched."""

    def inside(text: str | None) -> list[str]:
        try:
            waiting = [json.loads(text or "null")]
        except ValueError:
            return []
        found = []
        while waiting:
            x = waiting.pop()
            if isinstance(x, dict) and x.get("name") and any(x.get(k) for k in LINKS) and any(k in x for k in AMOUNTS):
                found.append(json.dumps(x))
            elif isinstance(x, (dict, list)):
                waiting += reversed(list(x.values() if isinstance(x, dict) else x))
        return found

    return states.map(inside)


def state_pages(pages: DataFrame) -> DataFrame:
    """Server-rendered shops that keep their products as JSON in the page state: any object with a name, a link and a price.

    Price and image may be objects themselves. A page without such a state, or with a broken one, gives no rows.
    """
    state = F.regexp_extract("payload", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    rows = pages.select("site", "base_url", "page", F.posexplode(_products(state)).alias("place", "item"))
    text = lambda *paths: F.coalesce(*[F.get_json_object("item", f"$.{p}") for p in paths])
    amount = lambda *names: F.coalesce(*[text(p).try_cast("double") for n in names for p in (n, f"{n}.value", f"{n}.amount")])
    link = text(*LINKS)
    url = F.when(link.startswith("http"), link).otherwise(F.concat("base_url", F.when(link.startswith("/"), "").otherwise("/"), link))
    price, high = amount(*AMOUNTS), amount("listPrice", "originalPrice")
    image = text("image.url", "image.src", "images[0].url", "images[0]", "image", "img")
    rows = rows.select("site", "page", "place", url.alias("url"), text("name").alias("name"), price.alias("price"), F.when(high > price, high).alias("original_price"), text("category.name", "category").alias("category"), F.array().cast("array<string>").alias("sizes"), image.alias("image"))
    return _done(rows)


def commerce_cards(pages: DataFrame) -> DataFrame:
    """Static catalog pages of ``card-ecommerce`` blocks: linked title, ``data-precio``, struck price."""
    cards = F.slice(F.split("payload", '<div class="card card-ecommerce'), 2, 1_000_000)
    rows = pages.select("site", "base_url", "page", F.posexplode(cards).alias("place", "card"))
    found = lambda pattern, k=1: F.nullif(F.regexp_extract("card", pattern, k), F.lit(""))
    title = r'card-title[^"]*"\s*>\s*<a href="([^"]+)">([^<]+)</a>'
    price, high = found(r'data-precio="([0-9.]+)"').try_cast("double"), local_price(found(r'tachado_\d"[^>]*>\$([0-9.,]+)</h6>'))
    image = found(r'<img src="([^"]+)"')
    image = F.when(image.startswith("http"), image).otherwise(F.concat("base_url", F.lit("/"), F.regexp_replace(image, "^/+", "")))
    return _done(rows.select("site", "page", "place", found(title).alias("url"), F.trim(found(title, 2)).alias("name"), price.alias("price"), F.when(high > price, high).alias("original_price"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("sizes"), image.alias("image")))


def _points(documents: DataFrame) -> DataFrame:
    """Points of both forms of an index: {"data": [[day, value], ...]} and [{"fecha": day, "valor": value}, ...]."""
    pairs = F.from_json(F.get_json_object("payload", "$.data"), "array<array<string>>")
    pairs = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("fecha"), F.get(p, F.lit(1)).alias("valor")))
    named = F.from_json(F.when(F.ltrim("payload").startswith("["), F.col("payload")), "array<struct<fecha:string,valor:string>>")
    rows = documents.select(F.explode(F.coalesce(pairs, named)).alias("p"))
    return rows.select(F.col("p.fecha").try_cast("date").alias("day"), F.col("p.valor").try_cast("double").alias("value")).where("day is not null and value > 0").groupBy("day").agg(F.min("value").alias("value"))


def index_series(documents: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """``day, value`` of a price index from JSON texts ``(payload)``, of either source's form.

    A source with fewer than two points is none: then the points are those of ``second``, where that is
    given and has two. A day counts once, with its least value.
    """
    if second is None:
        return _points(documents)
    both = _points(documents).withColumn("source", F.lit(1)).unionByName(_points(second).withColumn("source", F.lit(2)))
    usable = both.groupBy("source").agg(F.count("*").alias("n")).where("n >= 2").agg(F.min("source").alias("source"))
    return both.join(F.broadcast(usable), "source", "left_semi").select("day", "value")  # one row is broadcast


def market_search(documents: DataFrame, most: int = 8) -> DataFrame:
    """Offers of marketplace search results ``(url, payload)``: the first priced ones of each product."""
    offer = "results array<struct<title:string,price:double,permalink:string,condition:string>>"
    rows = documents.select("url", F.posexplode(F.from_json("payload", offer).results).alias("place", "o")).where("o.price > 0")
    order = Window.partitionBy("url").orderBy("place")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("url", F.col("o.title").alias("title"), F.col("o.price").alias("price"), F.col("o.permalink").alias("link"), F.col("o.condition").alias("condition"))


def platform(sites: DataFrame, lookup: DataFrame) -> DataFrame:
    """``site, url, platform``: from the lookup, else from the URL, else the default."""
    known = lookup.select("site_key", F.col("platform").alias("known"))
    key = F.regexp_replace(F.lower("site"), "[^a-z0-9]", "")
    guess = F.when(F.contains("url", F.lit("myshopify")), "shopify").when(F.contains("url", F.lit("vtex")), "vtex").when(F.contains("url", F.lit("wp-content")), "woocommerce").otherwise("tiendanube")
    return sites.withColumn("site_key", key).join(known, "site_key", "left").select("site", "url", F.coalesce(F.nullif("known", F.lit("")), guess).alias("platform"))
