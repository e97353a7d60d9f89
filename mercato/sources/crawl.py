"""Discovery and crawling over a table of stored pages (site, url, payload).

A shop's category tree is found as a fixpoint: each round joins the pages of the newest categories, takes the links that their
payloads hold, and keeps those that no round has seen (an anti-join). The listing pages of each leaf
are then cut where the shop has run out: at the first page that shows nothing that earlier pages of
the leaf didn't show, for many shops repeat their last page for ever. Other shops say themselves which page is the last, or link to
the next one. All of it works on all sites at once; nothing about a site is held by one task but its categories' page numbers.

Pages are matched by URL without a slash at its end. Missing pages end a leaf; null payloads are empty pages; of
pages stored twice under one URL the one with the greatest payload counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.graph import cut
from mercato.sources import feeds
from mercato.sources.paging import until_repeated

# Top-level links that lead to no category.
DENIED = ["carrito", "mi-cuenta", "checkout", "login", "registro", "contacto", "productos"]
LINK = r'href="(https?://[^"/]+(?:/[a-z0-9][a-z0-9-]*)+)/?"'
SLUG = r"[a-z0-9][a-z0-9-]*"


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def _slugs(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "^https?://[^/]+/?", ""), "/")


def stored(pages: DataFrame) -> DataFrame:
    """``site, url, payload`` once for each URL."""
    rows = pages.where("site is not null and url is not null").select("site", _bare(F.col("url")).alias("url"), F.coalesce("payload", F.lit("")).alias("payload"))
    return rows.groupBy("site", "url").agg(F.max("payload").alias("payload"))


def discover(pages: DataFrame, seeds: DataFrame, depth: int = 2, denied: list[str] | None = None, fallback: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """``site, base_url, url, slugs, places, leaf``: the category tree of every seed ``(site, base_url)``.

    A category's children are the links of its page that add one part to its path; ``places`` are the
    places of the links on the way, by which categories are ordered. Of equal links the first counts.
    A category without children is a leaf, as is one at ``depth``. Where a shop's start page shows no category,
    the slugs of ``fallback(site, slug)`` are taken.
    """
    denied = DENIED if denied is None else denied
    pages = cut(stored(pages))
    start = seeds.select("site", _bare(F.col("base_url")).alias("base_url")).distinct()
    start = start.select("*", F.col("base_url").alias("url"), F.array().cast("array<string>").alias("slugs"), F.array().cast("array<int>").alias("places"))
    seen = frontier = cut(start)
    for _ in range(min(depth, most_rounds)):
        links = frontier.join(pages, ["site", "url"]).select("site", "base_url", "slugs", "places", F.posexplode(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))).alias("place", "link"))
        links = links.withColumn("path", _slugs(F.col("link")))
        deeper = (F.size("path") == F.size("slugs") + 1) & (F.slice("path", 1, F.greatest(F.size("slugs"), F.lit(0))) == F.col("slugs"))
        known = ~((F.size("slugs") == 0) & F.get("path", F.lit(0)).isin(denied))
        found = links.where(deeper & known).select("site", "base_url", F.concat("base_url", F.lit("/"), F.array_join("path", "/")).alias("url"), F.col("path").alias("slugs"), F.array_append("places", F.col("place")).alias("places"))
        found = found.groupBy("site", "base_url", "url").agg(F.min_by("slugs", "places").alias("slugs"), F.min("places").alias("places"))
        if fallback is not None and frontier is seen:
            bare = frontier.join(found.select("site").distinct(), "site", "left_anti").join(fallback.select("site", "slug").distinct(), "site")
            order = F.row_number().over(Window.partitionBy("site").orderBy("slug")) - 1
            found = found.unionByName(bare.select("site", "base_url", F.concat("base_url", F.lit("/"), "slug").alias("url"), F.array("slug").alias("slugs"), F.array(order).alias("places")))
        frontier = cut(found.join(seen.select("site", "url"), ["site", "url"], "left_anti").select(*seen.columns))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    parents = seen.where("size(slugs) > 1").select("site", F.concat("base_url", F.lit("/"), F.array_join(F.slice("slugs", 1, F.size("slugs") - 1), "/")).alias("url")).distinct()
    tree = seen.where("size(slugs) > 0").join(parents.withColumn("parent", F.lit(True)), ["site", "url"], "left")
    return tree.select("site", "base_url", "url", "slugs", "places", F.col("parent").isNull().alias("leaf"))


def listing_pages(pages: DataFrame, leaves: DataFrame, most: int | None = None) -> DataFrame:
    """The stored listing pages of each leaf, all or those up to ``most``: ``site, base_url, leaf_url, places, hint, page, payload``."""
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]m?page=(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))
    rows = stored(pages).select("site", _bare(F.regexp_replace("url", r"[?&]m?page=\d+$", "")).alias("leaf_url"), number.alias("page"), "payload").where("page >= 1")
    rows = rows if most is None else rows.where(F.col("page") <= most)
    named = F.initcap(F.replace(F.try_element_at("slugs", F.lit(-1)), F.lit("-"), F.lit(" ")))
    return leaves.select("site", "base_url", F.col("url").alias("leaf_url"), "places", named.alias("hint")).join(rows, ["site", "leaf_url"])


def crawl(pages: DataFrame, seeds: DataFrame, reader: Callable[[DataFrame], DataFrame] = feeds.product_cards, depth: int = 2, fallback: DataFrame | None = None, most_pages: int | None = None) -> DataFrame:
    """Products of all leaves of all seeds, as ``reader`` finds them on each page: each URL of a site once, from its first leaf.

    A leaf ends where its pages do, or at ``most_pages`` where a caller sets it. Products without a category of their own get their leaf's name.
    """
    tree = discover(pages, seeds, depth, fallback=fallback)
    listed = listing_pages(pages, tree.where("leaf"), most_pages).withColumn("number", F.col("page"))
    # A reader drops what a site shows twice; here each page is a site of its own, and what repeats is judged below.
    key = F.to_json(F.struct("site", "leaf_url", "places", "hint", "number"))
    items = reader(listed.select(key.alias("site"), "base_url", "page", "payload"))
    told = F.from_json("site", "site string, leaf_url string, places array<int>, hint string, number int")
    items = items.withColumn("told", told).withColumns({"site": F.col("told.site"), "leaf_url": F.col("told.leaf_url"), "places": F.col("told.places"), "page": F.col("told.number"), "hint": F.col("told.hint")})
    kept = until_repeated(items, ["site", "leaf_url"])
    first = F.row_number().over(Window.partitionBy("site", "url").orderBy("places", "page"))
    kept = kept.withColumn("k", first).where("k = 1").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), "hint"))
    return kept.select(*feeds.OUTPUT, "leaf_url", "page")
