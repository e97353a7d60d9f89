"""Faceted catalog search: filters, orders, pages, facets, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.functions.prices import discount_pct, unit_price
from mercato.functions.text import fold, product_key, size_rank

VISUAL = ["fit", "print", "neckline", "color"]
DEFAULT_SEGMENT, DEFAULT_VERTICAL = "standard", "indumentaria"


@dataclass(frozen=True)
class CatalogFilter:
    """What to search for; None, a blank string or an empty tuple filters nothing."""

    site: str | None = None
    sizes: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    badges: tuple[str, ...] = ()
    segment: str | None = None
    vertical: str | None = None
    gym: bool = False
    packs: bool = False
    price_min: float | None = None
    price_max: float | None = None
    gender: str | None = None
    categories: tuple[str, ...] = ()
    sub_categories: tuple[str, ...] = ()
    fit: str | None = None
    print: str | None = None
    neckline: str | None = None
    color: str | None = None
    text: str | None = None


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _default(name: str, value: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))


def conditions(f: CatalogFilter) -> list[Column]:
    """The filter as Catalyst predicates, all of which must hold."""
    set_ = lambda x: bool(x and x.strip())
    lowered = lambda xs: [x.lower() for x in xs if set_(x)]
    out = [F.col("active")]
    if set_(f.site):
        out.append(_lower("site") == f.site.lower())
    if wanted := lowered(f.sizes):
        out.append(F.exists("sizes", lambda x: F.lower(x).isin(wanted)))
    if wanted := lowered(f.brands):
        out.append(_lower("brand").isin(wanted))
    if f.badges:
        out.append(F.exists("badges", lambda x: x.isin(list(f.badges))))
    if set_(f.segment):
        out.append(F.lower(_default("segment", DEFAULT_SEGMENT)) == f.segment.lower())
    if set_(f.vertical):
        out.append(F.lower(_default("vertical", DEFAULT_VERTICAL)) == f.vertical.lower())
    if f.gym:
        out.append(F.col("gym"))
    if f.packs:
        out.append(F.col("units") > 1)
    if f.price_min is not None:
        out.append(unit_price(F.col("price"), F.col("units")) >= f.price_min)
    if f.price_max is not None:
        out.append(unit_price(F.col("price"), F.col("units")) <= f.price_max)
    if set_(f.gender):
        out.append(_lower("gender") == f.gender.lower())
    if wanted := lowered(f.categories):
        # Equal, or one is the other's first words.
        own = _lower("category")
        either = F.lit(False)
        for w in wanted:
            either = either | (own == w) | own.startswith(w + " ") | F.startswith(F.lit(w), F.concat(own, F.lit(" ")))
        out.append((own != "") & either)
    if wanted := lowered(f.sub_categories):
        out.append(_lower("sub_category").isin(wanted))
    for name in VISUAL:
        if set_(value := getattr(f, name)):
            out.append(_lower(name) == value.lower())
    if set_(f.text):
        out.append(F.contains(_lower("name"), F.lit(f.text.lower())))
    return out


def matching(catalog: DataFrame, f: CatalogFilter) -> DataFrame:
    for c in conditions(f):
        catalog = catalog.where(c)
    return catalog


def ordering(order: str | None) -> list[Column]:
    """Sort columns of a named order; url breaks every tie."""
    by = {
        "price_desc": F.col("price").desc(),
        "name_asc": F.lower(F.coalesce(F.col("name"), F.lit(""))).asc(),
        "score": F.col("score").desc(),
        "discount": discount_pct(F.col("price"), F.col("original_price")).desc_nulls_last(),
    }
    return [by.get(order or "", F.col("price").asc()), F.col("url").asc()]


def search(catalog: DataFrame, f: CatalogFilter, order: str | None = None, page: int = 1, size: int = 48) -> DataFrame:
    """One page of the matching rows with its place. The limit stands below any enrichment."""
    offset = (max(page, 1) - 1) * size
    found = matching(catalog, f).orderBy(*ordering(order)).offset(offset).limit(size)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*ordering(order))) + offset)


def count(catalog: DataFrame, f: CatalogFilter) -> DataFrame:
    return matching(catalog, f).agg(F.count("*").alias("total"))


def _facet_keys() -> dict[str, Column]:
    trimmed = lambda name: F.trim(F.col(name))
    category = trimmed("category")
    one = lambda c: F.array(c)
    keys = {
        "gender": one(F.lower(trimmed("gender"))),
        "category": one(F.concat(F.upper(F.substring(category, 1, 1)), F.lower(F.substr(category, F.lit(2))))),
        "brand": one(trimmed("brand")),
        "sub_category": one(trimmed("sub_category")),
        "size": F.transform("sizes", lambda x: F.trim(x)),
        "badge": F.transform("badges", lambda x: F.trim(x)),
    }
    return keys | {name: one(trimmed(name)) for name in VISUAL}


def _labelled(facet: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(facet).alias("facet"), k.alias("key")))


def facets(catalog: DataFrame, top_brands: int = 30) -> DataFrame:
    """``facet, key, n, place`` of all facets in one pass over the active rows.

    Blank keys are left out. Keys stand by count and name, except sub-categories (by name) and sizes
    (by size); of the brands the first ``top_brands`` stay.
    """
    pairs = F.flatten(F.array(*[_labelled(name, keys) for name, keys in _facet_keys().items()]))
    counted = catalog.where("active").select(F.explode(pairs).alias("p")).select("p.facet", "p.key").where("coalesce(key, '') <> ''").groupBy("facet", "key").agg(F.count("*").alias("n"))
    by_count = F.when(~F.col("facet").isin("sub_category", "size"), -F.col("n")).otherwise(0)
    by_size = F.when(F.col("facet") == "size", size_rank(F.col("key")))
    order = Window.partitionBy("facet").orderBy(by_count, by_size, "key")
    return counted.withColumn("place", F.row_number().over(order)).where((F.col("facet") != "brand") | (F.col("place") <= top_brands))


def summary(catalog: DataFrame) -> DataFrame:
    """One row: price range and counts of the active catalog."""
    return catalog.where("active").agg(
        F.coalesce(F.min("price"), F.lit(0.0)).alias("price_min"),
        F.coalesce(F.max("price"), F.lit(0.0)).alias("price_max"),
        F.count("*").alias("total"),
        F.count_if("gym").alias("n_gym"),
        F.count_if(F.col("units") > 1).alias("n_packs"),
    )


def counts_by(catalog: DataFrame) -> DataFrame:
    """``kind, key, n`` of the active rows by site and by vertical (a blank one is the default)."""
    vertical = F.coalesce(F.nullif(F.trim("vertical"), F.lit("")), F.lit(DEFAULT_VERTICAL))
    pairs = F.array(F.struct(F.lit("site").alias("kind"), F.trim("site").alias("key")), F.struct(F.lit("vertical").alias("kind"), vertical.alias("key")))
    return catalog.where("active").select(F.explode(pairs).alias("p")).select("p.*").where("coalesce(key, '') <> ''").groupBy("kind", "key").agg(F.count("*").alias("n"))


def by_key(catalog: DataFrame, key: str) -> DataFrame:
    """Point lookup by the 16-digit product key."""
    return catalog.where(product_key(F.col("url")) == key)


def full_scan(catalog: DataFrame) -> DataFrame:
    """Active rows with the defaults that readers rely on, cheapest first."""
    return (
        catalog.where("active")
        .withColumns({"segment": _default("segment", DEFAULT_SEGMENT), "vertical": F.coalesce(F.nullif(F.trim("vertical"), F.lit("")), F.lit(DEFAULT_VERTICAL)), "units": F.greatest(F.coalesce("units", F.lit(1)), F.lit(1))})
        .orderBy("price", "url")
    )


def words_search(catalog: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Active rows whose name or brand holds the text, accents ignored; the cheapest ``most``."""
    found = catalog.where("active").where(fold(F.col("name")).contains(fold(F.lit(text))) | fold(F.col("brand")).contains(fold(F.lit(text))))
    return found.orderBy("price", "url").limit(most)


def valid(rows: DataFrame) -> DataFrame:
    """Rows with a name, a URL and a price above zero."""
    return rows.where("trim(coalesce(name, '')) <> '' and trim(coalesce(url, '')) <> '' and price > 0")


def first_of_each(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """First row of each site and name (case and outer blanks ignored), by price."""
    key = F.concat_ws("|", F.coalesce("site", F.lit("")), F.lower(F.trim(F.coalesce("name", F.lit("")))))
    first = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").orderBy("price", "url")
