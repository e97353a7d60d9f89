"""Snapshot writes: batch upsert, soft delete, reclassification, small keyed upserts.

Parquet has no MERGE: each function returns the next snapshot as a DataFrame, which the caller
writes beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOCKED = ["category", "gender", "vertical", "brand", "sub_category"]
VISUAL = ["fit", "print", "neckline", "color"]
PRICE_STEP = 0.01


def in_order(batch: DataFrame) -> DataFrame:
    """Batch rows with a URL, numbered per URL in batch order (ord)."""
    rows = batch.where("coalesce(url, '') <> ''")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("ord")))


def upsert(current: DataFrame, batch: DataFrame, with_visual: bool = True) -> DataFrame:
    """Next catalog snapshot. Of several batch rows of a URL the last wins.

    Lock-guarded columns keep their values where ``locked_by`` is set; visual columns are only
    filled, never blanked; every row of the batch becomes active again.
    """
    last = in_order(batch).withColumn("n", F.max("k").over(Window.partitionBy("url"))).where("k = n").drop("k", "n")
    values = [c for c in current.columns if c not in ("url", "locked_by", "active")]
    new = last.select("url", *[F.col(c).alias(f"new_{c}") for c in values if c in last.columns], F.lit(True).alias("hit"))
    both = current.join(new, "url", "full_outer")
    hit, fresh = F.coalesce("hit", F.lit(False)), F.col("active").isNull()

    def value(c: str) -> Column:
        if f"new_{c}" not in both.columns:
            return F.col(c)
        incoming = F.col(f"new_{c}")
        if c in VISUAL:
            incoming = F.coalesce(F.nullif(incoming, F.lit("")), F.col(c)) if with_visual else F.col(c)
            return F.when(hit, F.when(fresh, F.coalesce(incoming, F.lit(""))).otherwise(incoming)).otherwise(F.col(c))
        if c in LOCKED:
            return F.when(hit & F.col("locked_by").isNull(), incoming).otherwise(F.col(c))
        return F.when(hit, incoming).otherwise(F.col(c))

    out = {c: value(c) for c in values} | {"url": F.col("url"), "locked_by": F.col("locked_by"), "active": hit | F.coalesce("active", F.lit(False))}
    return both.select(*[out[c].alias(c) for c in current.columns])


def changes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with what they were: new, updated (the price moved by more than a cent) or same.

    Each row is compared with the one before it of its URL, the first with the catalog (active or not).
    """
    rows = in_order(batch).join(current.select("url", F.col("price").alias("old_price")), "url", "left")
    before = F.coalesce(F.lag("price").over(Window.partitionBy("url").orderBy("ord")), F.col("old_price"))
    rows = rows.withColumn("before", before)
    return rows.withColumn("change", F.when(F.col("before").isNull(), "new").when(F.abs(F.col("before") - F.col("price")) > PRICE_STEP, "updated").otherwise("same"))


def upsert_stats(current: DataFrame, batch: DataFrame) -> DataFrame:
    found = changes(current, batch)
    return found.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "same")])


def history_after(history: DataFrame, current: DataFrame, batch: DataFrame, day: Column) -> DataFrame:
    """History with the batch's first new or changed price of each URL, unless the day has one already."""
    moved = changes(current, batch).where("change <> 'same'").groupBy("url").agg(F.min_by("price", "ord").alias("price"))
    points = moved.select("url", F.lit(day).cast("date").alias("day"), "price").join(history.select("url", "day"), ["url", "day"], "left_anti")
    return history.unionByName(points)


def soft_delete(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch's sites whose URL it lacks become inactive; an empty batch deletes nothing."""
    sites = batch.select("site").where("site is not null").distinct().withColumn("in_site", F.lit(True))
    urls = batch.select("url").where("url is not null").distinct().withColumn("in_batch", F.lit(True))
    rows = current.join(sites, "site", "left").join(urls, "url", "left")
    gone = F.coalesce("in_site", F.lit(False)) & ~F.coalesce("in_batch", F.lit(False))
    return rows.withColumn("active", F.col("active") & ~gone).select(*current.columns)


def reclassify(current: DataFrame, proposals: DataFrame, human: bool = False, who: str = "human") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, audit rows) of proposed categories ``(url, new_category)``.

    A machine leaves locked rows alone; a human's decision holds and locks the row.
    """
    rows = current.join(proposals.select("url", "new_category"), "url", "left")
    allowed = F.col("new_category").isNotNull() & (F.lit(human) | F.col("locked_by").isNull())
    audit = rows.where(allowed & ~F.col("new_category").eqNullSafe(F.col("category"))).select("url", F.col("category").alias("before"), F.col("new_category").alias("after"), F.lit(who).alias("who"))
    rows = rows.withColumn("category", F.when(allowed, F.col("new_category")).otherwise(F.col("category")))
    if human:
        rows = rows.withColumn("locked_by", F.when(allowed, F.lit(who)).otherwise(F.col("locked_by")))
    return rows.select(*current.columns), audit


def apply_locks(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """``rows`` with the classification of ``locks(url, category, gender, ...)`` laid over."""
    columns = [c for c in LOCKED if c in locks.columns]
    held = locks.select("url", F.lit(True).alias("held"), *[F.col(c).alias(f"lock_{c}") for c in columns])
    joined = rows.join(held, "url", "left")
    return joined.withColumns({c: F.when(F.col("held"), F.col(f"lock_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def keyed_upsert(current: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with equal keys, or yield to them with ``keep_old``."""
    if keep_old:
        return current.unionByName(new.join(current.select(*keys), keys, "left_anti"))
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def refresh(previous: DataFrame, catalog: DataFrame, refreshed: DataFrame, derive) -> DataFrame:
    """Derived columns of ``previous`` for rows that didn't change; ``derive`` works on new and refreshed rows only."""
    stale = refreshed.select("url").union(catalog.select("url").join(previous.select("url"), "url", "left_anti")).distinct()
    kept = previous.join(catalog.select("url"), "url", "left_semi").join(stale, "url", "left_anti")
    return kept.unionByName(derive(catalog.join(stale, "url", "left_semi")))


def fk_violations(rows: DataFrame, lookup: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose value isn't in the lookup (nulls are allowed)."""
    return rows.where(F.col(column).isNotNull()).join(lookup.select(F.col(key).alias(column)), column, "left_anti")


class ProtectedRows(RuntimeError):
    """Favourites that keep a catalog from being emptied."""


def protecting(catalog: DataFrame, favourites: DataFrame) -> DataFrame:
    """Favourites whose product is in the catalog."""
    return favourites.join(catalog.select("url").distinct(), "url", "left_semi")


def emptied(catalog: DataFrame, favourites: DataFrame) -> DataFrame:
    """The empty next snapshot; raises while favourites hold rows of the catalog. Check and write belong to one writer."""
    held = protecting(catalog, favourites).count()
    if held:
        raise ProtectedRows(f"{held} favourites hold products of the catalog")
    return catalog.where(F.lit(False))


def renamed_values(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Rows with old values of a closed vocabulary replaced; all others, null too, stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)) if names else F.col(column))


def without_site_brands(rows: DataFrame, genuine: list[str]) -> DataFrame:
    """Rows whose brand is only their site's name get a blank brand, unless the site is a ``genuine`` brand."""
    fallback = (F.col("brand") == F.col("site")) & ~F.col("brand").isin(list(genuine))
    return rows.withColumn("brand", F.when(fallback, "").otherwise(F.col("brand")))


def child_rows(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``url, place, <name>``: a row for each value of an array column that isn't empty; places count from 1 over all values."""
    values = rows.select("url", F.posexplode(column).alias("place", name)).where(F.col(name) != "")
    return values.withColumn("place", F.col("place") + 1)
