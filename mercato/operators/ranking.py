"""Picks and rankings: brands, best of a category, recommendations, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.functions.prices import unit_price
from mercato.functions.text import blank, image_url

NO_SCORE = 999


def _vertical(rows: DataFrame, vertical: str | None) -> DataFrame:
    return rows.where(F.lower(F.coalesce("vertical", F.lit("indumentaria"))) == vertical.lower()) if vertical else rows


def _rank_score() -> Column:
    return F.when(F.col("score") > 0, F.col("score")).otherwise(NO_SCORE)


def _upper_median(value: str) -> Column:
    """The middle value, the upper one of two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def brands(catalog: DataFrame, vertical: str | None = None, text: str | None = None, most: int = 100, categories: int = 3) -> DataFrame:
    """Brands with two products or more: count, upper median, price range, top categories, best pick."""
    rows = _vertical(catalog.where(~blank(F.col("brand"))).withColumn("brand", F.trim("brand")), vertical)
    if text:
        rows = rows.where(F.contains(F.lower("brand"), F.lit(text.lower())))
    base = rows.groupBy("brand").agg(F.count("*").alias("n"), _upper_median("price").alias("median"), F.min("price").alias("low"), F.max("price").alias("high")).where("n >= 2")
    place = Window.partitionBy("brand").orderBy(F.col("c").desc(), "category")
    tops = rows.where(~blank(F.col("category"))).groupBy("brand", "category").agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(place)).where(F.col("k") <= categories)
    tops = tops.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]), ", ").alias("top_categories"))
    pick = Window.partitionBy("brand").orderBy(blank(F.col("image")), F.when(~blank(F.col("image")), _rank_score()), "price", "url")
    best = rows.withColumn("k", F.row_number().over(pick)).where("k = 1").select("brand", F.col("url").alias("best_url"), image_url(F.col("image")).alias("best_image"))
    return base.join(tops, "brand", "left").join(best, "brand").orderBy(F.col("n").desc(), "brand").limit(most)


def best_of_category(catalog: DataFrame, vertical: str | None = None, categories: int = 40, picks: int = 10) -> DataFrame:
    """Up to ``picks`` products of each of the largest categories: value, premium, all-time low, real deal, then the next best.

    A product stands once, under the first of these labels.
    """
    rows = _vertical(catalog.where(~blank(F.col("category"))), vertical).where(F.lower(F.trim(F.coalesce("gender", F.lit("")))) != "infantil")
    image = ~blank(F.col("image"))
    worth, cheap = F.struct(F.when(image, 0).otherwise(1), F.when(image, _rank_score()), "price", "url"), F.struct("price", "url")
    segment = F.coalesce("segment", F.lit("standard"))
    labels = {
        "valor": F.lit(True),
        "premium": segment.isin("premium", "standard") & F.col("score").between(30, 65) & image,
        "histLow": F.array_contains("badges", "all_time_low"),
        "oferta": F.array_contains("badges", "verified_deal"),
    }
    # The first of each label is an aggregate, combined before the shuffle, so a category of any size is no single task.
    firsts = [F.min_by("url", F.when(test, worth if name == "valor" else cheap)).alias(f"first{k}") for k, (name, test) in enumerate(labels.items())]
    largest = rows.groupBy("category").agg(F.count("*").alias("n"), *firsts).orderBy(F.col("n").desc(), "category").limit(categories)
    rows = rows.join(F.broadcast(largest), "category")  # at most ``categories`` rows
    is_first = [F.col("url") == F.col(f"first{k}") for k in range(len(labels))]
    label = F.coalesce(*[F.when(test, name) for test, name in zip(is_first, labels, strict=True)], F.when(image, "top"))
    rank = F.coalesce(*[F.when(test, k) for k, test in enumerate(is_first)], F.lit(len(labels)))
    place = Window.partitionBy("category").orderBy(rank, worth)
    return rows.withColumn("label", label).where("label is not null").withColumn("place", F.row_number().over(place)).where(F.col("place") <= picks).select("category", "n", "place", "label", "url", "price")


def category_medians(catalog: DataFrame) -> DataFrame:
    """Upper median of the unit price of each category."""
    rows = catalog.where(~blank(F.col("category"))).withColumn("each", unit_price(F.col("price"), F.col("units")))
    return rows.groupBy("category").agg(F.count("*").alias("n"), _upper_median("each").alias("median"))


def feedback_model(feedback: DataFrame, catalog: DataFrame) -> DataFrame:
    """``brand, category, likes, vetoed``: likes count unless the pair was disliked at last; delisted products are left out."""
    rows = feedback.where("kind in ('like', 'dislike')").join(catalog.select("url", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("category", F.lit("")).alias("category")), "url")
    return rows.groupBy("brand", "category").agg(F.count_if(F.col("kind") == "like").alias("likes"), (F.max_by("kind", "event_id") == "dislike").alias("vetoed"))


def opportunity() -> Column:
    """Opportunity score of a row: cheapness and bonuses for deals, badges and a moving price."""
    has = lambda name: F.array_contains("badges", name)
    bonus = lambda test, n: F.when(test, n).otherwise(0)
    moving = ~F.coalesce(F.nullif(F.trim("trend"), F.lit("")), F.lit("estable")).isin("estable")
    return 100 - F.col("score") + bonus(F.col("deal"), 25) + bonus(has("verified_deal"), 15) + bonus(has("all_time_low"), 15) + bonus(has("below_market"), 10) + bonus(moving, 8)


def recommend(catalog: DataFrame, model: DataFrame) -> DataFrame:
    """Rows that are not for children and not vetoed, by opportunity times taste; adds final and place."""
    rows = catalog.where(F.lower(F.trim(F.coalesce("gender", F.lit("")))) != "infantil")
    keyed = rows.withColumn("brand_key", F.coalesce("brand", F.lit(""))).withColumn("category_key", F.coalesce("category", F.lit("")))
    tastes = model.select(F.col("brand").alias("brand_key"), F.col("category").alias("category_key"), "likes", "vetoed")
    boost = F.least(1 + F.least(F.coalesce("likes", F.lit(0)), F.lit(5)) * 0.15, F.lit(1.75))
    scored = keyed.join(tastes, ["brand_key", "category_key"], "left").where(~F.coalesce("vetoed", F.lit(False))).withColumn("final", opportunity() * boost)
    return scored.drop("brand_key", "category_key", "likes", "vetoed").orderBy(F.col("final").desc(), "score", "url")


def gender_fits(requested: str | None) -> Column:
    """Blank and unisex fit everything; a blank or unisex request takes everything."""
    own = F.lower(F.trim(F.coalesce("gender", F.lit(""))))
    wanted = (requested or "").strip().lower()
    return own.isin("", "unisex", wanted) if wanted not in ("", "unisex") else F.lit(True)


def broaden_gender(rows: DataFrame, requested: str | None) -> DataFrame:
    """Per category: rows that fit the request, else unisex rows, else all."""
    fits, unisex = gender_fits(requested), F.lower(F.trim(F.coalesce("gender", F.lit("")))) == "unisex"
    key = F.coalesce("category", F.lit(""))
    found = rows.groupBy(key.alias("__of")).agg(F.max(fits).alias("__fit"), F.max(unisex).alias("__uni"))
    joined = rows.join(found, key == F.col("__of"))
    return joined.where(F.when(F.col("__fit"), fits).when(F.col("__uni"), unisex).otherwise(True)).drop("__of", "__fit", "__uni")


def yield_alerts(before: DataFrame, now: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """Sites that had ``least`` rows and lost all, or more than half, of them. Both frames are (site, n)."""
    both = before.select("site", F.col("n").alias("n_before")).where(F.col("n_before") >= least).join(now.select("site", F.col("n").alias("n_now")), "site", "left")
    both = both.withColumn("n_now", F.coalesce("n_now", F.lit(0)))
    return both.where(F.col("n_now") < F.col("n_before") * share).withColumn("alert", F.when(F.col("n_now") == 0, "total").otherwise("partial"))


def extraction(batches: DataFrame) -> DataFrame:
    """Rows, valid rows and misses of each site."""
    ok = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("url", F.lit(""))) != "") & (F.coalesce("price", F.lit(0.0)) > 0)
    return batches.groupBy("site").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("misses"))
