"""Robust price statistics of groups, price scores, discounts and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.operators.graph import cut
from mercato.operators.percentiles import MOST_VALUES, large_groups, percentiles, weighted

LEAST_SAMPLE = 3
#: Width of a bin of the mode: a fifth of the interquartile range, but not less than this.
LEAST_BIN = 5000
# Order in which badges stand.
BADGES = ["all_time_low", "below_market", "verified_deal", "trending", "price_dropping", "above_market", "fake_discount"]


def _counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, v, c``: how often each value above zero stands in its group. Counts are combined before the shuffle."""
    return rows.select(*keys, F.col(value).alias("v")).where("v > 0").groupBy(*keys, "v").agg(F.count("*").alias("c"))


def price_stats(rows: DataFrame, keys: list[str], value: str, least_bin: int = LEAST_BIN, most_values: int = MOST_VALUES) -> DataFrame:
    """n, mean, median, q1, q3, iqr, mode, std, mad, cv and Tukey fences of the values above zero.

    Works on one row for each different value of a group, with its count, which is written once: a group
    that holds a third of all rows has no more of those than it has prices. Three aggregations over these:
    moments and quartiles, then the distances from mean and median, then the fullest bin and its median.
    Medians of groups with more than ``most_values`` prices are found by rounds (``percentiles``).
    """
    counted = cut(_counted(rows, keys, value))
    plain = large_groups(counted, keys, most_values).isEmpty()  # then no bin and no set of distances is larger either
    middle = lambda v, at=0.5: weighted(v, at, F.col("c"))
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    moments = [F.sum("c").alias("n"), F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(mean).alias("mean")]
    quartiles = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    base = counted.groupBy(*keys).agg(*moments, *([middle("v", p).alias(name) for name, p in quartiles.items()] if plain else []))
    if not plain:
        base = cut(base.join(percentiles(counted, keys, quartiles, most_values), keys))
    base = base.withColumn("iqr", F.col("q3") - F.col("q1"))
    seen = counted.join(base.select(*keys, "mean", "median", "iqr"), keys)
    apart = F.col("v") - F.col("mean")
    distance = F.abs(F.col("v") - F.col("median"))
    spread = F.sqrt(F.sum(apart * apart * F.col("c")) / F.sum("c")).alias("std")
    width = F.when(F.col("iqr") > 0, F.greatest(F.lit(least_bin), F.floor(F.col("iqr") / 5))).otherwise(least_bin)
    binned = seen.withColumn("bin", F.floor(F.col("v") / width))
    if plain:
        mad = seen.groupBy(*keys).agg(middle(distance).alias("mad"), spread)
        bins = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("n_bin"), middle("v").alias("mode"))
    else:
        distances = seen.groupBy(*keys, distance.alias("v")).agg(F.sum("c").alias("c"))
        mad = seen.groupBy(*keys).agg(spread).join(percentiles(distances, keys, {"mad": 0.5}, most_values), keys)
        bins = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("n_bin"))
    fullest = Window.partitionBy(*keys).orderBy(F.col("n_bin").desc(), "bin")
    mode = bins.withColumn("k", F.row_number().over(fullest)).where("k = 1").drop("k")
    if not plain:
        inside = binned.join(mode.select(*keys, "bin"), [*keys, "bin"]).select(*keys, "v", "c")
        mode = percentiles(inside, keys, {"mode": 0.5}, most_values)
    out = base.join(mad, keys).join(mode.select(*keys, "mode"), keys)
    return out.withColumns(
        {
            "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean") * 100).otherwise(0.0),
            "fence_low": F.col("q1") - 1.5 * F.col("iqr"),
            "fence_high": F.col("q3") + 1.5 * F.col("iqr"),
            "fence_low_far": F.col("q1") - 3.0 * F.col("iqr"),
            "fence_high_far": F.col("q3") + 3.0 * F.col("iqr"),
        }
    )


def _clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def score(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds percentile, z, mz, composite, band, cheap_outlier and dear_outlier of each row in its group.

    A group's statistics are as ``price_stats``; the rank counts values strictly below.
    """
    stats = price_stats(rows, keys, value).select(*keys, "n", "mean", "median", "q1", "q3", "iqr", "std", "mad", "cv", "fence_low", "fence_high")
    earlier = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    below = _counted(rows, keys, value).withColumn("below", F.coalesce(F.sum("c").over(earlier), F.lit(0))).select(*keys, F.col("v").alias(value), "below")
    x = F.col(value)
    small = F.col("n") < LEAST_SAMPLE
    z = F.when(small | (F.col("std") == 0), 0.0).otherwise((x - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    mz = F.when(small | (F.col("mad") == 0), F.col("z")).otherwise(0.6745 * (x - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0)))
    distance = F.when(F.col("iqr") > 0, _clamp(((x - F.col("median")) / F.nullif(F.col("iqr"), F.lit(0.0)) + 2) / 4 * 100)).otherwise(50.0)
    composite = F.bround(0.40 * F.col("percentile") + 0.35 * _clamp((F.col("mz") + 3) / 6 * 100) + 0.25 * distance, 0).cast("int")
    band = F.when(small, "standard").when(x < F.col("q1"), "budget").when(x <= F.col("q3"), "standard").when(x <= F.col("fence_high"), "premium").otherwise("luxury")
    spread = ~small & (F.col("iqr") > 0)
    return (
        rows.where(x > 0)
        .join(below, [*keys, value])
        .join(stats, keys)
        .withColumn("percentile", F.when(F.col("n") < 2, 50).otherwise(F.floor(100 * F.col("below") / F.col("n"))).cast("int"))
        .withColumn("z", z)
        .withColumn("mz", mz)
        .withColumn("composite", F.when(small, F.col("percentile")).otherwise(composite))
        .withColumn("band", band)
        .withColumn("cheap_outlier", spread & (x < F.col("fence_low")))
        .withColumn("dear_outlier", spread & (x > F.col("fence_high")))
        .withColumn("quality", F.when(F.col("cv") < 40, "alta").when(F.col("cv") < 80, "media").otherwise("baja"))
        .drop("below")
    )


def group_keys(rows: DataFrame, parents: DataFrame, least_group: int = 10, least_gender: int = 20) -> DataFrame:
    """Adds group_key: the category if it is large enough, else a large enough parent, else itself.

    Electronics get a prefix of their own; large categories are split by gender. ``parents(category,
    parent)`` is small; Spark broadcasts it by its size.
    """
    named = rows.withColumn("cat", F.lower(F.trim(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("General")))))
    counts = named.groupBy("cat").agg(F.count("*").alias("n_cat"))
    above = parents.select(F.lower("category").alias("cat"), F.lower("parent").alias("parent")).join(counts.select(F.col("cat").alias("parent"), F.col("n_cat").alias("n_parent")), "parent", "left")
    plan = counts.join(above, "cat", "left").select("cat", "n_cat", F.when(F.col("n_cat") >= least_group, F.col("cat")).when(F.col("n_parent") >= least_group, F.col("parent")).otherwise(F.col("cat")).alias("chosen"))
    tech, gender = F.coalesce("vertical", F.lit("")) == "tecnologia", F.trim(F.coalesce("gender", F.lit("")))
    key = F.when(tech, F.concat(F.lit("tech|"), "cat")).when((gender != "") & (F.col("n_cat") >= least_gender), F.concat_ws("|", "chosen", gender)).otherwise(F.col("chosen"))
    return named.join(plan, "cat").withColumn("group_key", key).drop("cat", "n_cat", "chosen")


def discounts(rows: DataFrame, least_ratio: float = 1.20, most_ratio: float = 5.0, least_sample: int = 5) -> DataFrame:
    """Adds ratio, discount_pct and significant, against the discounts of the category or, if those are few, of all."""
    original = F.coalesce("original_price", F.lit(0.0))
    real = original / F.nullif(F.col("price"), F.lit(0.0))
    known = rows.where((F.col("price") > 0) & (real >= least_ratio) & (real > 1) & (real <= most_ratio)).select("category", real.alias("ratio"))
    by_category = known.groupBy("category").agg(F.count("*").alias("n_cat"), F.percentile("ratio", F.lit(0.5)).alias("med_cat"))
    overall = known.agg(F.count("*").alias("n_all"), F.percentile("ratio", F.lit(0.5)).alias("med_all"))
    ratio = F.when((F.col("price") > 0) & (original > F.col("price")), real).otherwise(1.0)
    enough = (F.coalesce("n_cat", F.lit(0)) >= least_sample) & (F.col("med_cat") > 1.05)
    by_all = (F.col("n_all") >= least_sample) & (F.col("med_all") > 1.05) & (F.col("ratio") >= F.greatest("med_all", F.lit(1.25)))
    significant = (F.col("ratio") > 1) & F.when(enough, F.col("ratio") >= F.greatest("med_cat", F.lit(1.25))).otherwise(F.coalesce(by_all, F.lit(False)))
    joined = rows.join(by_category.withColumnRenamed("category", "c"), F.col("category").eqNullSafe(F.col("c")), "left").drop("c").crossJoin(overall)  # overall has one row
    return joined.withColumn("ratio", ratio).withColumn("discount_pct", F.when(F.col("ratio") > 1, (1 - F.col("price") / original) * 100).otherwise(0.0)).withColumn("significant", significant).drop("n_cat", "med_cat", "n_all", "med_all")


def real_deal(history_ok: Column) -> Column:
    """A believable, significant discount on a competitive price."""
    return (F.col("ratio") >= 1.20) & (F.col("ratio") <= 3.5) & (F.col("discount_pct") >= 20) & (F.col("composite") <= 40) & F.col("significant") & history_ok


def badges(historical_low: Column, high_demand: Column, trend: Column, deal: Column) -> Column:
    """Badges in their fixed order from composite, mz, outlier flags, ratio and discount_pct."""
    c, mz = F.col("composite"), F.col("mz")
    tests = [
        historical_low & (c <= 35),
        F.col("cheap_outlier") | ((c <= 20) & (mz <= -1.5)),
        deal,
        high_demand & (c <= 65),
        (trend == "bajando") & (c <= 40),
        F.col("dear_outlier") | ((c >= 80) & (mz >= 1.5)),
        (F.col("ratio") > 1.0) & (F.col("discount_pct") < 12),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in zip(BADGES, tests, strict=True)]))
