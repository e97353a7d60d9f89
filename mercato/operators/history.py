"""Price histories: trends, buy signals, inflation, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_POINTS, KEEP_POINTS, KEEP_DAYS = 7, 60, 90


def _from_last(history: DataFrame) -> DataFrame:
    """Adds back (1 for the last point of a url) and n."""
    last = Window.partitionBy("url").orderBy(F.col("day").desc())
    return history.withColumn("back", F.row_number().over(last)).withColumn("n", F.count("*").over(Window.partitionBy("url")))


def trends(history: DataFrame) -> DataFrame:
    """Per url: points, last price, lowest, highest, mean of the last seven points, trend, percent a day."""
    points = _from_last(history).groupBy("url").agg(
        F.count("*").alias("n"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.max_by("price", "day").alias("last"),
        F.min_by("price", "day").alias("first"),
        F.greatest(F.datediff(F.max("day"), F.min("day")), F.lit(1)).alias("days"),
        F.avg(F.when(F.col("back") <= WINDOW_POINTS, F.col("price"))).alias("mean7"),
    )
    change = (F.col("last") - F.col("mean7")) / F.nullif(F.col("mean7"), F.lit(0.0)) * 100
    trend = F.when(F.col("n") < 2, "estable").when(change <= -5, "bajando").when(change >= 5, "subiendo").otherwise("estable")
    velocity = F.when((F.col("n") < 2) | (F.col("first") == 0), 0.0).otherwise((F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0)) / F.col("days") * 100)
    return points.withColumn("trend", trend).withColumn("velocity", F.bround(velocity, 4)).withColumn("at_low", (F.col("n") >= 3) & (F.col("low") > 0) & (F.col("last") <= F.col("low") * 1.05)).drop("first", "days")


def signal(history: DataFrame, inflation: float = 1.0) -> DataFrame:
    """Buy signal per url from the place in the price range, the real change and the trend of late."""
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("price")))
    oldest = F.max(F.when(F.col("back") == F.least(F.col("n"), F.lit(13)), F.col("price")))
    points = _from_last(history).groupBy("url").agg(at(1).alias("last"), at(4).alias("fourth"), F.min("price").alias("low"), F.max("price").alias("high"), oldest.alias("old"), F.count("*").alias("n"))
    real = F.when(F.col("old") * inflation > 0, (F.col("last") - F.col("old") * inflation) / F.nullif(F.col("old") * inflation, F.lit(0.0)) * 100).otherwise(0.0)
    place = F.when(F.col("high") > F.col("low"), (F.col("last") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 100).otherwise(50.0)
    nominal = F.when(F.col("fourth") > 0, (F.col("last") - F.col("fourth")) / F.nullif(F.col("fourth"), F.lit(0.0)) * 100).otherwise(0.0)
    points = points.withColumns({"real_change": real, "range_pct": place, "nominal": nominal})
    falling, rising = F.col("nominal") < -5, F.col("nominal") > 5
    label = (
        F.when(F.col("range_pct") <= 10, "comprar_ahora")
        .when((F.col("real_change") < -8) & falling, "muy_buen_momento")
        .when(F.col("real_change") < -3, "buen_momento")
        .when((F.col("real_change") > 10) & rising, "esperar")
        .when(F.col("range_pct") >= 80, "caro")
        .otherwise("precio_normal")
    )
    # The score of each signal.
    scores = {"comprar_ahora": 95, "muy_buen_momento": 85, "buen_momento": 70, "esperar": 20, "caro": 15, "precio_normal": 50}
    table = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    return points.withColumn("signal", label).withColumn("signal_score", F.element_at(table, F.col("signal"))).select("url", "n", "last", "low", "high", "real_change", "range_pct", "signal", "signal_score")


def overview(history: DataFrame) -> DataFrame:
    """Lowest, highest, mean and total change per url with two points or more; change to one decimal, halves up."""
    rows = history.groupBy("url").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"), F.min_by("price", "day").alias("first"), F.max_by("price", "day").alias("last")).where("n >= 2")
    change = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0)) * 100).otherwise(0.0)
    return rows.withColumn("change_pct", F.floor(change * 10 + 0.5) / 10)


def append_today(history: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """History with today's price where the day is new or the price moved by more than a cent; the last 60 points."""
    last = history.groupBy("url").agg(F.max("day").alias("last_day"), F.max_by("price", "day").alias("last_price"))
    new = catalog.select("url", F.lit(today).cast("date").alias("day"), "price").join(last, "url", "left")
    new = new.where(F.col("last_day").isNull() | (F.col("last_day") != F.col("day")) | (F.abs(F.col("last_price") - F.col("price")) > 0.01)).select("url", "day", "price")
    kept = history.unionByName(new)
    order = Window.partitionBy("url").orderBy(F.col("day").desc(), "price")
    return kept.withColumn("k", F.row_number().over(order)).where(F.col("k") <= KEEP_POINTS).drop("k")


def purge(history: DataFrame, favourites: DataFrame, today: Column, days: int = KEEP_DAYS) -> DataFrame:
    """History without points older than ``days``, but that of favourites stays whole."""
    fresh = history.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), days))
    old = history.where(F.col("day") < F.date_sub(F.lit(today).cast("date"), days))
    return fresh.unionByName(old.join(favourites.select("url").distinct(), "url", "left_semi"))


def of_urls(history: DataFrame, urls: DataFrame) -> DataFrame:
    return history.join(urls.select("url").distinct(), "url", "left_semi").orderBy("url", "day")


def latest(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The last ``keep`` rows of each group."""
    last = Window.partitionBy(group).orderBy(F.col(order).desc())
    return rows.withColumn("k", F.row_number().over(last)).where(F.col("k") <= keep).drop("k")


def inflation(index: DataFrame) -> DataFrame:
    """Variation of a monthly price index over one, three and twelve months, in percent."""
    order = Window.orderBy("day")  # one row a month
    change = lambda k: (F.col("value") / F.nullif(F.lag("value", k).over(order), F.lit(0.0)) - 1) * 100
    return index.withColumns({"monthly": change(1), "quarterly": change(3), "yearly": change(12)})


def inflation_factor(index: DataFrame, months: int, monthly_fallback: float) -> float:
    """Ratio of the last index value to that ``months`` before; compound growth if it doesn't reach so far."""
    rows = index.orderBy(F.col("day").desc()).limit(months + 1).collect()
    if len(rows) > months and rows[months].value > 0:
        return rows[0].value / rows[months].value
    return (1 + monthly_fallback) ** months
