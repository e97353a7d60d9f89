"""Where the pages of a listing end: at a page that repeats, at the one called the last, or where no link leads on.

A window holds one group's page numbers, never its products; groups run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def until_repeated(items: DataFrame, by: list[str], key: str = "url") -> DataFrame:
    """The rows of ``items`` on pages before the first one that is missing or shows no new ``key``; ``page`` counts from 1.

    A page shows something new if some key is on no earlier page of the same group.
    """
    new = items.groupBy(*by, key).agg(F.min("page").alias("page")).select(*by, "page").distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("page"))
    good = new.withColumn("k", place).where(F.col("k") == F.col("page")).select(*by, "page")
    return items.join(good, [*by, "page"], "left_semi")


def until_last(pages: DataFrame, last: Column, by: list[str]) -> DataFrame:
    """Pages up to the one that the shop calls the last: page p is read if p - 1 was and the last page told so far is p or more.

    ``last`` is null where a page doesn't tell; nothing told before page 2 means one page.
    """
    order = Window.partitionBy(*by).orderBy("page")
    rows = pages.withColumns({"__told": last.cast("int")})
    told = F.coalesce(F.last("__told", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    step = F.row_number().over(order)
    rows = rows.withColumn("__read", (F.col("page") == step) & ((F.col("page") == 1) | (F.col("page") <= told)))
    return rows.withColumn("__read", F.every("__read").over(order)).where("__read").drop("__told", "__read")


def until_unlinked(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages up to the first one that links to no later page: ``payload`` holds links with page=, mpage=, /p/ or /page/ and a number."""
    links = F.regexp_extract_all("payload", F.lit(r'href="[^"]*(?:[?&]m?page=|/p/|/page/)(\d{1,6})[^"]*"'), F.lit(1))
    later = F.array_max(F.filter(F.transform(links, lambda x: x.cast("int")), lambda x: x > F.col("page")))
    return until_last(pages, F.coalesce(F.when(later.isNotNull(), F.col("page") + 1), F.col("page")), by)
