"""Exports: CSV rows, JSON pages, retained payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOM = "﻿"
COLUMNS = ["name", "price", "site", "category", "gender", "brand", "sizes", "url", "image"]


def csv_rows(catalog: DataFrame) -> DataFrame:
    """The export's nine columns of the active rows: whole prices, sizes joined by ``|``."""
    return catalog.where("active").withColumns({"price": F.floor("price"), "sizes": F.array_join("sizes", "|")}).select(*COLUMNS)


def write_csv(catalog: DataFrame, path: str) -> None:
    """Writes the export as CSV with a header that starts with a byte-order mark, for spreadsheets."""
    rows = csv_rows(catalog)
    rows.withColumnRenamed(COLUMNS[0], BOM + COLUMNS[0]).write.mode("overwrite").option("header", True).csv(path)


def json_page(page: DataFrame) -> DataFrame:
    """One JSON text for each row of a page."""
    return page.select(F.to_json(F.struct(*page.columns)).alias("json"))


def retain(payloads: DataFrame, new: DataFrame, keep: int = 10) -> DataFrame:
    """Payloads ``(id, payload)`` with the new valid ones appended; the last ``keep`` by id.

    A payload is valid if it holds a non-empty ``scores`` object and a ``tendencias`` object.
    """
    scores, trends = F.get_json_object("payload", "$.scores"), F.get_json_object("payload", "$.tendencias")
    good = scores.startswith("{") & (scores != "{}") & trends.startswith("{")
    last = Window.orderBy(F.col("id").desc())
    kept = payloads.unionByName(new.where(good)).orderBy(F.col("id").desc()).limit(keep)
    return kept.withColumn("place", F.row_number().over(last))
