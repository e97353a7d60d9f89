"""Parsed feeds on disk, laid out so that filters on site and price choose what is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class FeedStore:
    """Rows of ``sources.feeds`` in ``folder``: a folder for each site, files that hold a range of prices each, sorted."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | None = None):
        """``schema``: of the rows, for a store that another session wrote or that may hold none."""
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def put(self, rows: DataFrame) -> FeedStore:
        """Writes the newest rows of each site that ``rows`` names in place of its old ones; other sites stay as they are.

        Dealing by ranges of site and price splits a site that holds a third of all rows over many tasks.
        Repeating a write gives the same rows. Rows without a site lie in a folder of their own.
        """
        self.schema = StructType([*[f for f in rows.schema if f.name != "site"], rows.schema["site"]])
        laid = rows.repartitionByRange("site", "price").sortWithinPartitions("site", "price")
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(self.folder)
        return self

    def all(self) -> DataFrame:
        reader = self.spark.read.option("basePath", self.folder)
        return (reader.schema(self.schema) if self.schema else reader).parquet(self.folder)

    def read(self, sites: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
        """Rows of these sites with a price in the range, ends included; None asks for no limit.

        The sites choose folders; the prices reach the Parquet reader, which skips files and row groups.
        """
        rows = self.all()
        rows = rows if sites is None else rows.where(F.col("site").isin(sites))
        rows = rows if low is None else rows.where(F.col("price") >= low)
        return rows if high is None else rows.where(F.col("price") <= high)
