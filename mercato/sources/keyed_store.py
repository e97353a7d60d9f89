"""A catalog on disk that is laid out by product key, for lookups that read few files and writes that rewrite few.

Rows lie in folders by a hash bucket of their key, sorted by key, with a Bloom filter on it. A lookup
names its buckets, so that Spark opens these folders only, and passes the keys down to the Parquet reader. An
upsert reads and overwrites the buckets that its batch touches; all other files stay as they are.

Replaying a batch gives the same rows, so a write that broke off midway is mended by running it again. One
writer at a time: two upserts of one bucket at once would lose rows of one of them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.text import product_key
from mercato.operators import upsert

KEY, BUCKET = "product_key", "key_bucket"
#: Buckets whose numbers a batch of rows names in a filter; a batch that touches more of them reads all.
MOST_NAMED = 10_000


def bucket(key: Column, buckets: int) -> Column:
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def key_of(url: str) -> str:
    return hashlib.md5(url.encode()).hexdigest()[:16]


class KeyedStore:
    """Catalog rows in ``folder``; choose ``buckets`` so that one holds some 128 MB."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, schema: T.StructType | None = None):
        """``schema``: of the rows, for a store that may hold none."""
        self.spark, self.folder, self.buckets, self.schema = spark, folder.rstrip("/"), buckets, schema

    def _write(self, rows: DataFrame, mode: str) -> None:
        key = product_key(F.col("url"))
        laid = rows.withColumn(KEY, key).withColumn(BUCKET, bucket(F.col(KEY), self.buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, KEY)
        writer = laid.write.mode("overwrite").partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{KEY}", "true")
        writer.option("partitionOverwriteMode", mode).parquet(self.folder)

    def create(self, rows: DataFrame) -> KeyedStore:
        """Writes ``rows``, which have a URL each, in place of what the folder holds."""
        self.schema = rows.schema
        self._write(rows, "static")
        return self

    def laid_out(self) -> DataFrame:
        """All rows with their key and bucket."""
        reader = self.spark.read.option("basePath", self.folder)
        if self.schema:
            reader = reader.schema(T.StructType([*self.schema.fields, T.StructField(KEY, T.StringType()), T.StructField(BUCKET, T.IntegerType())]))
        return reader.parquet(self.folder)

    def read(self) -> DataFrame:
        return self.laid_out().drop(KEY, BUCKET)

    def by_keys(self, keys: list[str]) -> DataFrame:
        """The rows of product keys; unknown ones give none."""
        named = sorted({int(k[:8], 16) % self.buckets for k in keys})
        return self.laid_out().where(F.col(BUCKET).isin(named) & F.col(KEY).isin(sorted(set(keys)))).drop(KEY, BUCKET)

    def by_urls(self, urls: DataFrame) -> DataFrame:
        """The rows of a table of URLs, by join; buckets that it doesn't touch aren't read. Null and repeated URLs add nothing."""
        wanted = urls.where("url is not null").select("url").distinct().withColumn(KEY, product_key(F.col("url")))
        wanted = wanted.withColumn(BUCKET, bucket(F.col(KEY), self.buckets))
        return self._touched(wanted).join(wanted.select("url"), "url", "left_semi").drop(KEY, BUCKET)

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` lie in; the driver gets bucket numbers only."""
        named = self._numbers(rows) if self.buckets <= MOST_NAMED else None
        return self.laid_out() if named is None else self.laid_out().where(F.col(BUCKET).isin(named))

    def _placed(self, batch: DataFrame) -> DataFrame:
        return batch.where("coalesce(url, '') <> ''").withColumn(BUCKET, bucket(product_key(F.col("url")), self.buckets))

    def upsert(self, batch: DataFrame, with_visual: bool = True) -> None:
        """``operators.upsert.upsert`` of ``batch``, on the buckets that it touches."""
        current = self._touched(self._placed(batch)).drop(KEY, BUCKET)
        self._write(upsert.upsert(current, batch, with_visual), "dynamic")

    def soft_delete(self, batch: DataFrame) -> None:
        """Rows of the batch's sites whose URL it lacks become inactive; only buckets that hold such a row are written."""
        after = upsert.soft_delete(self.read(), batch)
        gone = self.laid_out().where("active").join(after.where("not active").select("url"), "url", "left_semi")
        named = self._numbers(gone)
        if named:
            current = self.laid_out().where(F.col(BUCKET).isin(named)).drop(KEY, BUCKET)
            self._write(upsert.soft_delete(current, batch), "dynamic")
