"""Progressive ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mercato.operators import upsert
from mercato.sources.keyed_store import KeyedStore

PRICE_STEP = 0.01


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Writer that gives every micro-batch to ``apply(batch, id)``, such as a partial upsert that writes the next snapshot.

    ``apply`` must be idempotent by id: after a failure a batch comes again.
    """
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def upserts(stream: DataFrame, first: DataFrame, folder: str) -> DataStreamWriter:
    """Writer that upserts every micro-batch of finished sites into the catalog.

    Batch k reads the snapshot of batch k - 1 in the shared ``folder`` (``first`` for k = 0) and writes
    its own beside it, so that a batch that comes again after a failure overwrites itself with the same
    rows. ``latest`` reads the newest; the caller removes old ones.
    """
    spark = first.sparkSession

    def apply(batch: DataFrame, k: int) -> None:
        current = spark.read.schema(first.schema).parquet(f"{folder}/snapshot/{k - 1}") if k else first
        upsert.upsert(current, batch).write.mode("overwrite").parquet(f"{folder}/snapshot/{k}")

    return ingest(stream, apply, f"{folder}/state")


def upserts_in_place(stream: DataFrame, store: KeyedStore, checkpoint: str) -> DataStreamWriter:
    """Writer that upserts every micro-batch into the buckets of ``store`` that it touches; a batch that comes again changes nothing."""
    return ingest(stream, lambda batch, _: store.upsert(batch), checkpoint)


def latest(first: DataFrame, folder: str, batches: int) -> DataFrame:
    """The catalog after so many micro-batches of ``upserts``."""
    return first.sparkSession.read.schema(first.schema).parquet(f"{folder}/snapshot/{batches - 1}") if batches else first


def once_a_day(prices: DataFrame, lateness: str = "2 days") -> DataFrame:
    """First price of each URL and day of ``prices(url, ts, price)``; older state than ``lateness`` is dropped."""
    return prices.withColumn("day", F.to_date("ts")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["url", "day"])


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "price"])
    out = []
    for ts, price in zip(rows["ts"], rows["price"], strict=True):
        if last is None or abs(price - last) > PRICE_STEP:
            out.append((key[0], ts, price))
            last = price
    state.update((last,))
    yield pd.DataFrame(out, columns=["url", "ts", "price"])


def changes_only(prices: DataFrame) -> DataFrame:
    """Rows of ``prices(url, ts, price)`` whose price differs from the URL's last by more than a cent. State: one price a URL."""
    return prices.groupBy("url").applyInPandasWithState(_changed, "url string, ts timestamp, price double", "last double", "append", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events by type and time window, with a watermark for late ones."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
