"""Streams run to the end of what is there, beside the batch result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.plans.adapter import CATALOG, CATALOG_SQL, catalog
from mercato.session import shared_folder
from mercato.streaming import deadlines, ingest

QUERIES: dict = {}
ORACLES: dict = {}


def _to_the_end(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all input; each batch is written as Parquet in the session's shared folder.

    A batch that comes again after a failure overwrites itself. ``complete`` results replace each other.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: set[str] = set()

    def put(batch: DataFrame, k: int) -> None:
        path = f"{base}/out/{'all' if mode == 'complete' else k}"
        batch.write.mode("overwrite").parquet(path)
        written.add(path)

    ingest.ingest(df, put, f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(*sorted(written)) if written else spark.createDataFrame([], df.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _to_the_end(ingest.counts(_events(spark, sf_dir), "1 day"), "complete")
    return found.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n")


QUERIES["stream_counts"] = stream_counts
ORACLES["stream_counts"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def stream_first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("url"), "ts", F.col("value").alias("price"))
    return _to_the_end(ingest.once_a_day(prices, "60 days"), "append").select("url", F.col("day").cast("string").alias("day"))


QUERIES["stream_first_of_day"] = stream_first_of_day
ORACLES["stream_first_of_day"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS url, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _events(spark, sf_dir).where("value is not null").select(F.col("user_id").cast("string").alias("url"), "ts", (F.floor(F.col("value") * 10 + 0.5) / 10).alias("price"))
    found = _to_the_end(ingest.changes_only(prices), "append")
    return found.select("url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "price")


QUERIES["stream_changes"] = stream_changes
ORACLES["stream_changes"] = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS url, CAST(ts AS TIMESTAMP) AS ts, floor(value * 10 + 0.5) / 10 AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, floor(value * 10 + 0.5)) AS i FROM events WHERE value IS NOT NULL),
    r AS (SELECT url, i, ts, price AS last, true AS moved FROM e WHERE i = 1 UNION ALL SELECT e.url, e.i, e.ts, CASE WHEN abs(e.price - r.last) > 0.01 THEN e.price ELSE r.last END, abs(e.price - r.last) > 0.01 FROM r JOIN e ON e.url = r.url AND e.i = r.i + 1)
    SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, last AS price FROM r WHERE moved"""


_SNAPSHOT = ["url", "site", "name", "price", "category", "fit", "active", "locked_by"]


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = catalog(spark, sf_dir).where("seq % 4 <> 3").withColumn("locked_by", F.when(F.col("seq") % 10 == 1, F.lit("human"))).select(*_SNAPSHOT)
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/par[t].parquet").selectExpr(*CATALOG).where("seq % 3 = 0")
    batch = rows.selectExpr("url", "site", "name", "price + 5 AS price", "'new' AS category", "CASE WHEN seq % 2 = 0 THEN '' ELSE 'wide' END AS fit", "seq AS ord")
    folder = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    run = ingest.upserts(batch, first, folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return ingest.latest(first, folder, run.lastProgress["batchId"] + 1 if run.lastProgress else 0)


QUERIES["stream_upserts"] = stream_upserts
ORACLES["stream_upserts"] = f"""WITH {CATALOG_SQL}, r AS (SELECT *, seq % 3 = 0 AS hit, seq % 4 <> 3 AS old, CASE WHEN seq % 4 <> 3 AND seq % 10 = 1 THEN 'human' END AS locked_by FROM catalog WHERE seq % 3 = 0 OR seq % 4 <> 3)
    SELECT url, site, name, CASE WHEN hit THEN price + 5 ELSE price END AS price, CASE WHEN hit AND locked_by IS NULL THEN 'new' ELSE category END AS category, CASE WHEN NOT hit THEN fit WHEN seq % 2 = 1 THEN 'wide' WHEN old THEN fit ELSE '' END AS fit, hit OR active AS active, locked_by FROM r"""


def stream_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("site"), "ts")
    found = _to_the_end(deadlines.closed(rows, silence_s=12 * 3600, most_s=48 * 3600, lateness="1 hour"), "append")
    return found.select("site", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("opened", "last_seen", "closed_at")], "n", "reason")


QUERIES["stream_deadlines"] = stream_deadlines
ORACLES["stream_deadlines"] = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS site, CAST(ts AS TIMESTAMP) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    r AS (SELECT site, i, ts, ts AS opened, 1 AS n, false AS fresh FROM e WHERE i = 1 UNION ALL
      SELECT e.site, e.i, e.ts, CASE WHEN e.ts >= least(r.ts + INTERVAL 12 HOUR, r.opened + INTERVAL 48 HOUR) THEN e.ts ELSE r.opened END, CASE WHEN e.ts >= least(r.ts + INTERVAL 12 HOUR, r.opened + INTERVAL 48 HOUR) THEN 1 ELSE r.n + 1 END, e.ts >= least(r.ts + INTERVAL 12 HOUR, r.opened + INTERVAL 48 HOUR) FROM r JOIN e ON e.site = r.site AND e.i = r.i + 1),
    s AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY site ORDER BY i), true) AS ends, least(ts + INTERVAL 12 HOUR, opened + INTERVAL 48 HOUR) AS closed_at, lead(fresh) OVER (PARTITION BY site ORDER BY i) IS NULL AS is_last FROM r)
    SELECT site, strftime(opened, '%Y-%m-%d %H:%M:%S.%f') AS opened, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, strftime(closed_at, '%Y-%m-%d %H:%M:%S.%f') AS closed_at, n, CASE WHEN opened + INTERVAL 48 HOUR < ts + INTERVAL 12 HOUR THEN 'overdue' ELSE 'silent' END AS reason
    FROM s WHERE ends AND (NOT is_last OR epoch_ms(closed_at) < (SELECT epoch_ms(max(ts)) FROM e) - 3600000)"""
