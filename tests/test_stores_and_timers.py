"""What the feed store reads, how a broken backfill goes on, when runs are closed."""

import datetime
import re
import struct
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mercato.operators.backfill import EmbeddingCache
from mercato.sources.feed_store import FeedStore
from mercato.streaming import deadlines

FEED = "site string, url string, name string, price double"


def scanned(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollectPublic()
    leaves, out = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get("numFiles")
        out += found.get().value() if found.isDefined() else 0
    return out


@pytest.fixture
def feeds(spark, tmp_path):
    rows = [(f"s{k % 5}" if k % 3 else "hot", f"u{k}", f"n{k}", float(k)) for k in range(600)]
    return FeedStore(spark, str(tmp_path / "feeds")).put(spark.createDataFrame(rows, FEED)), rows


def test_filters_choose_folders_and_reach_the_reader(feeds):
    store, rows = feeds
    df = store.read(["s1", "s4"], 100.0, 140.0)
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*site#\d+ IN", plan)
    assert "GreaterThanOrEqual(price,100.0)" in plan and "LessThanOrEqual(price,140.0)" in plan
    assert {(r.site, r.url) for r in df.collect()} == {(s, u) for s, u, _, p in rows if s in ("s1", "s4") and 100 <= p <= 140}
    assert scanned(df) < scanned(store.all())
    assert store.read().count() == 600 and store.read([]).count() == 0 and store.read(low=590.0).count() == 10


def test_a_hot_site_is_split_over_files_by_price(spark, feeds):
    store, rows = feeds
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows together
    try:
        store.put(spark.createDataFrame(rows, FEED))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(list((Path(store.folder) / "site=hot").glob("*.parquet")))
    assert files > 1 and scanned(store.read(["hot"], high=20.0)) == files  # files are skipped by their statistics when they are opened
    assert store.read().count() == 600


def test_only_the_sites_of_a_batch_are_replaced(spark, feeds):
    store, _ = feeds
    before = {p: p.stat().st_mtime_ns for p in Path(store.folder).glob("site=s[0-4]/*.parquet") if p.parent.name != "site=s1"}
    batch = spark.createDataFrame([("s1", "new", "n", 1.0), (None, "lost", "n", 2.0)], FEED)
    for _ in range(2):
        store.put(batch)
        assert [r.url for r in store.read(["s1"]).collect()] == ["new"]
        assert [r.url for r in store.all().where("site is null").collect()] == ["lost"]
    assert {p: p.stat().st_mtime_ns for p in before} == before


CATALOG = "url string, image string, active boolean"


def encoder(broken=(), calls=None):
    """Vectors of the image's length and its first byte; raises on ``broken`` images, gives none for 'x'."""

    def load():
        def encode(images):
            if set(images) & set(broken):
                raise RuntimeError("no such image")
            return [None if x == "x" else (float(len(x)), float(x.encode()[0])) for x in images]

        return encode

    return load


def test_a_broken_backfill_goes_on_where_it_stopped(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    rows = [(f"u{k}", f"i{k}", True) for k in range(60)] + [("off", "i", False), ("bare", " ", True), (None, "i", True), ("bad", "x", True), ("u1", "i1", True)]
    catalog = spark.createDataFrame(rows, CATALOG)
    # The last wave of the run holds a broken image.
    last = catalog.where("active and url like 'u%' and pmod(xxhash64(url), 7) = 6").select("image").first().image
    with pytest.raises(Exception, match="no such image"):
        cache.backfill(catalog, encoder([last]), "v1", wave_rows=9)
    kept = {r.url for r in cache.read().collect()}
    assert 0 < len(kept) < 60
    files = {p: p.stat().st_mtime_ns for p in Path(cache.folder).glob("*.parquet")}
    assert cache.backfill(catalog, encoder(), "v1", wave_rows=9) >= 1
    assert {p: p.stat().st_mtime_ns for p in files} == files
    found = {r.url: struct.unpack("<2f", bytes(r.embedding)) for r in cache.current("v1").collect()}
    assert found == {f"u{k}": (float(len(f"i{k}")), 105.0) for k in range(60)} and cache.read().count() == 60
    assert cache.backfill(catalog, encoder(), "v1", wave_rows=9) == 1 and cache.read().count() == 60  # only the one that has no vector
    cache.backfill(catalog, encoder(), "v2")
    assert cache.current("v2").count() == 60 and cache.current("v1").count() == 60


def test_a_backfill_of_nothing(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "none"))
    assert cache.backfill(spark.createDataFrame([], CATALOG), encoder(), "v1") == 0 and cache.current("v1").count() == 0


def run_stream(spark, tmp_path, batches, **params):
    """Closed runs after each file of ``batches`` (site, minutes) has been a micro-batch of its own."""
    start = datetime.datetime(2024, 1, 1)
    folder = tmp_path / "in"
    for k, batch in enumerate(batches):
        rows = [(s, None if m is None else start + datetime.timedelta(minutes=m)) for s, m in batch]
        spark.createDataFrame(rows, "site string, ts timestamp").coalesce(1).write.parquet(f"{folder}/b={k}")
    stream = spark.readStream.schema("site string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")
    name = f"t{uuid.uuid4().hex}"
    found = deadlines.closed(stream, **params)
    found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    minute = lambda c: ((F.unix_micros(c) - F.unix_micros(F.lit(start))) / 60_000_000).cast("int")
    rows = spark.table(name).select("site", minute("opened"), minute("last_seen"), minute("closed_at"), "n", "reason")
    return sorted(tuple(r) for r in rows.collect())


def test_silent_and_overdue_runs_are_closed_by_timers(spark, tmp_path):
    batches = [[("a", 0), ("b", 0), ("a", 5), (None, 3), ("c", None)], [("b", 8), ("a", 9)], [("b", 16), ("d", 200)], [("d", 205)]]
    found = run_stream(spark, tmp_path, batches, silence_s=600, most_s=1200, lateness="1 minute")
    assert found == [("a", 0, 9, 19, 3, "silent"), ("b", 0, 16, 20, 3, "overdue")]


def test_a_later_row_opens_the_next_run(spark, tmp_path):
    found = run_stream(spark, tmp_path, [[("a", 0), ("a", 10), ("a", 11)], [("a", 40), ("z", 300)]], silence_s=600, most_s=36000, lateness="1 minute")
    assert found == [("a", 0, 0, 10, 1, "silent"), ("a", 10, 11, 21, 2, "silent"), ("a", 40, 40, 50, 1, "silent")]
