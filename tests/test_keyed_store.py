"""What the keyed store reads and rewrites."""

from pathlib import Path

import pytest

from mercato.sources.keyed_store import KeyedStore, key_of

SCHEMA = "url string, site string, name string, price double, active boolean, locked_by string"


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"u{k}", f"s{k % 3}", f"n{k}", float(k), True, None) for k in range(500)]
    return KeyedStore(spark, str(tmp_path / "store"), 16).create(spark.createDataFrame(rows, SCHEMA))


def files(store):
    return {p: p.stat().st_mtime_ns for p in Path(store.folder).rglob("*.parquet")}


def scanned(df):
    """Number of files that the scan of a query opens."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollectPublic()
    leaves, out = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get("numFiles")
        out += found.get().value() if found.isDefined() else 0
    return out


def test_a_lookup_opens_few_files(store):
    df = store.by_keys([key_of("u7")])
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "EqualTo(product_key" in plan
    assert [r.url for r in df.collect()] == ["u7"]
    assert scanned(df) == 1 and scanned(store.laid_out()) == len(files(store)) == 16
    assert store.by_keys([]).count() == 0 == store.by_keys([key_of("none")]).count()


def test_lookups_by_table(spark, store):
    urls = spark.createDataFrame([("u1",), ("u1",), (None,), ("x",), ("u400",)], "url string")
    assert sorted(r.url for r in store.by_urls(urls).collect()) == ["u1", "u400"]
    assert store.by_urls(urls.limit(0)).count() == 0


def test_an_upsert_leaves_untouched_buckets_alone(spark, store):
    before = files(store)
    batch = spark.createDataFrame([("u7", "s1", "new", 1.0, 1), ("new", "s1", "new", 2.0, 2), ("u7", "s1", "last", 3.0, 3), (None, "s1", "x", 1.0, 4)], "url string, site string, name string, price double, ord int")
    store.upsert(batch)
    after = files(store)
    buckets = {int(key_of(u)[:8], 16) % 16 for u in ("u7", "new")}
    changed = {int(p.parent.name.split("=")[1]) for p in before.keys() ^ after.keys()}
    assert changed == buckets and all(after[p] == t for p, t in before.items() if p in after)
    rows = {r.url: (r.name, r.price) for r in store.read().collect()}
    assert len(rows) == 501 and rows["u7"] == ("last", 3.0) and rows["new"] == ("new", 2.0) and rows["u8"] == ("n8", 8.0)
    store.upsert(batch)  # as after a failure
    assert {r.url: (r.name, r.price) for r in store.read().collect()} == rows


def test_soft_delete_writes_only_what_it_changes(spark, store):
    keep = store.read().where("site = 's1' and url <> 'u1'")
    before = files(store)
    store.soft_delete(spark.createDataFrame(keep.collect(), SCHEMA))
    after = files(store)
    assert {int(p.parent.name.split("=")[1]) for p in before.keys() ^ after.keys()} == {int(key_of("u1")[:8], 16) % 16}
    assert [r.url for r in store.read().where("not active").collect()] == ["u1"]
    before = files(store)
    store.soft_delete(spark.createDataFrame([], SCHEMA))
    assert files(store) == before


def test_an_empty_store_takes_rows(spark, tmp_path):
    empty = KeyedStore(spark, str(tmp_path / "empty"), 4).create(spark.createDataFrame([], SCHEMA))
    assert empty.read().count() == 0 and empty.by_keys([key_of("a")]).count() == 0
    empty.upsert(spark.createDataFrame([("a", "s", "n", 1.0, 1)], "url string, site string, name string, price double, ord int"))
    assert [(r.url, r.active) for r in empty.read().collect()] == [("a", True)]
