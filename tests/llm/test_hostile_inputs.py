"""Inputs that once crashed an executor, lost results or took time with the square of their length."""

import gc
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import ann, common, decontaminate, html_extract, toxicity, url_filter


def seconds(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


@pytest.mark.parametrize("tag", ["link", "meta"])
def test_long_and_unclosed_tags_of_links(spark, tag):
    href = 'rel="canonical" href="https://b.test/x"' if tag == "link" else 'http-equiv="refresh" content="0; url=https://b.test/x"'
    long, quoted = "a" * 1_000_000, '"' + ">" * 1_000_000 + '"'
    pages = [
        (1, "https://a.test/1", f"<{tag} {long} {href}>"),
        (2, "https://a.test/2", f"<{tag} title={quoted} {href}>"),
        (3, "https://a.test/3", f"<{tag} {href} {long}"),
        (4, "https://a.test/4", f'<{tag} {href} title="{long}'),
        (5, "https://a.test/5", f"<{tag} " + "'' " * 300_000 + f"{href}>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.src[-1] for r in url_filter.link_edges(df).collect()} == {"1", "2", "5"}


@pytest.mark.parametrize("size", [1e25, 1e-25, 1e150, 1e-150])
def test_vectors_of_any_magnitude_are_found(spark, size):
    x = np.random.default_rng(3).normal(size=(300, 8)) * size
    x[7] *= 1e-3
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "shard": F.lit("own")})
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        scores = x @ x[q]
        want = [v for v in np.lexsort((np.arange(300), -scores)).tolist() if v != q][:20]
        found = sorted(got[q])
        hits += len({v for _, v, _ in found} & set(want))
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([s for _, _, s in found], scores[[v for _, v, _ in found]], rtol=1e-12)
    assert hits >= 0.9 * 15 * 20


def test_benchmark_items_without_an_id_count(spark):
    item = "which of these seven quiet rivers carries the oldest copper bridge across its northern bend today"
    other = "name the plant that closes all of its leaves whenever an unexpected shadow falls on them"
    docs = spark.createDataFrame([(1, f"intro words {item} more words"), (2, "clean words only"), (3, f"x {other} y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (5, other)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.contaminated) for r in decontaminate.judge(docs, bench).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: (5, True)}
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [2]


@pytest.fixture
def split(spark):
    """Settings under which Spark splits any partition of a join that has more rows than others."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_text_that_stands_very_often_is_no_single_task(spark, split):
    """The joins of rows with scores can be split; before, the scores were summed up in the stage of the join."""
    item = "which of these seven quiet rivers carries the oldest copper bridge across its northern bend today"
    docs = spark.range(40_000).selectExpr("id doc_id", f"if(id % 2 = 0, 'see {item}', concat('clean text ', id)) text").repartition(8)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    judged, left = decontaminate.judge(docs, bench), decontaminate.drop_leaks(docs, bench)
    assert {(r.doc_id, r.item_id, r.contaminated) for r in judged.collect()} == {(k, None if k % 2 else 7, k % 2 == 0) for k in range(40_000)}
    assert sorted(r.doc_id for r in left.collect()) == list(range(1, 40_000, 2))
    for df in judged, left:
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_one_node_are_no_single_task(spark, split):
    """The minima of nodes are written before they are joined; in one stage with the join, they kept Spark from splitting it."""
    links = spark.range(1, 60_001).selectExpr("id hi", "if(id % 3 = 0, id - 1, 0) lo").repartition(8)
    star = common._large_star(links, hubs=True)
    assert {(r.hi, r.lo) for r in star.collect()} == {(k, 0) for k in range(1, 60_001)}
    assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()
    found = {r.node: r.component for r in common.components(links.toDF("src", "dst"), hubs=True).collect()}
    assert found == dict.fromkeys(range(60_001), 0)


@pytest.mark.parametrize("pattern", [[1.0, -1.5], [1.0, -0.5], [1.0, -1.0, 2.0, -3.0]])
def test_time_of_segments_grows_with_the_text(pattern):
    assert seconds(toxicity.segments, np.tile(pattern, 200_000)) < 2 * 4 * max(seconds(toxicity.segments, np.tile(pattern, 50_000)), 0.05)


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<svg>x", "<div>x</p>", "<script ", "<!-- x -->", "</section>x"])
def test_time_of_the_parser_grows_with_the_page(piece):
    took = seconds(html_extract.leaf_blocks, piece * (1_000_000 // len(piece)))
    assert took < 2 * 4 * max(seconds(html_extract.leaf_blocks, piece * (250_000 // len(piece))), 0.05)


@pytest.mark.parametrize("piece", ["<div>x", "<div class=nav>x<section>y", "<p>x", "<div>x</div>"])
def test_parser_holds_one_container_a_block(piece):
    """Beside a large heap, collections of cycles made the time of nested tags grow faster than the page."""
    page = piece * 20_000
    html_extract.leaf_blocks(page)
    gc.collect()
    gc.disable()
    try:
        before = gc.get_count()[0]
        blocks = html_extract.leaf_blocks(page)
        held = gc.get_count()[0] - before
    finally:
        gc.enable()
    assert len(blocks) >= 20_000 and held < 1.1 * len(blocks)
    assert len({id(path) for path, _, _ in blocks}) <= 4


def test_comments_that_never_end():
    texts = lambda page: [t for _, t, _ in html_extract.leaf_blocks(page)]
    assert texts("<p>a</p>b<!-- c <p>d</p> e") == ["a", "b"]
    assert texts("<p>a</p>b<!-- c") == ["a", "b"]
    assert texts("<p>a</p>b <i d") == ["a", "b <i d"]
    assert texts("<p>a<!-- c -->b</p> <!--> d") == ["ab"]
