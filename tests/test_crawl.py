"""Discovery and page ends on written shops."""

import pytest
from pyspark.sql import functions as F

from mercato.sources.crawl import crawl, discover, listing_pages
from mercato.sources.feeds import vtex_search
from mercato.sources.paging import until_last, until_repeated, until_unlinked

A = "https://a.test"


def links(*paths):
    return "".join(f'<a href="{A}/{p}">x</a>' for p in paths)


def card(k, price="5.0"):
    return f'<div class="product-box"><a href="/p/{k}" onclick="enhancedClick({{&quot;name&quot;:&quot;n{k}&quot;,&quot;price&quot;:{price}}})"></a></div>'


PAGES = [
    ("a", f"{A}/", links("login", "one", "two/", "one", "", "other-shop.html", "deep/er") + '<a href="/relative">'),
    ("a", f"{A}/one", links("one/x", "one/y", "one", "two/z", "one/x/deeper") + '<a href="http://cdn.test/one/x-y">'),
    ("a", f"{A}/one/x", card(1) + card(2) + links("one/x/deeper")),
    ("a", f"{A}/one/x?page=2", card(2) + card(3)),
    ("a", f"{A}/one/x?page=3", card(1) + card(3)),
    ("a", f"{A}/one/x?page=4", card(9)),
    ("a", f"{A}/one/y", card(3) + card(4)),
    ("a", f"{A}/one/y?page=3", card(8)),
    ("a", f"{A}/two", card(4) + card(5) + card(6, "0")),
    ("a", f"{A}/two?page=2", None),
    ("a", f"{A}/two?page=3", card(7)),
    ("b", "https://b.test/z", card(1)),
    ("b", None, card(1)),
]


@pytest.fixture
def shop(spark):
    return spark.createDataFrame(PAGES, "site string, url string, payload string"), spark.createDataFrame([("a", A), ("b", "https://b.test/"), ("c", "https://c.test")], "site string, base_url string")


def test_tree(shop):
    got = {(r.site, r.url.removeprefix(A), r.leaf) for r in discover(*shop).collect()}
    assert got == {("a", "/one", False), ("a", "/two", True), ("a", "/one/x", True), ("a", "/one/y", True), ("a", "/one/x-y", True)}
    assert {r.url.removeprefix(A) for r in discover(*shop, depth=1).where("leaf").collect()} == {"/one", "/two"}
    deep = {(r.url.removeprefix(A), r.leaf) for r in discover(*shop, depth=9).collect()}
    assert {("/one/x/deeper", True), ("/one/x", False)} <= deep


def test_fallback_slugs_where_the_start_page_shows_none(spark, shop):
    fallback = spark.createDataFrame([("a", "unused"), ("b", "z")], "site string, slug string")
    got = {(r.site, r.url) for r in discover(*shop, fallback=fallback).where("leaf").collect()}
    assert ("b", "https://b.test/z") in got and not any("unused" in u for _, u in got)
    assert {r.url for r in crawl(*shop, fallback=fallback).where("site = 'b'").collect()} == {"https://b.test/p/1"}


def test_products_until_pages_repeat(shop):
    got = sorted((int(r.url.rsplit("/")[-1]), r.category, r.page) for r in crawl(*shop).collect())
    assert got == [(1, "X", 1), (2, "X", 1), (3, "X", 2), (4, "Y", 1), (5, "Two", 1)]


def test_long_leaves_are_read_to_their_end(spark):
    pages = [("l", f"{A}/", links("one")), *(("l", f"{A}/one?page={k}", card(k)) for k in range(2, 58)), ("l", f"{A}/one", card(1)), ("l", f"{A}/one?page=58", card(57)), ("l", f"{A}/one?page=59", card(99))]
    shop = spark.createDataFrame(pages, "site string, url string, payload string"), spark.createDataFrame([("l", A)], "site string, base_url string")
    got = lambda **more: sorted((int(r.url.rsplit("/")[-1]), r.page) for r in crawl(*shop, **more).collect())
    assert got() == [(k, k) for k in range(1, 58)]
    assert got(most_pages=3) == [(k, k) for k in range(1, 4)]


def test_empty_tables(spark, shop):
    assert discover(shop[0].limit(0), shop[1]).count() == 0
    assert crawl(shop[0], shop[1].limit(0)).count() == 0
    assert listing_pages(shop[0], discover(*shop).limit(0)).count() == 0


def test_ends_of_pages(spark):
    pages = [("s", p, last) for p, last in enumerate([3, None, 2, 9, 9], 1)] + [("t", 1, None), ("t", 2, 5)] + [("u", 2, 5)] + [("v", 1, 9), ("v", 3, 9)]
    df = spark.createDataFrame(pages, "site string, page int, last int")
    assert {(r.site, r.page) for r in until_last(df, F.col("last"), ["site"]).collect()} == {("s", 1), ("s", 2), ("s", 3), ("t", 1), ("v", 1)}
    links = [("s", 1, '<a href="/x?page=2">'), ("s", 2, '<a href="/x/page/7/">'), ("s", 3, '<a href="/x?page=3">'), ("s", 4, '<a href="?page=5">'), ("t", 1, None)]
    got = until_unlinked(spark.createDataFrame(links, "site string, page int, payload string"), ["site"]).collect()
    assert {(r.site, r.page) for r in got} == {("s", 1), ("s", 2), ("s", 3), ("t", 1)}
    items = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b"), ("s", 3, "b"), ("s", 4, "c"), ("t", 2, "a")], "site string, page int, url string")
    assert sorted((r.site, r.page, r.url) for r in until_repeated(items, ["site"]).collect()) == [("s", 1, "a"), ("s", 2, "a"), ("s", 2, "b")]


def test_search_pages_that_end_early(spark):
    body = '{"products":[{"productName":"n%d","linkText":"l%d","items":[{"sellers":[{"commertialOffer":{"Price":3}}]}]}],"pagination":{"last":{"index":2}}}'
    pages = [("s", "https://s", p, body % (p, p)) for p in (1, 2, 3)] + [("e", "https://e", 1, '{"products":[]}'), ("e", "https://e", 2, body % (2, 2)), ("x", "https://x", 1, "no json"), ("n", "https://n", 1, None)]
    df = spark.createDataFrame(pages, "site string, base_url string, page int, payload string")
    assert sorted((r.site, r.url, r.page) for r in vtex_search(df).collect()) == [("s", "https://s/l1/p", 1), ("s", "https://s/l2/p", 2)]
