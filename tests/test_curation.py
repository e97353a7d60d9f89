"""Labels, gates, classes and the remaining feeds."""

import json

from pyspark.sql import functions as F

from mercato.operators import curation
from mercato.sources import feeds


def test_labels_differ_in_words(spark):
    names = ["zapa nike air"] * 6 + ["nike zapa blanco"] * 5 + ["buzo frisa"] * 4 + ["de la"] * 3
    rows = [(k, n, {"z": 1, "n": 2, "b": 3, "d": 4}[n[0]]) for k, n in enumerate(names)]
    got = curation.cluster_labels(spark.createDataFrame(rows, "i int, name string, cluster int"))
    assert got == [(1, "Nike Air", 6), (2, "Nike", 5), (3, "Buzo", 4)]


def test_training_text(spark):
    rows = spark.createDataFrame([("Remera  ÁCIDA talle 42 negro de hombre xl",), (None,)], "n string")
    assert [r[0] for r in rows.select(curation.training_text(F.col("n"))).collect()] == ["remera acida de", ""]


def test_colour_and_presets(spark):
    pixels = [("a", 250, 250, 250)] * 3 + [("a", 0, 0, 0)] * 2 + [("b", 125, 60, 160)]
    got = {r.url: r.color for r in curation.dominant_colour(spark.createDataFrame(pixels, "url string, r int, g int, b int")).collect()}
    assert got == {"a": "blanco", "b": "violeta"}
    presets = spark.createDataFrame([(1, True), (2, False)], "id int, active boolean")
    assert {(r.id, r.active) for r in curation.activate(presets, 2).collect()} == {(1, False), (2, True)}
    assert {(r.id, r.active) for r in curation.activate(presets, 9).collect()} == {(1, True), (2, False)}


def test_remaining_feeds(spark):
    page = lambda p: spark.createDataFrame([("shop", "https://s", 1, p)], "site string, base_url string, page int, payload string")
    state = '<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"name":"A","link":"/a","price":10,"listPrice":12},{"name":"no price","link":"/b"}]}}</script>'
    assert [(r.url, r.name, r.price, r.original_price) for r in feeds.state_pages(page(state)).collect()] == [("https://s/a", "A", 10.0, 12.0)]
    card = '<div class="card card-ecommerce"><img src="/i.png"><h5 class="card-title x"> <a href="https://s/p">Mouse </a></h5><h6 id="tachado_1" class="t">$2.000,00</h6><span data-precio="1500.5"></span></div>'
    assert [(r.url, r.name, r.price, r.original_price, r.image) for r in feeds.commerce_cards(page(card + card)).collect()] == [("https://s/p", "Mouse", 1500.5, 2000.0, "https://s/i.png")]
    index = spark.createDataFrame([(json.dumps({"data": [["2024-01-01", 1.5], ["2024-02-01", 2], ["2024-02-01", 2]]}),), ("junk",)], "payload string")
    assert sorted((str(r.day), r.value) for r in feeds.index_series(index).collect()) == [("2024-01-01", 1.5), ("2024-02-01", 2.0)]
    found = {"results": [{"title": str(k), "price": k, "permalink": "l", "condition": "new"} for k in range(12)]}
    got = feeds.market_search(spark.createDataFrame([("u", json.dumps(found))], "url string, payload string")).collect()
    assert sorted(r.price for r in got) == [float(k) for k in range(1, 9)]
    sites = spark.createDataFrame([("A B", "https://x.myshopify.com"), ("C", "https://c"), ("D", "https://d")], "site string, url string")
    lookup = spark.createDataFrame([("d", "vtex"), ("c", "")], "site_key string, platform string")
    assert {(r.site, r.platform) for r in feeds.platform(sites, lookup).collect()} == {("A B", "shopify"), ("C", "tiendanube"), ("D", "vtex")}
