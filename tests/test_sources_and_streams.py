"""Feeds from payload text, exports, and streams that equal the batch."""

import datetime
import json

from pyspark.sql import functions as F

from mercato.sources import feeds, sinks
from mercato.streaming import ingest

PAGES = "site string, base_url string, page int, payload string"


def pages(spark, *payloads):
    return spark.createDataFrame([("shop", "https://shop.example", k + 1, p) for k, p in enumerate(payloads)], PAGES)


def test_shopify_stops_after_the_first_short_page(spark):
    item = lambda h, price: {"title": h.upper(), "handle": h, "product_type": "Remera", "options": [{"name": "Talle", "values": ["S", "M"]}], "variants": [{"price": price, "compare_at_price": "20.00", "option1": "S"}, {"price": "1", "option1": "M"}], "images": [{"src": "//i/1.jpg"}]}
    got = feeds.shopify(pages(spark, json.dumps({"products": [item("a", "10.50"), item("b", "11.00")]}), json.dumps({"products": [item("c", "9.00")]}), json.dumps({"products": [item("late", "9.00")]})), per_page=2).orderBy("url").collect()
    assert [(r.url, r.price, r.original_price, r.sizes) for r in got] == [("https://shop.example/products/a", 10.5, 20.0, ["S", "M"]), ("https://shop.example/products/b", 11.0, 20.0, ["S", "M"]), ("https://shop.example/products/c", 9.0, 20.0, ["S", "M"])]


def test_search_api(spark):
    item = {"productName": "P", "linkText": "p-1", "categories": ["/Ropa/Remeras/", "/Ropa/"], "items": [{"images": [{"imageUrl": "i"}], "sellers": [{"commertialOffer": {"Price": 0, "ListPrice": 5}}, {"commertialOffer": {"Price": 4, "ListPrice": 5}}]}]}
    row = feeds.vtex(pages(spark, json.dumps([item, {"productName": "no offer", "linkText": "x", "items": []}]))).collect()
    assert [(r.url, r.price, r.original_price, r.category) for r in row] == [("https://shop.example/p-1/p", 4.0, 5.0, "Ropa")]


def test_store_api_and_cards(spark):
    item = {"name": "N", "canonical_url": "https://x/n", "categories": [{"name": "C"}], "images": [{"src": "https://x/i-100x100.jpg"}], "variants": [{"price": "1.200,50", "compare_at_price": None, "values": ["unique"]}]}
    row = feeds.tiendanube(pages(spark, json.dumps([item]))).first()
    assert (row.price, row.image, row.sizes) == (1200.5, "https://x/i.jpg", [])
    html = '<div class="product-box"><a href="/a" onclick="enhancedClick({&quot;id&quot;:&quot;1&quot;,&quot;name&quot;:&quot;A&quot;,&quot;category&quot;:&quot;GPU&quot;,&quot;price&quot;:9.5})"><img src="i.png"></a></div>'
    got = feeds.product_cards(pages(spark, html, html)).collect()
    assert [(r.url, r.name, r.price, r.category) for r in got] == [("https://shop.example/a", "A", 9.5, "GPU")]
    plugin = '<ul><li class="product x"><a href="u"><img src="i"><h2 class="t">T <b>x</b></h2></a><del><bdi>$2.000,00</bdi></del><ins><bdi>$1.500,00</bdi></ins></li></ul>'
    r = feeds.plugin_cards(pages(spark, plugin)).first()
    assert (r.name, r.price, r.original_price) == ("T x", 1500.0, 2000.0)


def test_state_pages_find_nested_products(spark):
    product = {"name": "A", "link": "/a", "price": {"value": 7.5}, "listPrice": 9, "images": [{"url": "i"}], "brand": {"name": "B", "link": "/b", "price": 1}}
    state = {"props": {"name": "page", "rows": [[{"item": product}], {"name": "no price", "link": "/x"}, {"name": "", "url": "/y", "price": 1}]}}
    page = lambda text: f'<script id="__NEXT_DATA__" type="application/json">{text}</script>'
    got = feeds.state_pages(pages(spark, page(json.dumps(state)), page("{broken"), "no state", None)).collect()
    assert [(r.url, r.name, r.price, r.original_price, r.image) for r in got] == [("https://shop.example/a", "A", 7.5, 9.0, "i")]


def test_rpc_and_three_feeds(spark):
    inner = {"scName": "Mouse", "data": {"page": 1, "pagesTotal": 1, "items": [{"item_id": 3, "item_desc": "Mouse Óptico", "prli_price": "1.234", "strikeThroughPrice_original": 2.0}]}}
    r = feeds.rpc_store(pages(spark, json.dumps({"d": json.dumps(inner)}))).first()
    assert (r.url, r.price, r.original_price, r.category) == ("https://shop.example/mouse-optico/3", 1.234, 2.0, "Mouse")
    products = spark.createDataFrame(
        [(1, "Placa", 10, 20, 30, 100.0, 80.0, None, [("b.png", 2), ("a.png", 1)], 3, True), (2, "Sin stock", 10, 20, 30, 1.0, 1.0, None, [], 0, True)],
        "id_producto int, nombre string, id_categoria int, id_subcategoria int, id_marca int, precioLista double, precioEspecial double, precioListaAnterior double, imagenes array<struct<nombre:string,orden:int>>, stock int, vendible boolean",
    )
    cats = spark.createDataFrame([(10, "Comp"), (20, "GPU")], "id int, nombre string")
    brands = spark.createDataFrame([(30, "Acme")], "id int, nombre string")
    got = feeds.three_feeds(products, cats, brands, "s", "https://s").collect()
    assert [(r.price, r.original_price, r.category, r.brand, r.image) for r in got] == [(80.0, 100.0, "GPU", "Acme", "a.png")]


def test_csv_export_has_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("n", 1.9, "s", "c", "g", "b", ["S", "M"], "u", "i", True)], "name string, price double, site string, category string, gender string, brand string, sizes array<string>, url string, image string, active boolean")
    sinks.write_csv(rows, str(tmp_path / "out"))
    texts = [p.read_text() for p in (tmp_path / "out").glob("part-*")]
    assert all(t.startswith("﻿") for t in texts if t) and "n,1,s,c,g,b,S|M,u,i" in "".join(texts)


def test_payload_retention(spark):
    old = spark.createDataFrame([(k, "{}") for k in range(12)], "id int, payload string")
    new = spark.createDataFrame([(12, '{"scores":{"a":1},"tendencias":{}}'), (13, '{"scores":{},"tendencias":{}}'), (14, "junk")], "id int, payload string")
    assert sorted(r.id for r in sinks.retain(old, new, 10).collect()) == list(range(3, 13))


def test_streams_equal_the_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    first = [("a", start, 10.0), ("a", start + datetime.timedelta(hours=1), 10.005), ("b", start, 5.0)]
    second = [("a", start + datetime.timedelta(days=1), 12.0), ("b", start + datetime.timedelta(hours=2), 6.0), ("b", start + datetime.timedelta(hours=3), 6.0)]
    schema = "url string, ts timestamp, price double"
    source = tmp_path / "in"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    changes = ingest.changes_only(stream()).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    changes.awaitTermination(120)
    got = sorted((r.url, r.price) for r in spark.table("changes").collect())
    assert got in ([("a", 10.0), ("a", 12.0), ("b", 5.0), ("b", 6.0)],)

    daily = ingest.once_a_day(stream()).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    daily.awaitTermination(120)
    assert sorted((r.url, str(r.day)) for r in spark.table("daily").collect()) == [("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01")]

    seen = []
    ingest.ingest(stream(), lambda batch, k: seen.append(batch.count()), str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == 6
    assert ingest.counts(spark.createDataFrame([(start, "x", 1.0)], "ts timestamp, event_type string, value double").withColumn("n", F.lit(1))).count() == 1
