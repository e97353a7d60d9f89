"""Text, price, measure and financing functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from mercato.functions import measures, prices, text

PRICES = [
    # raw, catalog, listing, electronics, shop plugin
    ("$ 12.500,00", 12500.0, 12500.0, 12500.0, 12500.0),
    ("199.500", 199500.0, 199500.0, 199500.0, 199500.0),
    ("39990.00", 39990.0, 39990.0, 3999000.0, 39990.0),
    ("12,5", 12.5, 12.5, 12.5, 125.0),
    ("1.249.999", 1249999.0, 1249999.0, 1249999.0, 1249999.0),
    ("12.99", 12.99, 12.99, 1299.0, 12.99),
    ("NaN", None, None, None, None),
    ("", None, None, None, None),
    (None, None, None, None, None),
    ("999999999", None, 999999999.0, None, 999999999.0),
    ("ARS 209 175", 209175.0, 209175.0, 209175.0, 209175.0),
    ("0", None, None, None, None),
]


def test_price_dialects(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], "i int, raw string, a double, b double, c double, d double")
    got = rows.select("i", prices.local_price(F.col("raw")), prices.listing_price(F.col("raw")), prices.tech_price(F.col("raw")), prices.shop_price(F.col("raw"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [p[1:] for p in PRICES]


@pytest.mark.parametrize(
    ("name", "family", "amount"),
    [
        ("Proteína 1,5 kg", "mass", 1500.0),
        ("Creatina 1.000 g", "mass", 1000.0),
        ("Avena 0.500 kg", "mass", 500.0),
        ("Vitamina C 1000mg x 60 cápsulas", "count", 60.0),
        ("Bebida 500 ml", "volume", 500.0),
        ("30g de proteína, pote 1kg", "mass", 1000.0),
        ("Magnesio 400 mg", "unknown", 0.0),
        (None, "unknown", 0.0),
    ],
)
def test_package(spark, name, family, amount):
    row = spark.createDataFrame([(name,)], "n string").select(measures.package(F.col("n")).alias("p")).first().p
    assert (row.family, pytest.approx(row.amount)) == (family, amount)


def test_sizes_and_their_order(spark):
    row = spark.createDataFrame([(["small", "XL", "42", "talle unico", "S", "una talla larga", None],)], "s array<string>").select(text.sizes(F.col("s"))).first()[0]
    assert row == ["S", "XL", "42", "Único"]
    order = spark.createDataFrame([(s,) for s in ("44", "Único", "xl", "M", "38.5", "a")], "s string").orderBy(text.size_rank(F.col("s"))).collect()
    assert [r.s for r in order] == ["M", "xl", "38.5", "44", "a", "Único"]


def test_jaccard_of_empty_sets(spark):
    rows = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, ["a", "b"], ["b", "c"])], "i int, a array<string>, b array<string>")
    assert [r[0] for r in rows.orderBy("i").select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_identity(spark):
    row = spark.createDataFrame([("Remera", "Añil", "Camión-azul 42 modelo X")], "c string, b string, n string").select(text.identity(F.col("c"), F.col("b"), F.col("n"))).first()[0]
    assert row == "remera_anil_camion_modelo"


def test_query_is_cut_at_a_word(spark):
    long = "Zapatilla (nueva) talle 42 " + "palabra " * 20
    got = spark.createDataFrame([(long,)], "n string").select(text.search_query(F.col("n"))).first()[0]
    assert got.startswith("Zapatilla palabra") and len(got) <= 60 and not got.endswith("palabr")


def test_financing(spark):
    rows = [(100.0, 0.0, 12, 0.05), (100.0, 50.0, 3, 0.01), (100.0, 0.0, 0, 0.01), (100.0, 3.0, 3, 0.01)]
    got = spark.createDataFrame(rows, "p double, s double, n int, i double").select(prices.financing(*[F.col(c) for c in "psni"]).alias("f")).select("f.signal", "f.present_value").collect()
    assert [r.signal for r in got] == ["conviene_cuotas", "conviene_contado", "sin_datos", "indistinto"]
    assert got[0].present_value == pytest.approx(sum(100 / 12 / 1.05**k for k in range(1, 13)))
