"""The normaliser on hand-written names."""

import pytest
from pyspark.sql import functions as F

from mercato.functions import normalize as n

NAMES = [
    # name, raw category, category, gender, units, sub-category
    ("Remera Nike de hombre", None, "Remera", "hombre", 1, ""),
    ("Calza biker running", "x", "Calza", "mujer", 1, "running"),
    ("Pack x3 remeras lisas", None, "Remera", "", 3, ""),
    ("Combo remera + short", None, "Conjunto", "", 2, ""),
    ("3 boxers algodón", None, "Calzoncillos", "", 3, ""),
    ("Remera talle 36 a 46", None, "Remera", "", 1, ""),
    ("Whey protein 1kg", None, "Proteína", "", 1, ""),
    ("Granola 500 g", None, "Alimentos", "", 1, ""),
    ("Buzo con capucha niños", "Mujer", "Buzo", "infantil", 1, "hoodie"),
    ("Perfume 50 ml", "Remera", "Remera", "", 1, ""),
    ("Cosa rara", "Zapatillas > Urbanas", "Zapatilla", "", 1, ""),
    ("Cosa rara", None, "Otros", "", 1, ""),
    ("Gorro de lana", None, "Gorro", "", 1, "invierno"),
    ("Pack de 40 medias", None, "Medias", "", 1, ""),
    (None, None, "Otros", "", 1, ""),
    ("", "", "Otros", "", 1, ""),
]


def test_names(spark):
    schema = "i int, name string, category string, gender string, brand string, vertical string, site string, sizes array<string>"
    rows = spark.createDataFrame([(i, x[0], x[1], None, None, None, "Mi Tienda", ["small"]) for i, x in enumerate(NAMES)], schema)
    got = n.normalize(rows).orderBy("i").collect()
    assert [(r.name, r.category, r.gender, r.units, r.sub_category) for r in got] == [(x[0], *x[2:]) for x in NAMES]
    assert got[0].brand == "Nike" and got[0].sizes == ["S"] and got[6].vertical == "suplementos" and got[0].vertical == "indumentaria"
    assert got[11].brand == ""


@pytest.mark.parametrize("category", [*n.TECH, *n.SHOES, *n.TORSO, *n.LEGS, *n.UNDERWEAR, *n.ACCESSORIES, *n.SUPPLEMENTS])
def test_every_category_is_reachable(category):
    assert category in {c for c, _ in n.default_rules()}


def test_site_rules(spark):
    rows = spark.createDataFrame([("Cable", "PC Shop!"), ("Remera", "PC Shop!"), ("Remera gym", "Entreno")], "name string, site string").withColumns({c: F.lit(None).cast("string") for c in ("category", "gender", "brand", "vertical")}).withColumn("sizes", F.array().cast("array<string>"))
    sites = spark.createDataFrame([("pcshop", "tecnologia")], "site_key string, forced_vertical string")
    got = {(r.name, r.vertical, r.gym) for r in n.normalize(rows, sites=sites).collect()}
    assert got == {("Cable", "tecnologia", False), ("Remera", "indumentaria", False), ("Remera gym", "indumentaria", True)}
