"""The keyword cascade on written names, on every category and against a plain reading of its steps."""

import random

from pyspark.sql import functions as F

from mercato.functions import normalize as n
from mercato.operators import cascade
from mercato.operators.cascade import Cascade, Step, categorize, default_keywords, default_steps, group_hits, keyword_table
from mercato.plans import category_queries

NAMES = [
    # name, the shop's category, category
    ("Botin de futbol Copa", None, "Botines"),
    ("Copa de vidrio", None, "Otros"),
    ("Zapatillas Ace cancha", None, "Botines"),
    ("Timberland hiking", None, "Borcego"),
    ("Timberland reloj", None, "Otros"),
    ("Reef slide", None, "Ojotas"),
    ("Reef mochila", None, "Mochila"),
    ("Polo pique", None, "Chomba"),
    ("Polo medias", None, "Medias"),
    ("Remera y short", None, "Conjunto"),
    ("Traje con pantalón", None, "Traje"),
    ("Combo remera", None, "Conjunto"),
    ("Salsa creatina", None, "Creatina"),
    ("Salsa de remera", None, "Alimentos"),
    ("Remera proteína", None, "Remera"),
    ("Zapatillas running", None, "Zapatilla Running"),
    ("Zapatillas crossfit", None, "Zapatilla Entrenamiento"),
    ("Zapatillas de skate", None, "Zapatilla Skate"),
    ("Mochila running zapatilla", None, "Mochila"),
    ("Footwear 500 g", None, "Alimentos"),
    ("Footwear", None, "Zapatilla"),
    ("Collar de perro", "Remera", "Remera"),
    ("mi collar", None, "Otros"),
    ("collar", None, "Otros"),
    ("Cosa", "VCP > Abrigos / x", "Campera"),
    ("Cosa", "PC", "PC"),
    ("Cosa 2,5 kg", "nada", "Alimentos"),
    ("Cosa 2,5 kg", "porta cosas", "Otros"),
    (None, None, "Otros"),
    ("", "  ", "Otros"),
    ("Ñandú Pantalón", "x", "Pantalón"),
]


def test_written_names(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(NAMES)], "i int, name string, category string").withColumns({"text": F.lit("own"), "hits": F.lit(1)})
    got = {r.i: r.category for r in categorize(rows, cascade=Cascade(shops=("vcp",))).collect()}
    assert [(*x[:2], got[i]) for i, x in enumerate(NAMES)] == NAMES


def test_every_category_and_guard_is_reached(spark):
    got = {r.category for r in category_queries.category_cascade(spark, "/root/testdata/sf0.01").select("category").distinct().collect()}
    assert {s.category for s in default_steps()} <= got and len(got) >= 70
    assert {*n.TECH, *n.TORSO, *n.LEGS, *n.UNDERWEAR, *n.ACCESSORIES, *n.SUPPLEMENTS} <= got


def test_hits_are_those_of_plain_search(spark, monkeypatch):
    """Short, blank, overlapping and repeated keywords, more groups than one word of bits holds, and a table joined by shuffle."""
    rng = random.Random(4)
    keywords = [(f"g{rng.randint(0, 150)}", "".join(rng.choices("abñ ", k=rng.randint(1, 5)))) for _ in range(400)] + [("g1", ""), ("other", "ab")]
    texts = ["".join(rng.choices("abñÁ ", k=rng.randint(0, 12))) for _ in range(200)] + [None]
    groups = [f"g{k}" for k in range(151)]
    for most in (200_000, 5):
        monkeypatch.setattr(cascade, "SMALL_ROWS", most)
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        got = {r.text: {g for k, g in enumerate(groups) if r.hits[k // cascade.BITS] >> (k % cascade.BITS) & 1} for r in group_hits(df, keyword_table(df, keywords), groups).collect()}
        plain = lambda t: f" {t.lower().replace('ñ', 'n').replace('á', 'a')} "
        words = [(g, k.lower()) for g, k in keywords if k and g != "other"]
        assert got == {t: {g for g, k in words if k in plain(t)} for t in texts if t is not None}


def test_own_steps_and_empty_tables(spark):
    rows = spark.createDataFrame([("red shoe", None), ("shoe", "red"), ("car", None)], "name string, category string")
    keywords = keyword_table(rows, [("shoe", "shoe"), ("red", " red ")])
    rules = Cascade(steps=(Step("red shoe", (("shoe",), ("red",))), Step("plain shoe", (("shoe",),), ("red",))), aliases={}, not_textile=())
    assert [r.category for r in categorize(rows, keywords, rules, to="category").orderBy("name").collect()] == ["Otros", "red shoe", "plain shoe"]
    assert categorize(rows.limit(0)).count() == 0
    assert {g for g, _ in default_keywords()} >= {g for s in default_steps() for need in s.needs for g in need} - {"weight"}
