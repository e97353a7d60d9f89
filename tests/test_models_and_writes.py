"""Overrides by guesses, backfills, guards and outfits on small inputs."""

import pytest

from mercato.operators import classify, optimize, upsert
from mercato.sources import feeds

GENERIC = ["Otros"]


@pytest.mark.parametrize(
    ("category", "text", "text_sure", "image", "image_sure", "want"),
    [
        ("Otros", "Remera", 0.85, None, None, "Remera"),  # generic: sure enough
        ("Otros", "Remera", 0.81, None, None, "Otros"),
        ("Remera", "Buzo", 0.85, None, None, "Remera"),  # telling: surer still
        ("Remera", "Buzo", 0.93, None, None, "Buzo"),
        ("Remera", "Zapatilla", 0.99, None, None, "Remera"),  # another kind
        ("Remera", "Algo", 0.99, None, None, "Algo"),  # no kind
        ("Zapatilla Running", "Zapatilla", 0.99, None, None, "Zapatilla Running"),  # its parent
        ("Conjunto", "Remera", 0.99, None, None, "Conjunto"),
        ("Remera", "Buzo", 0.80, "Campera", 0.95, "Remera"),  # text was sure, so the image may not
        ("Remera", "Buzo", 0.70, "Campera", 0.95, "Campera"),
        ("Remera", "Buzo", 0.70, "Sweater", 0.95, "Remera"),  # a label that the text model lacks
        (None, "Remera", 0.85, "", None, "Remera"),
        (None, None, None, None, None, None),
        ("Otros", "", 0.99, None, 0.99, "Otros"),
    ],
)
def test_ensemble(spark, category, text, text_sure, image, image_sure, want):
    rows = spark.createDataFrame([(category, text, text_sure, image, image_sure)], "category string, text_guess string, text_confidence double, image_guess string, image_confidence double")
    got = classify.ensemble(rows, GENERIC, ["Remera", "Buzo", "Campera"]).first()
    assert got.category == want
    assert (got.category_before is None) == (want == category)


def test_catalog_is_emptied_only_without_favourites(spark):
    catalog = spark.createDataFrame([("a",), ("b",)], "url string")
    with pytest.raises(upsert.ProtectedRows, match="1 favourites"):
        upsert.emptied(catalog, spark.createDataFrame([("a",), ("gone",)], "url string"))
    assert upsert.emptied(catalog, spark.createDataFrame([("gone",)], "url string")).count() == 0


def test_backfills_keep_nulls(spark):
    rows = spark.createDataFrame([("a", None, None, "S"), ("b", "Coat", "S", "S"), ("c", "x", "T", "T")], "url string, category string, brand string, site string")
    assert [r.category for r in upsert.renamed_values(rows, "category", {"Coat": "Campera"}).orderBy("url").collect()] == [None, "Campera", "x"]
    assert [r.category for r in upsert.renamed_values(rows, "category", {}).orderBy("url").collect()] == [None, "Coat", "x"]
    assert [r.brand for r in upsert.without_site_brands(rows, ["T"]).orderBy("url").collect()] == [None, "", "T"]
    lists = spark.createDataFrame([("a", ["", "M", None]), ("b", None)], "url string, sizes array<string>")
    assert [tuple(r) for r in upsert.child_rows(lists, "sizes", "size").collect()] == [("a", 2, "M")]


def test_index_falls_back_to_the_second_source(spark):
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "payload string")
    first, second = '{"data": [["2024-01-01", 1.0], ["2024-02-01", 2.0]]}', '[{"fecha": "2024-01-01", "valor": 5.0}, {"fecha": "2024-03-01", "valor": 6.0}]'
    values = lambda df: sorted(r.value for r in df.collect())
    assert values(feeds.index_series(texts(first), texts(second))) == [1.0, 2.0]
    assert values(feeds.index_series(texts("broken", '{"data": [["2024-01-01", 1.0]]}'), texts(second))) == [5.0, 6.0]
    assert values(feeds.index_series(texts(None, ""), texts("[]"))) == []


def candidates(**more):
    return [optimize.Candidate(s, f"{s}{k}", 10.0 + k, 50.0, **more) for s in "ab" for k in range(30)]


def test_outfit_steps_down_and_may_go_beyond_the_budget():
    pick = lambda cs, budget=0.0, **kw: optimize.weighted_outfit(cs, budget, ["a", "b"], 3, **kw)
    assert all(abs(c.price - 25) <= 7.5 for c in pick(candidates()))
    assert [c.slot for c in pick(candidates(), gender="mujer", optional=("c",))] == ["a", "b"]
    assert pick(candidates(gender="hombre"), gender="mujer") == []
    assert pick(candidates(), 5.0) == [] and len(pick(candidates(), 5.0, complete=True)) == 2


def test_likes_and_scores_weigh_within_bounds():
    c = lambda **kw: optimize.Candidate("a", "u", 10.0, kw.pop("score", 50.0), **kw)
    weight = lambda x: optimize.pick_weight(x, [], 10.0, 3.0)
    assert weight(c()) == 1.0 and weight(c(likes=2)) == 3.0 and weight(c(likes=9)) == 4.0
    assert weight(c(score=1000.0)) == 2.5 and weight(c(score=-4.0)) == 0.5
