"""The audit against its SQL, over whole tables and over rows that these don't hold."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.llm import divergence
from tools.compare import rows

ROWS = [
    ("The cat, the CAT; the dog", "en", "a"),
    ("the cat's dog\x00dog", "en", "b"),
    ("the bird", "en", "b"),
    ("\x00\x7f 123 __", "en", "c"),
    (None, None, None),
    ("", "", "x"),
    ("", "de", "a"),
    ("straße STRASSE Ärger ärger 日本 日本", "de", "b"),
    ("straße Ärger 日本", "de", "a"),
    ("straße Ärger 日本 " * 50, "de", "a"),
    ("straße Ärger 日本 ", "de", None),
    ("nothing kept here", "fr", "a"),
    ("", "fr", "b"),
    *[("same words same row", "es", "s")] * 3,
    ("same", "es", "t"),
    *[(f"hot w{k % 7} " * 40, "hot", f"s{k % 5}") for k in range(60)],
]


def by_sql(docs: pd.DataFrame) -> list:
    con = duckdb.connect()
    con.register("documents", docs)
    return rows(con.execute(divergence.SQL).df())


@pytest.mark.parametrize("shard,task", [(256_000, 4_000_000), (8, 50)])
def test_rows_of_every_kind(spark, monkeypatch, shard, task):
    """The second case deals terms to shards of a term or two and hot shards to many tasks."""
    monkeypatch.setattr(divergence, "SHARD_BYTES", shard)
    monkeypatch.setattr(divergence, "TASK_BYTES", task)
    monkeypatch.setattr(divergence, "HELD", 5 if shard == 8 else 300_000)
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "shard": F.lit(None)})
    got = rows(divergence.audit(docs.repartition(5)).toPandas())
    assert got == by_sql(pd.DataFrame(ROWS, columns=["text", "lang", "source"]))
    assert len(got) > 30


def test_empty_table_and_ranks(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    many = [(" ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)), "en", a) for a in "pq" for _ in range(3)]
    got = divergence.audit(spark.createDataFrame(many, "text string, lang string, source string")).toPandas()
    assert len(got[got["part"] == "term"]) == 400 and got["rank"].max() == 200
    assert rows(got) == by_sql(pd.DataFrame(many, columns=["text", "lang", "source"]))


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = rows(divergence.op12_source_divergence(spark, sf).toPandas())
    assert got == by_sql(pd.read_parquet(f"{sf}/documents.parquet"))


def test_terms_are_counted_up_to_the_least_and_then_passed_over(spark):
    """A task hands on three documents of a term, however many hold it; the weights hold every occurrence."""
    texts = [(f"Often often rare{chr(97 + k % 26)}{chr(97 + k // 26)} " + "pair " * (k < 2), "en", "a") for k in range(600)]
    docs = divergence.named(spark.createDataFrame(texts, "text string, lang string, source string")).coalesce(1)
    got = divergence.document_counts(docs).toPandas()
    found = got.dropna(subset=["term"]).set_index("term")["n"].to_dict()
    assert found["often"] == 3 and found["pair"] == 2 and len(found) == 602 and set(found.values()) == {1, 2, 3}
    assert got[got["term"].isna()]["n"].sum() == sum(len(w) + 1 for text, _, _ in texts for w in text.split())


@pytest.mark.parametrize("buckets", [4096, 4])
def test_terms_of_every_length_meet_in_their_shard(spark, monkeypatch, buckets):
    """Also terms that differ only in their middle, texts longer than a slice, and more shards than weighed parts."""
    monkeypatch.setattr(divergence, "SHARD_BYTES", 20)
    monkeypatch.setattr(divergence, "TASK_BYTES", 500_000)
    monkeypatch.setattr(divergence, "BUCKETS", buckets)
    monkeypatch.setattr(divergence, "GATHERED", 1000)
    letters = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop"
    words = [letters[:k] for k in range(1, 41)] + [f"samestart{m}sameends" for m in ("x", "y", "é", "日")] + ["é" * k for k in range(1, 12)]
    texts = [(" ".join(words[k % 3 :]), "en", f"s{k % 4}") for k in range(9)] + [("samestartxsameends " * 260_000, "en", "s0"), ("é", "", None)]
    docs = pd.DataFrame(texts, columns=["text", "lang", "source"])
    got = rows(divergence.audit(spark.createDataFrame(texts, "text string, lang string, source string").repartition(3)).toPandas())
    assert got == by_sql(docs) and len(got) > 100
