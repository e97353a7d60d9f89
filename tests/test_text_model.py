"""Grams, split and held-out accuracy of the text classifier."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from mercato.operators import text_model


def plain_grams(text):
    out = []
    for w in text.lower().translate(str.maketrans("áéíóúñ", "aeioun")).split():
        w = f" {w} "
        for n in range(2, 6):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
            if len(w) <= n:
                break
    return out


def test_grams_stay_within_words(spark):
    texts = ["Ñandú a zapatilla", "a", "  ", "", "ab  cd\tÁ", "x" * 40]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.g for r in df.select("t", text_model.word_grams(F.col("t")).alias("g")).collect()}
    assert got.pop(None) == []
    assert {t: Counter(g) for t, g in got.items()} == {t: Counter(plain_grams(t)) for t in texts}


def test_split_is_exact_in_every_class(spark):
    rng = random.Random(2)
    rows = [(f"u{k}", rng.choices(["big", "mid", "two", None], [100, 20, 1, 2])[0]) for k in range(3000)] + [("one", "one"), ("a", "pair"), ("b", "pair")]
    got = text_model.stratified(spark.createDataFrame(rows, "url string, category string")).collect()
    assert sorted((r.url, r.category or "") for r in got) == sorted((u, c or "") for u, c in rows)
    by = {}
    for u, c in rows:
        by.setdefault(c, []).append(u)
    for c, urls in by.items():
        n = len(urls)
        k = max(1, int(n * 0.2 + 0.5)) if n > 1 else 0
        assert {r.url for r in got if r.category == c and r.held_out} == set(sorted(urls, key=lambda u: hashlib.md5(u.encode()).hexdigest())[:k])
    assert text_model.stratified(spark.createDataFrame([], "url string, category string")).count() == 0


def test_held_out_names_are_guessed(spark):
    rng = random.Random(1)
    kinds = {"Remera": ["remera", "camiseta"], "Zapatilla": ["zapatilla", "zapatillas"], "Mochila": ["mochila", "mochilas"], "Gorra": ["gorra", "gorras"]}
    words = ["azul", "rojo", "larga", "nueva", "oversize", "deportiva", "clasica", "urbana", "talle", "negra"]

    def name(c):
        w = rng.choice(kinds[c])
        if rng.random() < 0.2:  # a typing mistake
            k = rng.randrange(1, len(w))
            w = w[:k] + w[k + 1 :]
        return " ".join([*rng.sample(words, 2), w, *rng.sample(words, 1)])

    rows = [(f"u{k}", name(c), c) for k in range(600) for c in [rng.choice(list(kinds))]]
    split = text_model.stratified(spark.createDataFrame(rows, "url string, name string, category string")).cache()
    model = text_model.fit(split.where("not held_out"))
    judged = text_model.predict(model, split.where("held_out")).cache()
    total = text_model.report(judged).agg(F.sum("n").alias("n"), F.sum("guessed").alias("guessed"), F.sum("right").alias("right")).first()
    assert total.n == split.where("held_out").count() and total.guessed >= 0.9 * total.n and total.right >= 0.97 * total.guessed
    assert judged.where("confidence < 0.7 and guess is not null").count() == 0
    odd = spark.createDataFrame([("x", "q9q9 w8w8"), ("y", None), ("z", "mochila azul")], "url string, name string").withColumn("guess", F.lit(1))
    got = {r.url: (r.guess, r.confidence is None) for r in text_model.predict(model, odd).collect()}
    assert got == {"x": (None, True), "y": (None, True), "z": ("Mochila", False)}


def test_names_that_repeat_are_worked_on_once(spark):
    rng = random.Random(4)
    names = {"gorra azul": "Gorra", "gorra roja": "Gorra", "mochila azul": "Mochila", "mochila negra": "Mochila", "bolso azul": "Mochila", "bolso rojo": "Gorra"}
    picked = rng.choices(list(names), [9, 1, 5, 3, 2, 2], k=600)
    rows = [(f"u{k}", n, "Gorra" if k % 50 == 0 else names[n]) for k, n in enumerate(picked)] + [("none", None, "Gorra"), ("bare", "gorra azul", None)]
    df = spark.createDataFrame(rows, "url string, name string, category string")
    model = text_model.fit(df)
    labelled = [(n, c) for _, n, c in rows if c is not None]
    # A row without a name has no known gram and trains nothing, but counts as a row.
    pairs = {(n, c) for n, c in labelled if n is not None}
    assert model.regression.summary.predictions.count() == len(pairs) < 20
    df_of = Counter(g for n, _ in labelled if n is not None for g in set(plain_grams(n)))
    got = {r.gram: r.idf for r in model.grams.collect()}
    assert got == {g: pytest.approx(math.log((len(labelled) + 1) / (d + 1)) + 1) for g, d in df_of.items() if d >= 2}
    index = {c: float(k) for k, c in enumerate(model.labels)}
    plain = spark.createDataFrame([(n, index[c]) for n, c in labelled], "text string, y double").join(model.regression.summary.predictions.select("text", "x").dropDuplicates(["text"]), "text")
    whole = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=60, regParam=1 / (text_model.SMOOTHING * len(labelled)), standardization=False).fit(plain)
    shares = {r.text: max(r.probability) for r in whole.transform(plain.dropDuplicates(["text"])).select("text", "probability").collect()}
    judged = text_model.predict(model, df)
    assert judged.columns == ["url", "name", "category", "confidence", "guess"]
    found = judged.collect()
    assert sorted(r.url for r in found) == sorted(u for u, _, _ in rows)
    for r in found:
        assert r.confidence is None if r.name is None else r.confidence == pytest.approx(shares[r.name], abs=0.01)
