"""Category classifier on names: character grams within words, sublinear weights, an exact stratified split.

Grams, weights and split are joins and aggregates; Spark ML fits the regression. Grams of a name are counted
before they are joined with the vocabulary, whose size is bounded by ``MOST_GRAMS``. Each different name is
worked on once and counts as often as rows have it, in the vocabulary and in the regression alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.text import fold
from mercato.operators.classify import LEAST_CONFIDENCE
from mercato.operators.graph import cut

LOW, HIGH, MOST_GRAMS, LEAST_NAMES, SMOOTHING = 2, 5, 80_000, 2, 8.0
TEST_SHARE = 0.2
#: Leading hexadecimal digits of a row's hash by which a class is cut into parts for the split.
PART_DIGITS = 3


def word_grams(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Character grams of each word with a blank on both sides, accents and case ignored; a word shorter than a length counts once."""
    words = F.filter(F.split(fold(text), r"\s+"), lambda w: w != "")
    of_length = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, n))
    longest = lambda w: F.least(F.lit(high), F.length(w))
    of_word = lambda w: F.flatten(F.transform(F.sequence(F.least(F.lit(low), longest(w)), longest(w)), lambda n: of_length(w, n)))
    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), of_word))


def gram_counts(rows: DataFrame, key: str = "url", text: str = "name") -> DataFrame:
    """``key, gram, n`` of every gram that a row's text holds."""
    return rows.select(key, F.explode(word_grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def _once(rows: DataFrame, *by: str) -> DataFrame:
    """``by, rows``: the different values of ``by`` with the number of their rows, dealt by the first, so that what is grouped by it stays in place."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.groupBy(*by).agg(F.count("*").alias("rows")).repartition(tasks, by[0])


def vocabulary(rows: DataFrame, text: str = "name", most: int = MOST_GRAMS, least: int = LEAST_NAMES) -> DataFrame:
    """``gram, number, idf``: the grams that ``least`` rows or more hold, the ``most`` commonest of them, numbered in their order."""
    return _vocabulary(_once(rows.select(F.col(text).alias("text")), "text"), most, least)


def _vocabulary(texts: DataFrame, most: int, least: int = LEAST_NAMES) -> DataFrame:
    """The same from ``text, rows``."""
    counts = texts.select("text", "rows", F.explode(word_grams(F.col("text"))).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("n"), F.first("rows").alias("rows"))
    counts = counts.groupBy("gram").agg(F.sum(F.col("n") * F.col("rows")).alias("n"), F.sum("rows").alias("df")).where(F.col("df") >= least)
    kept = counts.orderBy(F.desc("n"), "gram").limit(most)
    total = texts.agg(F.sum("rows").alias("rows"))  # one row
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gram")) - 1  # of ``most`` rows at most
    return kept.crossJoin(F.broadcast(total)).select("gram", number.alias("number"), (F.log((F.col("rows") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _raw(rows: DataFrame, grams: DataFrame, key: str, text: str) -> DataFrame:
    return gram_counts(rows, key, text).join(F.broadcast(grams), "gram").withColumn("w", (F.log("n") + 1) * F.col("idf"))


def weights(rows: DataFrame, grams: DataFrame, key: str = "url", text: str = "name") -> DataFrame:
    """``key, number, gram, weight``: (1 + ln n) idf, scaled so that a row's squares sum to 1."""
    raw = _raw(rows, grams, key, text)
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "number", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def stratified(rows: DataFrame, by: str = "category", key: str = "url", share: float = TEST_SHARE) -> DataFrame:
    """``rows`` with held_out: of each class of two rows or more the nearest whole number to ``share`` of it, in order of the keys' hashes.

    A class is cut by the first digits of the hash; only the part in which its bound lies is ranked, so
    that no class, however large, is sorted by one task. A class of one row is trained on; null classes are a class.
    """
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = rows.withColumns({"__class": F.coalesce(F.col(by), F.lit("")), "__hash": hashed, "__part": F.substring(hashed, 1, PART_DIGITS)})
    parts = rows.groupBy("__class", "__part").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__class").orderBy("__part")
    parts = parts.withColumn("__upto", F.sum("__n").over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy("__class")))
    wanted = F.when(F.col("__all") > 1, F.greatest(F.floor(F.col("__all") * share + 0.5), F.lit(1))).otherwise(0)
    parts = parts.select("__class", "__part", (wanted - (F.col("__upto") - F.col("__n"))).alias("__left"), "__n")
    rows = rows.join(parts, ["__class", "__part"])
    whole, none = F.col("__left") >= F.col("__n"), F.col("__left") <= 0
    settled = rows.where(whole | none).withColumn("held_out", whole)
    rank = F.row_number().over(Window.partitionBy("__class", "__part").orderBy("__hash", key))
    cut = rows.where(~(whole | none)).withColumn("held_out", rank <= F.col("__left"))
    return settled.unionByName(cut).drop("__class", "__hash", "__part", "__left", "__n")


@dataclass
class TextModel:
    grams: DataFrame
    size: int
    labels: list[str]
    regression: LogisticRegressionModel


def _vectors(texts: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """``text, x``: the weights of each different ``text``; none for those without a known gram."""

    @F.udf(VectorUDT())
    def as_vector(numbers, w):
        values = np.array(w)
        return SparseVector(size, numbers, values / np.sqrt(values @ values))

    cells = _raw(texts, grams, "text", "text").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("number", "w"))).alias("cells"))
    return cells.select("text", as_vector("cells.number", "cells.w").alias("x"))


def fit(rows: DataFrame, text: str = "name", label: str = "category", most: int = MOST_GRAMS) -> TextModel:
    """A regression over the classes of ``rows``; rows that share text and class are one instance with their number as its weight."""
    rows = rows.select(F.col(text).alias("text"), F.col(label).alias("label")).where("label is not null")
    pairs = cut(_once(rows, "text", "label"))  # the passes then plan without what made the rows
    texts = pairs.groupBy("text").agg(F.sum("rows").alias("rows"))
    grams = cut(_vocabulary(texts, most))
    size, n = grams.count(), pairs.agg(F.sum("rows")).first()[0] or 0
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(pairs)
    data = index.transform(pairs).join(_vectors(texts.select("text"), grams, size), "text")
    regression = LogisticRegression(featuresCol="x", labelCol="y", weightCol="rows", family="multinomial", maxIter=60, regParam=1 / (SMOOTHING * max(n, 1)), standardization=False)
    return TextModel(grams, size, index.labels, regression.fit(data))


def predict(model: TextModel, rows: DataFrame, least: float = LEAST_CONFIDENCE, text: str = "name") -> DataFrame:
    """``rows`` with guess and confidence; no guess below ``least``, neither for texts without a known gram. Each different text is scored once."""
    texts = _once(rows.select(F.col(text).alias("text")), "text")
    scored = model.regression.transform(_vectors(texts, model.grams, model.size))
    shares = vector_to_array("probability")
    labels = F.array(*map(F.lit, model.labels))
    best = scored.select(F.col("text").alias("__text"), F.array_max(shares).alias("confidence"), F.get(labels, F.col("prediction").cast("int")).alias("__best"))
    rows = rows.drop("guess", "confidence")
    joined = rows.join(best, rows[text] == best["__text"], "left").drop("__text")
    return joined.withColumn("guess", F.when(F.col("confidence") >= least, F.col("__best"))).drop("__best")


def report(judged: DataFrame, label: str = "category") -> DataFrame:
    """``label, n, guessed, right``: of each class, rows, rows with a guess and right guesses."""
    return judged.groupBy(label).agg(F.count("*").alias("n"), F.count("guess").alias("guessed"), F.count_if(F.col("guess") == F.col(label)).alias("right"))
