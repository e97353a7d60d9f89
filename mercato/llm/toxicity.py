"""Toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against other documents under an informative Dirichlet prior, where
those are significant; every token costs a small constant, so that common words can't add up to a
passage. A linear-time scan finds all maximal segments of positive total score in a document.
Segment scores follow an extreme-value law, fitted on documents that are not toxic; the evidence of
a document's best segments is turned into a probability by a logistic fit.

The token table holds every token whose log-odds are significant in the training sample, which is
bounded (``training.TRAIN_DOCS`` documents); nothing else limits it. All tokens and all segments of
a training document count, as in scoring.

Defined results: a null or empty text has no segment and gets the base probability; a text of any
length is scored whole; repeated rows get equal scores; of several labels of one document the
largest counts; without labels of both kinds every score is the share of toxic labels (0 without
labels); an empty table gives no rows; a null doc_id counts as not held out when the held-out
remainder is not 0; ``score`` keeps extra columns but replaces score and passages, ``drop_toxic``
keeps all columns with their values, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import UPPER, load
from mercato.llm.training import TRAIN_DOCS, labelled_sample, logistic, remainder, without_copies

#: Least z-score of a token's log-odds, and what every token costs in a segment.
MIN_Z = 3.5
DRIFT = 1.0
#: Documents of each kind that the Dirichlet prior stands for, as a share of all training documents.
PRIOR_SHARE = 0.075
#: A segment is significant if fewer than this many are expected by chance in its document.
MAX_EXPECTED = 0.05
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

_SPACES = b"\"!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes.maketrans(UPPER.encode() + _SPACES, UPPER.lower().encode() + b" " * len(_SPACES))


def tokens(text: str) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    decay: float = 1.0  # of the extreme-value law
    location: float = 0.0
    scale: float = 1.0
    weights: tuple[float, float] = (-30.0, 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, total) of a score sequence, in one pass (Ruzzo and Tompa)."""
    # Runs of tokens of one sign act as single items.
    if not len(scores) or scores.max() <= 0:
        return []
    sign = scores > 0
    starts = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1])
    ends = np.append(starts[1:], len(scores))
    sums = np.add.reduceat(scores, starts)
    # start, end, sum before, sum after, and the last earlier segment with a smaller sum before (-1: none).
    # Segments between are never looked at again, so the whole takes time in proportion to the scores.
    found: list[list] = []
    total = 0.0
    for a, b, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        new = [a, b, total, total + s]
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            before = found[j][4]
            del found[j:]
            j = before
    return [(a, b, after - before) for a, b, before, after, _ in found]


def passages(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the maximal segments (start, end, score) in tokens."""
    words = tokens(text or "")
    get = model.scores.get
    return len(words), segments(np.array([get(w, -DRIFT) for w in words]))


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """Minus the log of the chance of so high a best score, plus what further significant segments add."""
    if not found:
        return 0.0
    ranked = sorted((s for _, _, s in found), reverse=True)
    norm = lambda s: (model.decay * s - math.log(n) - model.location) / model.scale
    best = norm(ranked[0])
    x = -math.log(-math.expm1(-math.exp(-best))) if best < 30 else best
    return x + sum(max(0.0, norm(s) + math.log(MAX_EXPECTED)) for s in ranked[1:])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held: int = HELD_OUT, most: int = TRAIN_DOCS) -> Model:
    """Fits the model on a bounded sample; tokens are counted by documents, in Spark."""
    sample = without_copies(labelled_sample(docs, labels, label, folds, held, most)).persist()
    try:
        return _fit(sample)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame) -> Model:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen: Counter = Counter()
            for text, y in zip(rows.text, rows.y, strict=True):
                seen.update((w, int(y)) for w in set(tokens(text)))
                seen[b"", int(y)] += 1  # documents
            yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["token", "y", "n"])

    counts = (
        sample.mapInPandas(count, "token binary, y int, n long")
        .groupBy("token")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("b"))
    )
    sizes = counts.where(F.length("token") == 0).first()
    n1, n0 = (int(sizes.a), int(sizes.b)) if sizes else (0, 0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Model(weights=(math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0))
    # The prior spreads over both kinds like the token over all documents.
    prior, extra = (F.col("a") + F.col("b")) * PRIOR_SHARE, PRIOR_SHARE * (n1 + n0)
    a, b = F.col("a") + prior, F.col("b") + prior
    odds = F.log(a / (n1 + extra + 1 - a)) - F.log(b / (n0 + extra + 1 - b))
    table = counts.where(F.length("token") > 0).select("token", odds.alias("score"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.abs("z") >= MIN_Z)
    model = Model(scores={bytes(r.token): r.score - DRIFT for r in table.orderBy("token").collect()})
    # Decay: the positive root of E exp(decay * score) = 1 over tokens of documents that are not toxic.
    plain = sample.where("y = 0").select("text").mapInPandas(_summed(model), "value double, n double, best double")
    values = plain.where("value is not null").groupBy("value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
    each = plain.where("value is null").toPandas().sort_values(["n", "best"])
    mass = float(each.n.sum()) + 1.0
    p = np.append(values.n.to_numpy(float) / mass, 0.5 / mass)
    s = np.append(values.value.to_numpy(float), max(model.scores.values(), default=1.0))
    lo, hi = 1e-3, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        grown = float((p * np.exp(np.minimum(mid * s, 700))).sum() + (1 - p.sum()) * math.exp(-mid * DRIFT))
        lo, hi = (mid, hi) if grown < 1 else (lo, mid)
    model.decay = lo
    best = (model.decay * each.best - np.log(np.maximum(each.n, 1)))[each.best > 0]
    if len(best) >= 20:
        model.scale = max(float(best.std()) * math.sqrt(6) / math.pi, 0.5)
        model.location = float(best.mean()) - 0.5772156649 * model.scale
    got = sample.mapInPandas(_judged(model), "y int, x double").toPandas().sort_values(["x", "y"])
    model.weights = tuple(logistic(np.log1p(got.x.to_numpy()), got.y.to_numpy().astype(float)))
    return model


def _summed(model: Model):
    """Function of texts: (value, number of tokens) over all tokens with a score, and (null, tokens, best segment) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, values = [], Counter()
            for text in rows.text:
                words = tokens(text)
                values.update(filter(None, map(model.scores.get, words)))
                out.append((None, len(words), max((s for _, _, s in passages(text, model)[1]), default=0.0)))
            yield pd.DataFrame([*((v, n, None) for v, n in values.items()), *out], columns=["value", "n", "best"], dtype=float)

    return run


def _judged(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"y": rows.y, "x": [evidence(*passages(t, model), model) for t in rows.text]})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score and passages (the significant segments: start and end in tokens, score) to ``docs``."""

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,score:double>>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w0, w1 = model.weights
        for batch in texts:
            out = []
            for text in batch:
                n, found = passages(text, model)
                x = math.log1p(evidence(n, found, model))
                rare = math.log(max(n, 1)) + model.location - model.scale * math.log(MAX_EXPECTED)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * x)))), [{"start": a, "end": b, "score": s} for a, b, s in found if model.decay * s >= rare]))
            yield pd.DataFrame(out, columns=["score", "passages"])

    kept = docs.drop("score", "passages")
    return kept.select(F.struct(*kept.columns).alias("row"), judge(F.col("text")).alias("judged")).select("row.*", "judged.score", "judged.passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns and values."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return score(rows, fit(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    judged = score(docs, model)
    return judged.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
