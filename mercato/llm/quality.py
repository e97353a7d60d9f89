"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into bins; cyclic boosting of shallow trees learns one lookup table per
statistic, then one for each of the strongest pairs. A score is a sum of table entries, put through
the logistic function. Fitted on a bounded sample of labelled documents.

Defined results: a null text counts as empty; an empty text gets the score of the lowest bins; a
text of any length is measured whole; repeated rows get equal scores; of several labels of one
document the largest counts, and a statistic on the border of two bins falls into the upper one;
without labels of both kinds every score is the share of good labels (0.5 without labels); an empty
table gives no rows; a null doc_id counts as remainder 0; ``score`` keeps extra columns but replaces
one named score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import load
from mercato.llm.training import TRAIN_DOCS, labelled_sample, remainder

BINS = 32
ROUNDS, PAIR_ROUNDS = 150, 60
RATE = 0.1
PAIRS = 6
#: Least number of training rows in a leaf.
LEAF = 20
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

FEATURES = ["log_words", "word_length", "distinct_words", "upper", "digits", "marks", "pipes", "bangs", "stops", "words_a_line", "repeated_lines", "wide_marks", "long_words", "not_ascii"]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``FEATURES``."""
    b = (text or "").encode("utf-8", "replace")
    words, lines = b.split(), [x for x in b.split(b"\n") if x]
    n, size = max(len(words), 1), max(len(b), 1)
    count = lambda chars: len(b) - len(b.translate(None, chars))
    marks = count(_MARKS)
    stops = count(b".,;")
    solid = sum(map(len, words))
    return [
        np.log1p(len(words)),
        solid / n,
        len(set(words)) / n,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        marks / n,
        b.count(b"|") / n,
        b.count(b"!") / n,
        stops / n,
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        (marks - stops) / n,
        sum(len(w) > 20 for w in words) / n,
        (len(b) - len(b.decode("utf-8").encode("ascii", "ignore"))) / size,
    ]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[at[:, j]]
        for i, j, t in self.pairs:
            z += t[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """Best cut of a run of bins by the gain of a Newton step: (bins on the left, gain)."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAF) & (nr >= LEAF), gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf)
    if not len(gain) or not np.isfinite(gain).any():
        return 0, 0.0
    k = int(gain.argmax())
    return k + 1, float(gain[k] - g.sum() ** 2 / (h.sum() + 1))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step of a shallow tree over bins."""
    cut, gain = _split(g, h, n) if depth else (0, 0.0)
    if not cut or gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Step of a tree that cuts the first axis, then each side of it by the second; and its gain."""
    best, gain = np.zeros_like(g), 0.0
    cut, _ = _split(g.sum(1), h.sum(1), n.sum(1))
    for k in {cut, len(g) // 2, len(g) // 4, 3 * len(g) // 4} - {0}:
        step, won = np.zeros_like(g), 0.0
        for part in (slice(0, k), slice(k, None)):
            gs, hs = g[part].sum(0), h[part].sum(0)
            line = _tree(gs, hs, n[part].sum(0), 1)
            step[part] = line
            won += float((line * gs).sum())
        if won > gain:
            best, gain = step, won
    return best, gain


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the tables by cyclic boosting."""
    share = float(y.mean()) if len(y) else 0.5
    model = Model(base=float(np.log((share + 1e-9) / (1 - share + 1e-9))) if len(y) else 0.0)
    if share in (0.0, 1.0) or not len(y):
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    at = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    counts = [np.bincount(at[:, j], minlength=s) for j, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[:, j], g, s), np.bincount(at[:, j], h, s), counts[j])
            model.tables[j] += step
            z += step[at[:, j]]
    grids = {(i, j): at[:, i] * sizes[j] + at[:, j] for i in range(len(sizes)) for j in range(i + 1, len(sizes))}

    def sums(pair: tuple[int, int], v: np.ndarray | None) -> np.ndarray:
        shape = sizes[pair[0]], sizes[pair[1]]
        return np.bincount(grids[pair], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(grids, key=lambda p: (-_tree2(sums(p, g), sums(p, h), sums(p, None))[1], p))[:PAIRS]
    tables = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            g, h = slopes()
            step = RATE * _tree2(sums(p, g), sums(p, h), sums(p, None))[0]
            tables[p] += step
            z += step.ravel()[grids[p]]
    model.pairs = [(i, j, tables[i, j]) for i, j in ranked]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD_OUT, most: int = TRAIN_DOCS) -> Model:
    sample = labelled_sample(docs, labels, label, folds, held, most)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"x": [features(t) for t in rows.text], "y": rows.y})

    rows = sample.mapInPandas(measure, "x array<double>, y int").toPandas()
    return train(np.array(rows.x.tolist(), dtype=float).reshape(len(rows), len(FEATURES)), (rows.y == 1).to_numpy(dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to ``docs``."""

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.predict(np.array([features(t) for t in batch], dtype=float).reshape(len(batch), len(FEATURES))))

    return docs.withColumn("score", judge(F.col("text")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    judged = score(docs, model)
    return judged.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
