"""Bounded labelled samples for the classifiers that are fitted on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A classifier is fitted on at most about this many labelled documents (a hash sample).
TRAIN_DOCS = 20_000


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int = TRAIN_DOCS) -> DataFrame:
    """``text, y`` of a hash sample of about ``most`` labelled documents outside the held-out fold.

    Of several labels of one doc_id the largest counts; null ids and null labels are not used.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    n = known.count()
    share = min(1.0, most / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").select("text", "y")


def without_copies(sample: DataFrame) -> DataFrame:
    """One document of each (label, smallest hash of three words in a row): near copies mostly share
    the smallest hash, so a large group of them no longer speaks for every word that it holds."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words = [t.encode("utf-8", "replace").split() for t in rows.text]
            rows["sign"] = [min((zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(len(w) - 2, 1))), default=0) for w in words]
            yield rows[["text", "y", "sign"]]

    return sample.mapInPandas(sign, "text string, y int, sign long").groupBy("sign", "y").agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def logistic(x, y, ridge: float = 1e-2, rounds: int = 30):
    """Coefficients of a ridge logistic regression with an intercept, by Newton's method."""
    import numpy as np

    X = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(X.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        h = X.T @ (X * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, X.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
