"""Filling an embedding cache in waves that survive a broken run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import curation
from mercato.operators.graph import cut

SCHEMA = "url string, embedding binary, dim int, model_version string"
#: Rows that a wave writes, on average; what a broken run loses.
WAVE_ROWS = 1_000_000

#: Loads a model once a task: gives a function from images to vectors, None for those that it can't encode.
Encoder = Callable[[], Callable[[Sequence[str]], Iterable[Sequence[float] | None]]]


def _encoding(load: Encoder, version: str):
    """Function over the batches of a task, for ``mapInPandas``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            vectors = [None if v is None else np.asarray(v, dtype="<f4") for v in encode(batch["image"].tolist())]
            out = pd.DataFrame({"url": batch["url"], "embedding": [None if v is None else v.tobytes() for v in vectors], "dim": [0 if v is None else len(v) for v in vectors]})
            yield out[out["dim"] > 0].assign(model_version=version)

    return run


class EmbeddingCache:
    """Embeddings in ``folder``, as ``curation.valid_cache`` reads them: 4-byte little-endian numbers, with dim and version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, rows: DataFrame) -> None:
        rows.select("url", "embedding", "dim", "model_version").write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def current(self, version: str) -> DataFrame:
        """One valid row for each URL of this version; a URL that two runs wrote counts once."""
        return curation.valid_cache(self.read(), version).dropDuplicates(["url"])

    def backfill(self, catalog: DataFrame, load: Encoder, version: str, wave_rows: int = WAVE_ROWS) -> int:
        """Encodes the active rows with an image that the cache lacks in this version; gives the number of waves.

        Rows are dealt to waves by a hash of their URL, so no wave hangs on one key, and a wave is
        committed before the next one starts. After a failure the same call goes on: what is held by
        then is left out by an anti-join. Rows that the encoder gives no vector for stay pending, and
        so do rows without a URL, which nothing could find again. Repeated URLs are encoded once.
        """
        self.add(self.spark.createDataFrame([], SCHEMA))  # so that the folder can be read
        todo = curation.pending(catalog, self.read(), version).where("coalesce(url, '') <> ''")
        todo = cut(todo.groupBy("url").agg(F.min("image").alias("image")))
        waves = -(-todo.count() // wave_rows)
        for k in range(waves):
            wave = todo.where(F.pmod(F.xxhash64("url"), F.lit(waves)) == k)
            self.add(wave.mapInPandas(_encoding(load, version), SCHEMA))
        return waves
