"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), reads the documents that its predecessor kept, and returns
its own; ``run`` writes every stage's rows as Parquet in the folder that the session names in
spark.checkpoint.dir and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontaminate, mix_sources, simhash_copies, substring_dedup, toxicity
from mercato.llm.common import load
from mercato.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject.

    Null and empty texts get the base score and stay; without labels of both kinds nothing is learnt
    and the share of toxic labels decides; repeated rows share their fate; extra columns stay as they are.
    """
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates, 5-word shingles of Jaccard 0.8): that with the smallest doc_id.

    Null and empty texts are copies of each other; rows without a doc_id stay; of repeated rows with
    the kept doc_id one stays; extra columns stay as they are.
    """
    return simhash_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids hold; rows stay, even if emptied.

    Null texts and rows without a doc_id stay as they are; n_chars, where there is such a column,
    counts the text that is left; other columns stay as they are, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("row"))
    found = substring_dedup.dedup_substrings(rows)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    columns = {c: F.col("row")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in others:
        columns["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even an edited one.

    Null and empty texts are clean; an empty benchmark drops nothing; repeated rows share their
    fate; extra columns stay as they are.
    """
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each copy taken, with its shard and place in it; n_chars counts the text of the copy.

    Texts without words, null ones too, give no row; a null source is a source of its own; rows
    without a doc_id are drawn like others.
    """
    cut = F.col("taken") < F.col("size")
    mixed = mix_sources.mix(docs).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "size", "taken", "copy", "shard", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]
#: Models, iterative linking and seeded draws are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents table in ``sf_dir``."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
