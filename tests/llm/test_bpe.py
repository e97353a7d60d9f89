"""Byte-level BPE against the tokenizers library, on hostile texts and on every kind of row."""

import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercato.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abcde '’éßñ日本  \n\t\r\x0b\x00\x1c\x1d\x85​﻿0129½²,.!?😀", "<|endoftext|>", "<|endoftext|", "'s", "'ll", " the", "ing"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def test_random_texts_give_the_library_s_ids_and_texts(ours, theirs):
    random.seed(7)
    for _ in range(5000):
        text = "".join(random.choices(PARTS, k=random.randint(0, 40)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert list(ours.encode(text)) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


def test_ids_that_cut_characters_decode_as_the_library_decodes(ours, theirs):
    random.seed(8)
    for _ in range(500):
        ids = random.choices(range(50257), k=12)
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_time_of_one_long_word_grows_with_its_length(ours):
    def took(n):
        began = time.perf_counter()
        ours.encode("ab" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 4 * 2.5 * max(took(40_000), 0.02)


def test_query_over_a_whole_table(spark, theirs, monkeypatch):
    got = {r.doc_id: r for r in bpe.op13_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_rows_of_every_kind(spark, documents):
    words = bpe.read_vocabulary(PATH)
    docs = documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 3_000_000)]).withColumns({"ids": F.lit("own"), "row": F.lit(1), "decoded": F.lit(None)})
    for packed in (False, True):
        got = bpe.encode(docs, words, packed, decoded=True)
        assert got.columns == ["doc_id", "text", "row", "ids", "decoded"]
        size = F.length("ids") / 4 if packed else F.when(F.col("ids").isNotNull(), F.size("ids"))
        again = bpe.decode(got.withColumn("once", F.col("decoded")), words)
        rows = again.select("doc_id", size.cast("int").alias("n"), F.col("decoded").eqNullSafe(F.col("text")) & F.col("once").eqNullSafe(F.col("text"))).collect()
        assert sorted(tuple(r) for r in rows if r.doc_id < 4) == [(1, None, True), (2, 0, True), (3, 2, True), (3, 2, True)]
        assert all(r[2] for r in rows) and len(rows) == 5
    assert bpe.encode(documents([]), words).count() == 0
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
