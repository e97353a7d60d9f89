"""Byte-level BPE: texts to token ids and back.

A text is first cut at the special tokens that it holds, then into words by the vocabulary's
pattern. The bytes of a word become a doubly linked list of symbols; a priority queue holds the
ranks of neighbouring pairs, and the pair of lowest rank (of equal ones the leftmost) is joined until none
is left. Entries whose symbols have changed meanwhile are stale and skipped. So a word of n bytes
takes n log n steps, however long it is. Decoding joins the vocabulary's strings and reads their
bytes as UTF-8.

The vocabulary is a tokenizer file whose path is a parameter; the driver reads it once and sends its
text (some 1.5 MB, checked) to the executors. Nothing else leaves a task, and no row moves.

Null texts give a null list; callers who want them empty coalesce first. Empty texts give an empty
list. Repeated rows and ties give the same ids. Other columns stay as they are, but own columns named
ids or decoded are replaced. Very long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import load, schema_with, slices

#: Largest tokenizer file that is sent to the executors.
MOST_BYTES = 64_000_000
#: Words of a task whose ids are remembered, and the longest such word.
CACHE_WORDS, CACHE_LENGTH = 200_000, 40
#: How byte-level vocabularies cut texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The character by which such vocabularies write each byte: itself where it prints, else the next free one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("only byte-level BPE without a prefix space is supported")
        if spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("normalizers, dropout and marked words are not supported")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their surroundings are not supported")
        ids, chars = model["vocab"], byte_characters()
        self.first = [ids[c] for c in chars]
        #: (left id, right id) -> (rank, id of both)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.words = regex.compile(PATTERN).findall
        number = {c: b for b, c in enumerate(chars)}
        self.strings = {k: bytes(number[c] for c in s) if all(c in number for c in s) else s.encode() for s, k in [*ids.items(), *self.special.items()]}
        self.cache: dict[str, list[int]] = {}

    def join(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        symbol = [self.first[b] for b in data]
        n, merges = len(symbol), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for k in range(n - 1):
            if found := merges.get((symbol[k], symbol[k + 1])):
                queue.append((found[0], k, symbol[k], symbol[k + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, left, right, both = heapq.heappop(queue)
            other = after[k]
            if symbol[k] != left or other < 0 or symbol[other] != right:
                continue  # stale
            symbol[k], symbol[other] = both, -1
            behind = after[k] = after[other]
            if behind >= 0:
                before[behind] = k
                if found := merges.get((both, symbol[behind])):
                    heapq.heappush(queue, (found[0], k, both, symbol[behind], found[1]))
            ahead = before[k]
            if ahead >= 0 and (found := merges.get((symbol[ahead], both))):
                heapq.heappush(queue, (found[0], ahead, symbol[ahead], both, found[1]))
        return [s for s in symbol if s >= 0]

    def word(self, word: str) -> list[int]:
        ids = self.join(word.encode("utf-8", "surrogatepass"))
        if len(word) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> array:
        out, known = array("i"), self.cache
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[piece])
                continue
            for w in self.words(piece):
                ids = known.get(w)
                out.extend(self.word(w) if ids is None else ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD; an id that the vocabulary lacks adds nothing."""
        strings = self.strings
        return b"".join([strings.get(k, b"") for k in ids]).decode("utf-8", "replace")


@functools.lru_cache(2)
def _vocabulary(text: str) -> Vocabulary:
    """Read once a Python worker."""
    return Vocabulary(text)


def read_vocabulary(path: str) -> str:
    """Text of a tokenizer file on the driver, for ``encode`` and ``decode``; raises if it is none that they know."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    _vocabulary(text)
    return text


def encode(docs: DataFrame, vocabulary: str, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ids: those of text, special tokens in it included, none added.

    Lists of integers, or with ``packed`` unsigned 32-bit integers, lowest byte first, in one binary
    value, as training files hold them. With ``decoded`` the text that the ids give stands beside them.
    """
    kept = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary)
        for rows in slices(batches):
            found = [None if t is None else words.encode(t) for t in rows["text"].to_pylist()]
            rows = rows.append_column("ids", _packed(found) if packed else _lists(found))
            if decoded:
                rows = rows.append_column("decoded", pa.array([None if x is None else words.decode(x) for x in found], pa.string()))
            yield rows

    return kept.mapInArrow(run, schema_with(kept, ids="binary" if packed else "array<int>", **{"decoded": "string"} if decoded else {}))


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with decoded, the text of each list of ids, special tokens included; packed or not, null for null."""
    kept = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary)
        for batch in batches:
            found = [None if x is None else words.decode(np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x) for x in batch["ids"].to_pylist()]
            yield batch.append_column("decoded", pa.array(found, pa.string()))

    return kept.mapInArrow(run, schema_with(kept, decoded="string"))


def _packed(found: list[array | None]) -> pa.Array:
    return pa.array([None if x is None else np.frombuffer(x, np.int32).astype("<u4").tobytes() for x in found], pa.binary())


def _lists(found: list[array | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(x or ()) for x in found)], dtype=np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in found if x)])
    offsets = pc.if_else(pa.array([x is None for x in found] + [False]), pa.scalar(None, pa.int32()), pa.array(ends))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(docs, vocabulary, packed=True, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
