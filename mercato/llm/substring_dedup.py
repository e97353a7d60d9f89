"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` words in a row of one document; a word goes if a window over it also starts
in a document with a smaller doc_id. Any window holds a whole block of ``BLOCK`` words at a multiple
of ``BLOCK`` in its own document, so:

1. index: the hashes of the non-overlapping blocks of every document;
2. probe: the hashes of all rolling ``BLOCK``-word grams, which find the blocks of other documents;
3. extend: the windows around every hit are matched whole, by 96-bit hashes, against the windows
   around the hits of all other documents; the union of the windows that match is the set of
   maximal repeats.

Words are hashed whole with XXH3 to 128 bits. The halves are independent of each other, and so are
the two halves of a window's 96 bits, each a polynomial over one half of its words' hashes.

Documents are dealt by hash into batches of some ``BATCH_BYTES`` of text. A batch sends its distinct
hashes, packed in one binary value for each bucket of hashes, windows with the smallest doc_id that
holds them, and gets back one bit each: does another batch have this block, or this window in a
document with a smaller doc_id? Repeats within a batch are found in the batch. So nothing grows
with the number of pairs: a passage in every third document costs one entry for each batch. Packed
values number batches x buckets, like the segments of any shuffle. The text is shuffled once (Spark
reuses that exchange in all three passes), and the driver holds nothing but the total size.

Defined results: a null or empty text has no words and nothing removed; a text of any length is
worked on whole, in pieces of ``PIECE`` bytes; rows with equal doc_id don't count as repeats of each
other, so a tie leaves both; a row whose doc_id is null or no whole number has no place in the order:
nothing is removed from it and it is no reference; an empty table gives no rows; extra columns are
kept unless they clash with the names that are added, which replace them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import load

WINDOW = 50
BLOCK = 25  # 2 * BLOCK - 1 <= WINDOW: every window holds a whole aligned block
BATCH_BYTES = 3_000_000
#: Bytes of text that are hashed at a time within a batch, and most words whose digests are kept for the next piece.
PIECE = 250_000
KNOWN_WORDS = 100_000
ADDED = ["n_words", "n_removed", "kept_sha256", "kept_text", "spans"]
_ADDED_DDL = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>"

_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Digests(dict):
    """Number of each word seen, and the 128-bit digests by number."""

    def __init__(self) -> None:
        super().__init__()
        self.bytes = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.bytes += xxhash.xxh3_128_digest(word)
        self[word] = n = len(self)
        return n


class Words:
    """The words of a batch: byte ranges, document numbers and the two halves of their hashes."""

    def __init__(self, texts: list[bytes]):
        starts, ends, docs, hashes = [], [], [], []
        at, known = 0, _Digests()
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
                size += len(texts[to])
                to += 1
            if len(known) > KNOWN_WORDS:
                known = _Digests()
            s, e, d, h = self._piece(texts[at:to], known)
            starts.append(s)
            ends.append(e)
            docs.append(d + at)
            hashes.append(h)
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end = join(starts, np.int64), join(ends, np.int64)  # within the document
        self.doc = join(docs, np.int64)
        both = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.uint64)
        self.hash, self.more = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each document

    @staticmethod
    def _piece(texts: list[bytes], known: _Digests):
        joined = b" ".join(texts)
        raw = np.frombuffer(joined, dtype=np.uint8)
        solid = np.zeros(len(raw) + 2, bool)  # a space before and after
        np.greater(raw - np.uint8(9), 4, out=solid[1:-1])  # wraps around below 9
        solid[1:-1] &= raw != 32
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, end = edge[::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        base = np.cumsum(size) - size
        doc = np.searchsorted(base, start, side="right") - 1
        number = np.fromiter(map(known.__getitem__, joined.split()), np.int64, len(start))
        digests = np.frombuffer(bytes(known.bytes), np.uint64).reshape(-1, 2)
        return start - base[doc], end - base[doc], doc, digests[number]

    def grams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all n-word grams within documents; ``second``: hashes independent of the others."""
        k, h, base = len(self.hash), self.more if second else self.hash, _R2 if second else _R1
        if k < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power = _powers(base, k)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
        at = np.flatnonzero(self.doc[: k - n + 1] == self.doc[n - 1 :])
        back = _powers(pow(base, -1, 1 << 64), k)
        return at, _mix((total[at + n] - total[at]) * back[at])

    def blocks(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the grams that stand at a multiple of BLOCK in their document: documents and hashes."""
        d = self.doc[at]
        aligned = (at - self.first[d]) % BLOCK == 0
        return d[aligned], h[aligned]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers that rise with the hash."""
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _packed(h: np.ndarray, n: int, *columns: np.ndarray):
    """(bucket, bytes of each column) for the sorted hashes ``h``."""
    edges = np.searchsorted(_bucket_of(h, n), np.arange(n + 1))
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, b"".join(c[edges[k] : edges[k + 1]].tobytes() for c in columns)


def _marked(h: np.ndarray, n: int, answers: dict[int, bytes]) -> np.ndarray:
    """Which of the sorted distinct hashes ``h`` the bits of the buckets' answers mark."""
    out = np.zeros(len(h), bool)
    edges = np.searchsorted(_bucket_of(h, n), np.arange(n + 1))
    for k, bits in answers.items():
        out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[k + 1] - edges[k]).astype(bool)
    return out


def _low_high(group: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, group, rank)
    np.maximum.at(high, group, rank)
    return low, high


def _texts(table: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]


def _ranked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct doc_ids of a batch in order, and each row's rank among them."""
    ids, rank = np.unique(table["__id"].to_numpy(zero_copy_only=False), return_inverse=True)
    return ids, rank.reshape(-1)


def candidates(words: Words, rank: np.ndarray, n: int, answers: dict[int, bytes]):
    """Start words and 96-bit hashes of the windows around all hits, from this batch or others."""
    at, h = words.grams(BLOCK)
    distinct, group = np.unique(h, return_inverse=True)
    hit = _marked(distinct, n, answers)[group]
    doc, block = words.blocks(at, h)
    if len(block):
        where = np.searchsorted(distinct, block)
        low, high = _low_high(where, rank[doc], len(distinct))
        own = rank[words.doc[at]]
        hit |= (high[group] >= 0) & ((low[group] != own) | (high[group] != own))
    near = np.zeros(len(words.hash) + 2, np.int64)
    np.add.at(near, np.maximum(at[hit] - (WINDOW - BLOCK), 0), 1)
    np.add.at(near, at[hit] + 1, -1)
    start, low = words.grams(WINDOW)
    _, high = words.grams(WINDOW, second=True)
    kept = np.cumsum(near)[start] > 0
    return start[kept], low[kept], high[kept].astype(np.uint32)


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct (low, high) pairs by low, then high; and each row's number among them."""
    order = np.lexsort((high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


_ANSWER = "batch long, bucket long, bits binary"
_PACKED = "batch long, bucket long, kind int, data binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _probe(n: int):
    def run(table: pa.Table) -> pa.Table:
        words = Words(_texts(table))
        at, h = words.grams(BLOCK)
        batch = table["batch"][0].as_py()
        rows = []
        for kind, values in enumerate((np.unique(words.blocks(at, h)[1]), np.unique(h))):
            rows += [(batch, k, kind, data) for k, data in _packed(values, n, values.astype(np.uint32))]
        return _rows(_PACKED, rows)

    return run


def _answer_probes(table: pa.Table) -> pa.Table:
    """Which probes of a bucket hit a block of another batch; 32 bits of a hash besides its bucket."""
    batch, kind, data = (table[c].to_pylist() for c in ("batch", "kind", "data"))
    blocks = [(b, np.frombuffer(x, np.uint32)) for b, k, x in zip(batch, kind, data, strict=True) if k == 0]
    rows, bucket = [], table["bucket"][0].as_py()
    if blocks:
        distinct, group = np.unique(np.concatenate([x for _, x in blocks]), return_inverse=True)
        low, high = _low_high(group, np.repeat([b for b, _ in blocks], [len(x) for _, x in blocks]), len(distinct))
        for b, k, x in zip(batch, kind, data, strict=True):
            if k == 1:
                x = np.frombuffer(x, np.uint32)
                where = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
                hit = (distinct[where] == x) & ((low[where] != b) | (high[where] != b))
                if hit.any():
                    rows.append((b, bucket, np.packbits(hit).tobytes()))
    return _rows(_ANSWER, rows)


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True))


def _extend(n: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_PACKED, [])
        words = Words(_texts(table))
        ids, rank = _ranked(table)
        start, low, high = candidates(words, rank, n, _answers(answers))
        first, number = _distinct(low, high)
        earliest, _ = _low_high(number, rank[words.doc[start]], len(first))
        low, high, owner, batch = low[first], high[first], ids[earliest], table["batch"][0].as_py()
        return _rows(_PACKED, [(batch, k, 2, data) for k, data in _packed(low, n, low, owner, high)])

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """Which windows of a bucket another batch has in a document with a smaller doc_id."""
    batch, data, bucket = table["batch"].to_pylist(), table["data"].to_pylist(), table["bucket"][0].as_py()
    sizes = [len(x) // 20 for x in data]
    part = lambda kind, width: np.concatenate([np.frombuffer(x, kind, count=s, offset=width * s) for x, s in zip(data, sizes, strict=True)])
    low, owner, high = part(np.uint64, 0), part(np.int64, 8), part(np.uint32, 16)
    first, number = _distinct(low, high)
    earliest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(earliest, number, owner)
    late = owner > earliest[number]
    ends = np.cumsum(sizes).tolist()
    rows = [(b, bucket, np.packbits(late[e - s : e]).tobytes()) for b, s, e in zip(batch, sizes, ends, strict=True) if late[e - s : e].any()]
    return _rows(_ANSWER, rows)


def _both(left: pa.Table, right: pa.Table) -> pa.Table:
    """The answers of both rounds for one batch; those of the second have bucket numbers below 0."""
    second = [(b, -1 - k, x) for b, k, x in zip(*(right[c].to_pylist() for c in ("batch", "bucket", "bits")), strict=True)]
    return _rows(_ANSWER, [*zip(*(left[c].to_pylist() for c in ("batch", "bucket", "bits")), strict=True), *second])


def removed_words(texts: list[bytes], rank: np.ndarray, n: int, first: dict[int, bytes], second: dict[int, bytes]) -> tuple[Words, np.ndarray]:
    """The words of a batch and which of them go."""
    words = Words(texts)
    start, low, high = candidates(words, rank, n, first)
    gone = np.zeros(len(words.hash) + 1, np.int64)
    if len(start):
        order, number = _distinct(low, high)
        late = _marked(low[order], n, second)[number]
        own = rank[words.doc[start]]
        earliest, _ = _low_high(number, own, len(order))
        at = start[late | (own > earliest[number])]
        gone[at] += 1
        gone[at + WINDOW] -= 1
    return words, np.cumsum(gone)[:-1] > 0


def _apply(n: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return None
        got = _answers(answers)
        texts = _texts(table)
        if table["batch"][0].as_py() < 0:
            words = Words(texts)
            gone = np.zeros(len(words.hash), bool)
        else:
            words, gone = removed_words(texts, _ranked(table)[1], n, {k: v for k, v in got.items() if k >= 0}, {-1 - k: v for k, v in got.items() if k < 0})
        total = np.concatenate([[0], np.cumsum(gone)])
        counts, removed = np.diff(words.first), total[words.first[1:]] - total[words.first[:-1]]
        digests, kept_texts, spans = [], [], []
        for k, text in enumerate(texts):
            if not removed[k]:
                digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                kept_texts.append(None)
                spans.append([])
                continue
            a, b = words.first[k], words.first[k + 1]
            edge = np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))
            cuts = np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])
            pieces, at = [], 0
            for lo, hi in [*cuts.tolist(), (b - a, b - a)]:
                if lo > at:
                    pieces.append(text[words.start[a + at] : words.end[a + lo - 1]])
                at = hi
            digests.append(hashlib.sha256(b" ".join(b" ".join(pieces).split())).hexdigest())
            kept_texts.append(b" ".join(pieces).decode("utf-8", "surrogatepass") if with_text else None)
            spans.append([{"start": int(x), "end": int(y)} for x, y in cuts])
        out = table.drop_columns(["batch", "__id"])
        out = out.append_column("n_words", pa.array(counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        out = out.append_column("kept_sha256", pa.array(digests, pa.string())).append_column("kept_text", pa.array(kept_texts, pa.string()))
        out = out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return out if with_text else out.drop_columns(["text"])

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256, spans (removed word ranges) and kept_text.

    kept_text is null where nothing was removed. Without ``with_text`` text is left out.
    """
    docs = docs.drop(*ADDED).withColumnRenamed("batch", "__own_batch")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    n = max(1, math.ceil(size / BATCH_BYTES))
    number = F.col("doc_id").try_cast("long")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    batches = docs.withColumns({"__id": number, "batch": F.when(number.isNull(), -1 - place).otherwise(place)})
    rows = batches.groupBy("batch")
    first = rows.applyInArrow(_skip_unknown(_probe(n)), _PACKED).groupBy("bucket").applyInArrow(_answer_probes, _ANSWER)
    second = rows.cogroup(first.groupBy("batch")).applyInArrow(_skip_unknown(_extend(n)), _PACKED).groupBy("bucket").applyInArrow(_answer_windows, _ANSWER)
    answers = first.groupBy("batch").cogroup(second.groupBy("batch")).applyInArrow(_both, _ANSWER)
    schema = T.StructType(docs.schema.fields if with_text else [f for f in docs.schema.fields if f.name != "text"])
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(_ADDED_DDL).fields])

    def final(table: pa.Table, found: pa.Table) -> pa.Table:
        out = _apply(n, with_text)(table, found)
        return out if out is not None else pa.table({f.name: pa.array([], pa.null()) for f in schema})

    return rows.cogroup(answers.groupBy("batch")).applyInArrow(final, schema).withColumnRenamed("__own_batch", "batch")


def _skip_unknown(f):
    """Batches of rows without a doc_id (numbers below 0) send nothing."""

    def run(table: pa.Table, *more: pa.Table) -> pa.Table:
        if table.num_rows and table["batch"][0].as_py() < 0:
            return _rows(_PACKED, [])
        return f(table, *more)

    def one(table: pa.Table) -> pa.Table:
        return run(table)

    def two(table: pa.Table, answers: pa.Table) -> pa.Table:
        return run(table, answers)

    return two if f.__code__.co_argcount == 2 else one


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(load(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
