"""Main text of html pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block's features are the
tags and class words of its ancestors and statistics of its text; they and the label transitions
have weights that are trained on labelled pages by maximum conditional likelihood. Viterbi finds the
best labelling of all blocks of a page, and the main blocks are joined by line feeds.

Each page is worked on alone, in one pass without a shuffle; the model is a few hundred numbers.

Defined results: null or empty html gives an empty text; unclosed and stray tags are mended as
browsers do, so only raw text such as a script's swallows the rest of a page; text outside any tag
is a block; pages of any length are decoded whole; of two labels of equal score a block gets "not
the article"; repeated rows get equal results; an empty table gives
no rows; null ids and URLs are kept; extra columns are kept unless named text or n_chars, which are
replaced.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import load
from mercato.llm.html_pages import labelled_pages

# Tags that begin and end a block, have no content, or hold no text of the page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("script style noscript template textarea iframe svg head title".split())
#: Of these, the ones whose text runs to the end of the page if they are never closed.
RAW = set("script style noscript textarea iframe title".split())
#: Tags that an opening tag closes if they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KINDS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner",
    "nav": "nav navbar menu breadcrumb breadcrumbs navigation pagination pager toc skip",
    "header": "header masthead topbar branding logo",
    "footer": "footer copyright colophon legal imprint",
    "aside": "sidebar aside widget related rail popular recommended recommendations tags social share sharing more trending",
    "notice": "cookie cookies notice consent alert gdpr popup modal overlay toast warning announcement",
    "form": "form newsletter subscribe subscription login signup search register contact",
    "comments": "comment comments reply replies discussion respond disqus reviews",
    "main": "article main post content entry story body text prose",
}
WORD_KIND = {w: k for k, words in KINDS.items() for w in words.split()}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def _kinds(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of one element: its tag and what its class, id and role say."""
    out = {f"tag:{tag}"}
    for value in CLASS.findall(attributes):
        out |= {f"kind:{WORD_KIND[w]}" for w in re.split(r"[^a-z]+", value.lower()) if w in WORD_KIND}
    if re.search(r"\bhidden\b|display\s*:\s*none", attributes, re.I):
        out.add("hidden")
    return tuple(sorted(out))


@functools.lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*+>" if tag != "head" else r"</head\b[^>]*+>|(?=<body\b)", re.I)


def leaf_blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of the leaf blocks; a path is the features of all elements around and those of the innermost.

    Time grows with the page, also where tags are nested deeply or never closed. Equal paths are one object: the
    collector of cycles visits all that is held, so a page of many blocks should hold few containers.
    """
    out: list[tuple[tuple, str, int]] = []
    stack: list[str] = []  # open elements
    paths: list[tuple[frozenset[str], tuple[str, ...]]] = [(frozenset(), ())]  # of the page and of each open element
    same: dict[tuple, tuple] = {}
    nested: Counter[str] = Counter()  # open elements by tag
    endless: set[str] = set()  # silent tags that aren't closed any more
    last = page.rfind(">") + 1  # no tag ends behind
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((paths[-1], text, linked))
            parts.clear()
        linked = 0

    while at < len(page):
        m = TOKEN.search(page, at, last) if at < last else None
        stop = m.start() if m else page.find("<!--", at)
        chunk = page[at : stop if stop >= 0 else len(page)]
        if chunk:
            chunk = entities.unescape(chunk)
            parts.append(chunk)
            linked += len(chunk) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            break  # a comment that never ends
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # closing
            if tag == "a":
                in_link = 0
            if tag in BLOCKS:
                flush()
                if nested[tag] and (tag != "p" or stack[-1] == "p"):
                    while stack:
                        gone = stack.pop()
                        paths.pop()
                        nested[gone] -= 1
                        if gone == tag:
                            break
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if tag in SILENT and not attributes.endswith("/"):
            end = None if tag in endless else _end_of(tag).search(page, at, last)
            if not end:
                endless.add(tag)
            at = end.end() if end else (len(page) if tag in RAW else at)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            while stack and (stack[-1] == "p" or stack[-1] in CLOSES.get(tag, ()) or tag[0] == "h" and tag[1:].isdigit() and stack[-1] == tag):
                nested[stack.pop()] -= 1
                paths.pop()
            if tag not in VOID:
                kinds, around = _kinds(tag, attributes), paths[-1][0]
                path = (around if around.issuperset(kinds) else around.union(kinds), kinds)
                stack.append(tag)
                paths.append(same.setdefault(path, path))
                nested[tag] += 1
    flush()
    return out


def _text_features(text: str, linked: int, first: bool, last: bool) -> list[str]:
    words, size = text.count(" ") + 1, len(text)
    out = [f"words:{min(int(np.log2(words)), 6)}", f"links:{min(3, 4 * linked // max(size, 1))}", "ends" if text[-1] in ".!?…:\"”" else "open"]
    if text[0] == "©" or "©" in text[:3]:
        out.append("copy")
    if first:
        out.append("first")
    if last:
        out.append("last")
    return out


@functools.lru_cache(20_000)
def _path_features(path: tuple) -> tuple[str, ...]:
    around, own = path
    return tuple(sorted(around | {"own:" + f for f in own if f.startswith("tag:")}))


class Crf:
    """Two labels: 0 is around the article, 1 is the article."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.start, self.moves, self.end = np.zeros(2), np.zeros((2, 2)), np.zeros(2)
        self._paths: dict[tuple, float] = {}

    def features(self, blocks: list[tuple[tuple, str, int]]) -> list[list[str]]:
        n = len(blocks)
        return [[*_path_features(p), *_text_features(t, linked, i == 0, i == n - 1)] for i, (p, t, linked) in enumerate(blocks)]

    def fit(self, pages: list[tuple[str, list[str]]], rounds: int = 300, ridge: float = 1e-3, rate: float = 0.08) -> Crf:
        """Maximum conditional likelihood by gradient steps (Adam) over all pages at once."""
        rows, labels = [], []
        for page, main in pages:
            blocks = leaf_blocks(page)
            if not blocks:
                continue
            left, y = [SPACE.sub(" ", m).strip() for m in main], []
            for _, text, _ in blocks:
                hit = bool(left) and text == left[0]
                if hit:
                    left.pop(0)
                y.append(int(hit))
            rows.append(self.features(blocks))
            labels.append(y)
        for f in sorted({f for r in rows for b in r for f in b}):
            self.number[f] = len(self.number)
        longest, d = max(map(len, labels)), len(self.number)
        x = np.zeros((len(rows), longest, d), np.float32)
        y, mask = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest))
        for i, (r, z) in enumerate(zip(rows, labels, strict=True)):
            for j, b in enumerate(r):
                x[i, j, [self.number[f] for f in b]] = 1
            y[i, : len(z)], mask[i, : len(z)] = z, 1
        w = np.zeros(d + 8)
        moment, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            grad = self._gradient(w, x, y, mask) / len(rows) - ridge * w
            moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            w += rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.start, self.moves, self.end = w[:d], w[d : d + 2], w[d + 2 : d + 6].reshape(2, 2), w[d + 6 :]
        return self

    @staticmethod
    def _gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n, longest, d = x.shape
        start, moves, end = w[d : d + 2], w[d + 2 : d + 6].reshape(2, 2), w[d + 6 :]
        emit = np.stack([np.zeros((n, longest)), x @ w[:d].astype(np.float32)], -1).astype(float)
        last = mask.sum(1).astype(int) - 1
        page = np.arange(n)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        behind = np.zeros((n, longest, 2))
        for t in range(longest - 1, -1, -1):
            further = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2) if t + 1 < longest else np.zeros((n, 2))
            behind[:, t] = np.where((t >= last)[:, None], end, further)
        total = np.logaddexp.reduce(ahead[page, last] + end, axis=1)
        one = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        grad = np.zeros_like(w)
        grad[:d] = np.einsum("ijk,ij->k", x, (y * mask - one[..., 1]))
        true = np.eye(2)[y] * mask[..., None]
        grad[d : d + 2] = (true[:, 0] - one[:, 0]).sum(0)
        both = mask[:, 1:]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        grad[d + 2 : d + 6] = (np.einsum("ija,ijb->ab", true[:, :-1] * both[..., None], true[:, 1:]) - pair.sum((0, 1))).ravel()
        grad[d + 6 :] = (true[page, last] - one[page, last]).sum(0)
        return grad

    def decode(self, blocks: list[tuple[tuple, str, int]]) -> list[int]:
        """Viterbi labelling."""
        get, n = self._weight, len(blocks)
        a, b = float(self.start[0]), float(self.start[1])
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        for i, (path, text, linked) in enumerate(blocks):
            known = self._paths.get(path)
            if known is None:
                known = self._paths[path] = sum(map(get, _path_features(path)))
                if len(self._paths) > 50_000:
                    self._paths.clear()
            e = known + sum(map(get, _text_features(text, linked, i == 0, i == n - 1)))
            if i:
                from0, from1 = b + m10 > a + m00, b + m11 > a + m01
                back.append((from0, from1))
                a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01)
            b += e
        if not n:
            return []
        label = int(b + self.end[1] > a + self.end[0])
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def _weight(self, feature: str) -> float:
        k = self.number.get(feature)
        return float(self.weights[k]) if k is not None else 0.0


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(text for (_, text, _), y in zip(blocks, model.decode(blocks), strict=True) if y)


@functools.cache
def default_model() -> Crf:
    return Crf().fit(labelled_pages())


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """Adds text and n_chars to ``pages(html, ...)``."""
    model = model or default_model()

    @F.pandas_udf("string")
    def main(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p, model) for p in batch], dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", main(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
