"""Labelled pages that the extraction model is trained on.

Pages are drawn from a seeded grammar of layouts: the article stands in one of several containers
and is surrounded by menus, headers, footers, sidebars, notices, adverts, forms and reader comments
in varying mark-up. Every block knows whether it belongs to the article, so the labels are exact.
"""

from __future__ import annotations

import random

# Class words that pages use for the parts around an article.
CHROME = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "site-nav", "main-menu", "navigation"],
    "header": ["header", "site-header", "masthead", "topbar", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "colophon", "legal"],
    "aside": ["sidebar", "aside", "widget", "related", "rail", "popular", "recommended", "tags", "social", "share"],
    "notice": ["cookie", "notice", "consent", "alert", "banner", "gdpr", "popup", "modal"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored"],
    "form": ["form", "newsletter", "subscribe", "login", "signup", "search"],
    "comments": ["comments", "comment", "comment-list", "replies", "discussion", "reply", "respond"],
}
CONTAINERS = ["article", "main", "post", "content", "entry", "story", "post-content", "article-body", "entry-content", "text", "main-content"]


class Page:
    """Builds the html of one page and the list of its main blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.main = rng, [], []
        self.words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rng.randint(1, 10))) for _ in range(120)]

    def text(self, low: int, high: int, end: str = ".") -> str:
        n = self.rng.randint(low, high)
        out = " ".join(self.rng.choice(self.words) for _ in range(n)).capitalize()
        if self.rng.random() < 0.15:
            out = " ".join(w + self.rng.choice(["###", "!!", "$$$", "***", " |"]) for w in out.split())
        return out + (end if self.rng.random() < 0.9 else "")

    def attr(self, words: list[str]) -> str:
        kind = self.rng.choice(["class", "class", "class", "id"])
        return f' {kind}="{self.rng.choice(words)}{self.rng.choice(["", "", " box", " clearfix", "-1"])}"'

    def links(self, n: int) -> str:
        one = [f'<a href="/{self.rng.choice(self.words)}">{self.text(1, 4, "")}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if self.rng.random() < 0.7 else self.rng.choice([" ", " | "]).join(one)

    def part(self, kind: str) -> str:
        rng = self.rng
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "section")
        plain = rng.random() < 0.35 and tag != "section"
        tag, attr = (tag, "") if plain else (rng.choice(["div", "div", "section", tag]), self.attr(CHROME[kind]))
        if kind == "nav":
            body = self.links(rng.randint(2, 8))
        elif kind == "header":
            body = rng.choice([self.text(1, 5, ""), f"<h1>{self.text(1, 3, '')}</h1>", f"<p>{self.text(2, 9)}</p>"]) + (self.links(3) if rng.random() < 0.5 else "")
        elif kind == "footer":
            body = rng.choice(["&copy; ", "", "<p>&copy; 2024 "]) + self.text(2, 18) + (self.links(rng.randint(1, 4)) if rng.random() < 0.4 else "")
        elif kind == "aside":
            body = f"<h3>{self.text(1, 4, '')}</h3>" + (self.links(rng.randint(2, 6)) if rng.random() < 0.6 else f"<p>{self.text(5, 40)}</p>")
        elif kind == "form":
            body = f"<label>{self.text(1, 4, '')}</label><input type=text><p>{self.text(3, 15)}</p><button>{self.text(1, 2, '')}</button>"
        elif kind == "comments":
            body = f"<h3>{self.text(1, 3, '')}</h3>" + "".join(f"<div{self.attr(['comment', 'reply', 'comment-body'])}><p>{self.text(1, 60)}</p></div>" for _ in range(rng.randint(1, 5)))
        else:
            body = self.text(3, 35) if rng.random() < 0.5 else f"<p>{self.text(3, 35)}</p>"
        return f"<{tag}{attr}>{body}</{tag}>"

    def block(self, low: int, high: int, tag: str, end: str = ".") -> str:
        text = self.text(low, high, end)
        self.main.append(text)
        inner = text
        words = text.split(" ")
        if len(words) > 6 and self.rng.random() < 0.3:
            k = self.rng.randrange(len(words) - 2)
            words[k] = f'<a href="/x">{words[k]}</a>' if self.rng.random() < 0.6 else f"<b>{words[k]}</b>"
            inner = " ".join(words)
        return f"<{tag}>{inner}" + (f"</{tag}>" if self.rng.random() < 0.9 else "")

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(self.block(2, 14, "h1", "") + "</h1>")
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 20])):
            r = rng.random()
            if r < 0.72:
                out.append(self.block(1, 90, "p"))
            elif r < 0.82:
                out.append(self.block(1, 8, rng.choice(["h2", "h3"]), "") + "</h2>")
            elif r < 0.9:
                out.append("<ul>" + "".join(self.block(2, 15, "li") for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.95:
                out.append("<blockquote>" + self.block(5, 50, "p") + "</blockquote>")
            else:
                out.append(self.part(rng.choice(["ad", "form", "aside", "notice"])))
        return "".join(out)


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """``n`` pages as (html, texts of the main blocks in page order)."""
    pages = []
    for k in range(n):
        rng = random.Random(f"{seed}-{k}")
        page = Page(rng)
        before = [page.part(kind) for kind in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        if rng.random() < 0.4:
            rng.shuffle(before)
        tag = rng.choice(["article", "article", "main", "div", "section"])
        attr = page.attr(CONTAINERS) if tag in ("div", "section") or rng.random() < 0.3 else ""
        body = f"<{tag}{attr}>{page.article()}</{tag}>"
        if rng.random() < 0.2:
            page.main.clear()
            body = "" if rng.random() < 0.3 else f"<{tag}{attr}>{page.article()}</{tag}>"
        if rng.random() < 0.3:
            body = f"<div{page.attr(['wrapper', 'container', 'page', 'row'])}>{body}</div>"
        after = [page.part(kind) for kind in ("comments", "aside", "ad", "form", "nav", "footer") if rng.random() < 0.5]
        pages.append((f"<html><head><title>{page.text(1, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", page.main))
    return pages
