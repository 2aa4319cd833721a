"""Labelled pages to train on: layouts as found on the web, filled with random words, each block's label known."""

from __future__ import annotations

import random

CONTENT = ["content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "text", "body-copy", "articleBody"]
CHROME = {
    "nav": ["menu", "nav", "navbar", "navigation", "breadcrumb", "main-menu", "top-nav", "pagination", "tabs"],
    "header": ["header", "masthead", "site-header", "banner", "topbar", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon"],
    "aside": ["sidebar", "widget", "related", "aside", "recommended", "trending", "most-read", "secondary"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "promotion"],
    "notice": ["cookie", "notice", "consent", "alert", "gdpr", "cookie-banner", "disclaimer", "newsletter", "subscribe", "popup", "modal", "paywall"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "responses", "reader-comments"],
    "share": ["share", "social", "share-buttons", "author-bio", "tags", "meta", "byline"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form"],
}


class Writer:
    def __init__(self, seed: int):
        self.r, self.truth = random.Random(seed), {}

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices("abcdefghilmnoprstuvzéöñ", k=self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def leaf(self, label: int, low: int, high: int, stop: bool = True, extra: str = "") -> str:
        while (text := (self.words(low, high).capitalize() + ("." if stop else "") + extra)) in self.truth:
            pass
        self.truth[text] = label
        return text

    def named(self, tag: str, names: list[str], inside: str) -> str:
        kind = self.r.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{self.r.choice(names)}">{inside}</{tag}>'

    def prose(self, label: int, low: int = 1, high: int = 5) -> str:
        return "".join(f"<p>{self.leaf(label, 3 if self.r.random() < 0.15 else 8, 60)}</p>" for _ in range(self.r.randint(low, high)))

    def items(self, label: int, linked: bool) -> str:
        texts = [self.leaf(label, 1, 4 if linked else 12, stop=not linked and self.r.random() < 0.5) for _ in range(self.r.randint(3, 7))]
        return "<ul>" + "".join(f'<li><a href="/x">{t}</a></li>' if linked else f"<li>{t}</li>" for t in texts) + "</ul>"

    def chrome(self, kind: str) -> str:
        r, names = self.r, CHROME[kind]
        if kind == "nav":
            inside = self.items(0, True)
            return r.choice([f"<nav>{inside}</nav>", self.named("nav", names, inside), self.named("div", names, inside), inside])
        if kind == "header":
            inside = f'<{r.choice(["h1", "h2", "div", "p"])}>'.join(["", self.leaf(0, 1, 6, stop=False)]) + (f"<p>{self.leaf(0, 3, 10)}</p>" if r.random() < 0.5 else "")
            return r.choice([f"<header>{inside}</header>", self.named("header", names, inside), self.named("div", names, inside)])
        if kind == "footer":
            inside = self.leaf(0, 3, 15, extra=r.choice([" © 2024", " Copyright 2023", " All rights reserved.", "", ""]))
            inside = r.choice([inside, f"<p>{inside}</p>", f"<p>{inside}</p>" + self.items(0, True)])
            return r.choice([f"<footer>{inside}</footer>", f"<footer>{inside}</footer>", self.named("footer", names, inside), self.named("div", names, inside)])
        if kind == "aside":
            inside = f"<h3>{self.leaf(0, 1, 5, stop=False)}</h3>" + r.choice([self.items(0, True), self.prose(0, 1, 2), self.items(0, False)])
            return r.choice([f"<aside>{inside}</aside>", self.named("aside", names, inside), self.named("div", names, inside), self.named("section", names, inside)])
        if kind in ("ad", "notice", "share"):
            inside = r.choice([self.leaf(0, 3, 30), f"<p>{self.leaf(0, 5, 40)}</p>", f'{self.leaf(0, 3, 12)}<div><a href="/x">{self.leaf(0, 1, 4, stop=False)}</a></div>'])
            return self.named(r.choice(["div", "div", "section", "aside", "p"]) if not inside.startswith("<p") and "<div" not in inside else "div", names, inside)
        if kind == "form":
            inside = f"<label>{self.leaf(0, 1, 5, stop=False)}</label><input name=q><p>{self.leaf(0, 3, 20)}</p><button>{self.leaf(0, 1, 2, stop=False)}</button>"
            return r.choice([f"<form>{inside}</form>", self.named("form", CHROME["form"], inside)])
        each = "".join(self.r.choice(["<div class=comment>{}</div>", "<li>{}</li>", "<article>{}</article>"]).format(f"<h4>{self.leaf(0, 1, 3, stop=False)}</h4>" + self.prose(0, 1, 2)) for _ in range(r.randint(1, 4)))
        inside = f"<h3>{self.leaf(0, 1, 3, stop=False)}</h3>{each}"
        return r.choice([self.named("section", names, inside), self.named("div", names, inside), self.named("ol", names, inside)])

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.leaf(1, 2, 14, stop=r.random() < 0.4)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 8)):
            x = r.random()
            if x < 0.5:
                out.append(self.prose(1))
            elif x < 0.6:
                out.append(f"<h2>{self.leaf(1, 1, 8, stop=False)}</h2>" + self.prose(1, 1, 2))
            elif x < 0.76:
                out.append(self.items(1, False))
            elif x < 0.8:
                out.append(f"<blockquote><p>{self.leaf(1, 5, 30)}</p></blockquote>")
            elif x < 0.83:
                out.append(f"<table><tr><td>{self.leaf(1, 1, 4, stop=False)}</td></tr></table>")
            elif x < 0.86:
                out.append(f"<figure><figcaption>{self.leaf(1, 3, 12)}</figcaption></figure>")
            elif x < 0.88:
                out.append(f"<p><b>{self.leaf(1, 3, 30)}<br>")  # left open
            else:
                out.append(self.chrome(r.choice(["ad", "aside", "share", "notice", "form"])))
        inside = "".join(out)
        if r.random() < 0.15:
            inside += self.chrome("comments")
        return r.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", self.named("div", CONTENT, inside), self.named("article", CONTENT, inside), self.named("section", CONTENT, inside), f"<div>{inside}</div>", inside])

    def page(self) -> str:
        before = [self.chrome(k) for k in ("header", "nav", "notice", "ad", "form") if self.r.random() < (0.7 if k == "nav" else 0.35)]
        self.r.shuffle(before)
        after = [self.chrome(k) for k in ("ad", "aside", "comments", "form", "notice") if self.r.random() < 0.35] + ([self.chrome("footer")] if self.r.random() < 0.8 else [])
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{self.article()}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int = 1):
    """n pages, each with its blocks' labels by text (1: main text)."""
    for i in range(n):
        w = Writer(seed * 1_000_003 + i)
        yield w.page(), w.truth
