"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .labelled_pages import labelled_pages

PAGES = 600  # labelled pages learned from
ROUNDS = 150

#: Element classes of HTML (fixed values).
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video title textarea".split())
RAW = frozenset("script style textarea title iframe xmp".split())
#: An open element of the first kind ends where one of the second begins.
ENDED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LEGAL = re.compile(r"©|\bcopyright\b|all rights reserved|\(c\) ?\d{4}", re.I)


def leaves(page: str) -> list[tuple[str, tuple[str, ...], tuple[str, ...], float]]:
    """A page's leaf blocks in order: text, open tags, names (class, id, role) of these, share of the text in links."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, unseen, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names), links / len(text)))
            parts.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal unseen
        while len(stack) > to:
            unseen -= stack.pop()[0] in UNSEEN

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not unseen:
            text = html.unescape(page[at:stop])
            parts.append(text)
            links += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    pop(i)
                    break
            continue
        if tag == "a":
            in_link = 1
        if tag in ("br", "wbr", "img", "td", "th"):
            parts.append(" ")
        if tag not in BLOCKS and tag not in UNSEEN:
            continue
        flush()
        if tag in VOID:
            continue
        in_link = 0 if tag in BLOCKS and tag not in ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6") else in_link
        while stack and tag in ENDED.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        if tag in ("li", "dt", "dd", "tr"):  # one that a list further up has open ends too
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ("ul", "ol", "dl", "table", "menu"):
                    break
                if tag in ENDED.get(stack[i][0], ()) and stack[i][0] != "p":
                    pop(i)
                    break
        names: list[str] = []
        for n in NAMES.finditer(m[3] or m[6] or ""):
            kind, value = n[1].lower(), n[2] or n[3] or n[4] or ""
            if kind in ("class", "id", "role"):
                names += [w.lower() for w in PIECES.findall(value)]
            elif kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value)):
                names.append("hidden-")
        stack.append((tag, tuple(names)))
        unseen += tag in UNSEEN
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            if not close:
                break
    flush()
    return out


def features(block, first: bool, last: bool) -> list[str]:
    text, tags, names, links = block
    words = text.count(" ") + 1
    out = ["bias", f"words={min(7, int(math.log2(words)))}", f"links={0 if links == 0 else 1 if links < 0.3 else 2 if links < 0.8 else 3}", f"own={tags[-1] if tags else ''}"]
    out += {f"in={t}" for t in tags}
    out += {f"name={n}" for n in names}
    out.append("stop" if text[-1] in ".!?…。”\"'»:" else "no-stop")
    if LEGAL.search(text):
        out.append("legal")
    if first:
        out.append("first")
    if last:
        out.append("last")
    if not {"article", "main", "section", "div"} & {*tags}:
        out.append("bare")
    return out


class Field:
    """Weights of a chain over two labels (1: main text): of each feature for label 1, and of each step."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps.tolist()

    def decode(self, blocks: list) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        get, (s00, s01), (s10, s11) = self.weights.get, *self.steps
        back, a, b = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            e = sum(get(f, 0.0) for f in features(block, i == 0, i == len(blocks) - 1))
            if i:
                to0, to1 = (a + s00, b + s10), (a + s01, b + s11)
                back.append((to0[1] > to0[0], to1[1] > to1[0]))
                a, b = max(to0), max(to1)
            b += e
        path = [int(b > a)]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, rounds: int = ROUNDS) -> Field:
    """A field fitted to labelled pages by gradient ascent on the conditional likelihood (forward-backward)."""
    rows = []
    for page, truth in labelled_pages(pages):
        blocks = leaves(page)
        rows.append(([features(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)], [truth[b[0]] for b in blocks]))
    names = sorted({f for fs, _ in rows for x in fs for f in x})
    index = {f: i for i, f in enumerate(names)}
    n, most = len(rows), max(len(y) for _, y in rows)
    x, y, on = np.zeros((most, n, len(names)), np.float32), np.zeros((most, n), int), np.zeros((most, n), bool)
    for j, (fs, labels) in enumerate(rows):
        for i, (own, label) in enumerate(zip(fs, labels)):
            x[i, j, [index[f] for f in own]], y[i, j], on[i, j] = 1, label, True
    w, s = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    flat = x.reshape(-1, len(names))
    for k in range(1, rounds + 1):
        e = np.zeros((most, n, 2))
        e[..., 1] = (flat @ w.astype(np.float32)).reshape(most, n)
        # forward and backward sums in logs; beyond a page's end nothing changes
        f, b = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        f[0] = e[0]
        for i in range(1, most):
            f[i] = np.where(on[i][:, None], np.logaddexp.reduce(f[i - 1][:, :, None] + s, axis=1) + e[i], f[i - 1])
        for i in range(most - 2, -1, -1):
            b[i] = np.where(on[i + 1][:, None], np.logaddexp.reduce(s + (e[i + 1] + b[i + 1])[:, None, :], axis=2), b[i + 1])
        z = np.logaddexp.reduce(f[-1], axis=1)
        p1 = np.where(on, np.exp(f[..., 1] + b[..., 1] - z), 0)
        gw = flat.T @ (np.where(on, y, 0) - p1).ravel().astype(np.float32) / n - 1e-3 * w
        both = np.exp(f[:-1][:, :, :, None] + s + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None]) * on[1:][:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][on[1:]], y[1:][on[1:]]), 1)
        gs = (seen - both.sum(axis=(0, 1))) / n - 1e-3 * s
        for at, g, m, v in ((w, gw, 0, 1), (s, gs, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[v] = 0.99 * moments[v] + 0.01 * g * g
            at += 0.1 * (moments[m] / (1 - 0.9**k)) / (np.sqrt(moments[v] / (1 - 0.99**k)) + 1e-8)
    return Field(dict(zip(names, w.tolist())), s)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaves(page or "")
    return "\n".join(b[0] for b, label in zip(blocks, field.decode(blocks)) if label)


def extractor(field: Field):
    def run(batches):
        for batch in batches:
            texts = [main_text(p, field) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, learn_from: int = PAGES) -> DataFrame:
    """Every page's main text.

    The field is trained on the driver on `learn_from` labelled pages (labelled_pages) and sent to the tasks; it is
    some hundred weights. Returns page_id, url, text (blocks joined by one newline, empty if none), n_chars (code
    points). Null html counts as empty; markup cut short is read as far as it goes; repeated rows and null ids stay;
    an empty table gives no rows; other columns are left out.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extractor(trained(learn_from)), "page_id long, url string, text string, n_chars long")


def op2_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
