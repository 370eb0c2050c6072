"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. Each node is described by its tag, depth, attribute tokens and those of its
ancestors, the text, links and density of its subtree, and its place among its siblings; boosted trees give the
probability that it is part of the article. Decoding is hierarchical: the labels of a page's nodes are chosen together,
of least total cost, such that below boilerplate everything is boilerplate and below the article nothing is neutral, so
an ancestor and a descendant never contradict each other. The trees are trained here, on the driver, on pages that this
module generates (``TRAINING_PAGES`` of them, a fixed seed), whose parts are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import struct, table

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 500, 60, 4, 0.2, 24
#: Nodes that a task describes at once (a page's own are not split).
MOST_NODES = 20_000

#: A tag's name, and what of a tag lies outside and inside quotes up to its end.
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)")
QUOTED = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
#: Elements without text of the page: of the first ones all is skipped to their end tag or the end of the page, of the
#: second ones only if they have an end tag.
SKIPPED = frozenset("script style title template noscript".split())
SKIPPED_IF_CLOSED = frozenset("svg textarea select button iframe object canvas datalist".split())
CLOSE = {t: re.compile(rf"</{t}\s*+>", re.I) for t in SKIPPED | SKIPPED_IF_CLOSED}
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Block elements by kind; a kind is a feature.
KINDS = {
    "text": "p pre blockquote figure figcaption address dd dt", "heading": "h1 h2 h3 h4 h5 h6", "item": "li tr td th option", "list": "ul ol dl table tbody thead",
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "article": "article main", "division": "div section center details summary hgroup", "form": "form fieldset legend label", "page": "html body head",
}
KIND = {t: k for k, tags in enumerate(KINDS.values()) for t in tags.split()}
NAMES = list(KINDS)
#: What a start tag ends if it is the innermost open block.
ENDED = {"p": {t for t in KIND if t not in ("html", "body", "head", "label", "option")}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

#: Attribute tokens by what they hint at.
HINTS = {
    "content": "article content main post entry story text body blog page news inhalt artikel beitrag contenido articulo cuerpo contenu texte corps",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs header masthead topbar logo menue kopf navegacion cabecera entete",
    "side": "sidebar side aside widget related recommended trending popular more tags links toolbar share social footer copyright bottom seitenleiste rand fuss lateral pie pied barre",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion werbung anzeige publicidad anuncio publicite annonce",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter signup login form search contentinfo",
    "comment": "comment comments commentlist reply replies respond discussion disqus reviews kommentar kommentare comentario comentarios commentaire commentaires",
}
HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}

FEATURES = [*(f"kind {k}" for k in KINDS), *(f"hint {h}" for h in HINTS), *(f"above kind {k}" for k in KINDS), *(f"above hint {h}" for h in HINTS),
            "depth", "own text", "subtree text", "share of page", "link share", "text per node", "nodes", "marks per word", "letters per word", "place", "siblings", "alike siblings", "text before", "text after", "symbols"]


@dataclass
class Page:
    """A page's block nodes in document order, and its text blocks with the node each belongs to."""

    kind: list[int]
    parent: list[int]
    hints: list[int]  # bits
    depth: list[int]
    above: list[int]  # bits of the kinds, then of the hints, of all ancestors
    end: list[int]  # the node after the last of the subtree
    text: list[list[float]]  # per node: characters, of them in links, words, marks, symbols
    blocks: list[tuple[int, str]]


def tags_and_texts(source: str) -> Iterator[tuple[str | None, str, str]]:
    """(text, "", "") and (None, tag with a / if it ends, attributes), in page order, in one forward pass.

    Nothing is looked for again in what has been found to lack it, so the time is linear in the page's length whatever
    is left unclosed. A quote that is never closed is an ordinary character.
    """
    at, n, quotes, lacking = 0, len(source), True, set()
    while at < n:
        start = source.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield source[at:start], "", ""
        if start == n:
            return
        m = TAG.match(source, start)
        if m is None:
            following = source[start + 1 : start + 4]
            if following == "!--":
                end, width = source.find("-->", start + 4), 3
            elif following[:1] in ("!", "?") or (following[:1] == "/" and following[1:2] in ("!", "?")):
                end, width = source.find(">", start), 1
            else:
                yield "<", "", ""
                at = start + 1
                continue
            at = n if end < 0 else end + width
            continue
        end = QUOTED.match(source, m.end()).end() if quotes else -1
        if not 0 <= end < n or source[end] != ">":
            quotes = quotes and 0 <= end < n and source[end] not in "'\""
            end = source.find(">", m.end())
        if end < 0:  # an unfinished tag ends the page
            return
        tag, attributes, at = m[2].lower(), source[m.end() : end], end + 1
        if not m[1] and tag in CLOSE and tag not in lacking and not (tag == "svg" and attributes.endswith("/")):
            close = CLOSE[tag].search(source, at)
            if close:
                at = close.end()
            elif tag in SKIPPED:
                return
            else:
                lacking.add(tag)
            continue
        yield None, m[1] + tag, attributes


def parse(source: str | None) -> Page:
    page = Page([KIND["body"]], [-1], [0], [0], [0], [0], [[0.0] * 5], [])
    stack, tags, pieces, link, linked = [0], ["body"], [], False, 0
    opened = dict.fromkeys(KIND, 0)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                node = stack[-1]
                page.blocks.append((node, text))
                t = page.text[node]
                t[0] += len(text)
                t[1] += min(linked, len(text))
                t[2] += text.count(" ") + 1
                t[3] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                t[4] += text.count("|") + text.count("©") + text.count("·") + text.count("»")
            pieces, linked = [], 0

    def leave() -> str:
        page.end[stack.pop()] = len(page.kind)
        tag = tags.pop()
        opened[tag] -= 1
        return tag

    for piece, tag, attributes in tags_and_texts(source or ""):
        if piece is not None:
            pieces.append(piece)
            if link:
                linked += len(piece)
            continue
        ends = tag[0] == "/"
        tag = tag[1:] if ends else tag
        if tag == "a":
            link = not ends
        elif tag in ("br", "hr"):
            pieces.append(" ")
            if tag == "hr":
                flush()
        elif "-" in tag:  # an element of the page's own makes
            pieces.append(" ")
        elif tag in KIND:
            flush()
            link = False
            if ends:
                if opened[tag]:
                    while leave() != tag:
                        pass
                continue
            if tag in ("html", "body", "head"):
                continue
            while len(stack) > 1 and tag in ENDED.get(tags[-1], ()):
                leave()
            bits = 0
            if attributes:
                for a in ATTRIBUTE.finditer(attributes):
                    for word in re.split(r"[^a-z]+", (a[1] or a[2] or a[3] or "").lower()):
                        if word in HINT:
                            bits |= 1 << HINT[word]
            up = stack[-1]
            page.kind.append(KIND[tag])
            page.parent.append(up)
            page.hints.append(bits)
            page.depth.append(page.depth[up] + 1)
            page.above.append(page.above[up] | 1 << page.kind[up] | page.hints[up] << len(KINDS))
            page.end.append(0)
            page.text.append([0.0] * 5)
            stack.append(len(page.kind) - 1)
            tags.append(tag)
            opened[tag] += 1
    flush()
    for node in stack:
        page.end[node] = len(page.kind)
    return page


def describe(pages: list[Page]) -> np.ndarray:
    """The features of all nodes of some pages, in order. A node's subtree is a range of nodes, so its sums are differences."""
    size = np.array([len(p.kind) for p in pages])
    base = np.repeat(np.cumsum(size) - size, size)
    kind, parent, hints, above, depth, end = (np.concatenate([getattr(p, part) for p in pages]).astype(np.int64) for part in ("kind", "parent", "hints", "above", "depth", "end"))
    root = parent < 0
    up = np.where(root, np.arange(len(kind)), parent + base)
    own = np.array([t for p in pages for t in p.text])
    upto = np.vstack([np.zeros(own.shape[1]), own.cumsum(axis=0)])
    total = upto[end + base] - upto[:-1]
    nodes = end + base - np.arange(len(kind))
    n_kinds, n_hints = len(KINDS), len(HINTS)
    kinds = np.eye(n_kinds)[kind]
    hinted = (hints[:, None] >> np.arange(n_hints)) & 1
    above_k = (above[:, None] >> np.arange(n_kinds)) & 1
    above_h = (above[:, None] >> np.arange(n_kinds, n_kinds + n_hints)) & 1
    children = np.bincount(up[~root], minlength=len(kind))
    order = np.lexsort((np.arange(len(kind)), np.where(root, -1, up)))
    first = np.ones(len(kind), dtype=bool)
    first[1:] = up[order][1:] != up[order][:-1]
    first |= root[order]
    start = np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
    place = np.empty(len(kind))
    place[order] = np.arange(len(kind)) - start
    before, after = np.zeros(len(kind)), np.zeros(len(kind))
    same = ~first[1:]
    before[order[1:][same]] = total[order[:-1][same], 0]
    after[order[:-1][same]] = total[order[1:][same], 0]
    _, group, many = np.unique(up * (n_kinds + 1) + kind + root * 10**12, return_inverse=True, return_counts=True)
    alike = many[group]
    whole = np.maximum(total[base, 0], 1)
    log = lambda x: np.log1p(np.maximum(x, 0))
    words = np.maximum(total[:, 2], 1)
    rest = [depth, log(own[:, 0]), log(total[:, 0]), total[:, 0] / whole, total[:, 1] / np.maximum(total[:, 0], 1), log(total[:, 0] / nodes), log(nodes), total[:, 3] / words, total[:, 0] / words, place, children[up], alike, log(before), log(after), np.minimum(total[:, 4], 5)]
    return np.column_stack([kinds, hinted, above_k, above_h, *rest])


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete trees of one depth: per tree the features and limits of its inner nodes and the values of its leaves."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            score += v[at - (len(v) - 1)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting of the logistic loss with histogram splits (second order, leaf penalty 1)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    share = np.average(y, weights=weight)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(len(y), base), 2**depth - 1
    features, limits, values = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for d in range(depth):
            start, n = 2**d - 1, 2**d
            local = at - start
            gain, best_f, best_b = np.zeros(n), np.zeros(n, dtype=np.int64), np.full(n, -1)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                slot = local * (BINS + 1) + binned[:, f]
                gl = np.bincount(slot, weights=g, minlength=n * (BINS + 1)).reshape(n, -1).cumsum(1)
                hl = np.bincount(slot, weights=h, minlength=n * (BINS + 1)).reshape(n, -1).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                got = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                got[(hl < 1) | (ht - hl < 1)] = 0
                b = got[:, : len(cuts[f])].argmax(1)
                v = got[np.arange(n), b]
                better = v > gain + 1e-9
                gain[better], best_f[better], best_b[better] = v[better], f, b[better]
            for i in range(n):
                if best_b[i] >= 0:
                    features[k, start + i], limits[k, start + i] = best_f[i], cuts[best_f[i]][best_b[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), features[k, at]] > limits[k, at])
        leaf = at - inner
        values[k] = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        score += values[k][leaf]
    return Trees(features, limits, values, base)


# ---------------------------------------------------------------- decoding

NEUTRAL, ARTICLE, BOILERPLATE = 0, 1, 2


def decode(page: Page, probability: np.ndarray) -> list[int]:
    """The labels of least cost: below boilerplate only boilerplate, below the article no neutral node."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    n = len(yes)
    cost = [[0.4 + (1.5 if page.text[i][0] else 0.0), yes[i], no[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        c, up = cost[i], cost[page.parent[i]]
        up[NEUTRAL] += min(c)
        up[ARTICLE] += min(c[ARTICLE], c[BOILERPLATE])
        up[BOILERPLATE] += c[BOILERPLATE]
    label = [0] * n
    label[0] = min((NEUTRAL, ARTICLE, BOILERPLATE), key=lambda s: cost[0][s])
    for i in range(1, n):
        up = label[page.parent[i]]
        may = (BOILERPLATE,) if up == BOILERPLATE else (ARTICLE, BOILERPLATE) if up == ARTICLE else (NEUTRAL, ARTICLE, BOILERPLATE)
        label[i] = min(may, key=lambda s: cost[i][s])
    return label


# ---------------------------------------------------------------- training pages


#: Layouts: paragraphs as such; as divisions with spans; as cells of a table; among figures; without class names; with those
#: of other languages.
FAMILIES = ("plain", "divisions", "cells", "figures", "bare", "foreign")
#: Of how many training pages each layout has its share.
SHARES = (0.5, 0.14, 0.06, 0.1, 0.1, 0.1)
#: Class names of parts of pages in other languages.
ABROAD = {"menu": ("menue", "navegacion", "hauptmenue"), "ad": ("werbung", "anzeige", "publicidad", "publicite"), "side": ("seitenleiste", "barra lateral", "barre laterale"), "comment": ("kommentar", "comentario", "commentaire"), "foot": ("fuss", "pie", "pied"), "text": ("inhalt", "artikel-text", "contenido", "contenu", "cuerpo")}


def generate(rng: random.Random, family: str = "plain") -> tuple[str, list[str]]:
    """A page of random layout, and the texts of its article's blocks."""
    abroad = family == "foreign"
    syllables = [rng.choice("bcdfghlmnprstvwz") + rng.choice("aeiouäéñ") + rng.choice(["", "n", "r", "s", "th"]) for _ in range(60)]
    marks = rng.random()

    def sentence(low: int, high: int) -> str:
        words = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(low, high))]
        for i in range(len(words) - 1):
            if rng.random() < 0.08:
                words[i] += ","
            if marks < 0.1 and rng.random() < 0.5:
                words[i] += rng.choice(("%%%", "***", "$$$", "!!", "&amp;&amp;"))
        return " ".join(words).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))

    def prose(most: int = 6) -> str:
        return " ".join(sentence(1, 25) for _ in range(rng.choice((1, 1, 2, rng.randint(1, most)))))

    def attrs(*names: str) -> str:
        if family == "bare":
            return ""
        return f' {rng.choice(("class", "id", "class"))}="{rng.choice(names)}"' if names and rng.random() < 0.75 else ""

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{sentence(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def advert() -> str:
        tag = rng.choice(("div", "div", "aside", "section"))
        return f'<{tag}{attrs(*(ABROAD["ad"] if abroad else ("ad", "ads", "advert", "banner", "sponsored", "promo-box")))}>{rng.choice((sentence(2, 20), f"<p>{sentence(2, 20)}</p>", f"<a href=/x>{sentence(2, 12)}</a>"))}</{tag}>' if rng.random() < 0.9 else ""

    def menu() -> str:
        tag = rng.choice(("nav", "nav", "div", "header"))
        hint = attrs("menu", "navbar", "nav", "breadcrumbs", "top-navigation") if tag == "nav" else f' class="{rng.choice(ABROAD["menu"] if abroad else ("menu", "navbar", "main-nav"))}"'
        return f"<{tag}{hint}>{links(rng.randint(2, 9))}</{tag}>"

    def notice() -> str:
        return f'<div class="{rng.choice(("cookie-notice", "consent", "notice", "gdpr-banner", "popup", "alert"))}"><p>{sentence(4, 30)}</p>{rng.choice(("", "<button>Ok</button>"))}</div>'

    def form() -> str:
        return f'<form{attrs("search", "newsletter", "signup", "login")}><label>{sentence(1, 4)}</label><input name=q>{rng.choice(("", f"<p>{sentence(2, 12)}</p>"))}<button>{sentence(1, 2)}</button></form>'

    def sidebar() -> str:
        tag = rng.choice(("aside", "div"))
        hint = attrs("sidebar", "widget", "related", "trending") if tag == "aside" else f' class="{rng.choice(ABROAD["side"] if abroad else ("sidebar", "side widget", "related-posts"))}"'
        return f"<{tag}{hint}><h3>{sentence(1, 4)}</h3>{rng.choice((links(rng.randint(2, 6)), f'<p>{prose(3)}</p>'))}</{tag}>"

    def comments() -> str:
        items = "".join(f'<{t}{attrs("comment", "reply")}><p>{prose(4)}</p></{t}>' for t in [rng.choice(("div", "li", "article"))] for _ in range(rng.randint(1, 5)))
        tag = rng.choice(("section", "div"))
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(ABROAD["comment"] if abroad else ("comments", "comment-list", "discussion", "reader-comments"))}"><h3>{sentence(1, 3)}</h3>{items}</{tag}>'

    def footer() -> str:
        body = rng.choice((f"&copy; {sentence(1, 4)} &middot; {sentence(2, 14)}", f"<p>{sentence(3, 20)}</p>{links(3)}", f"{sentence(1, 30)}"))
        return f"<footer>{body}</footer>" if rng.random() < 0.8 else f'<div class="{rng.choice(ABROAD["foot"] if abroad else ("footer", "page-footer", "copyright"))}">{body}</div>'

    texts: list[str] = []

    def kept(markup: str, text: str) -> str:
        texts.append(" ".join(html.unescape(text).split()))
        return markup

    def block(t: str) -> str:
        """A paragraph as this layout writes it."""
        if family == "divisions":
            return rng.choice((f"<div>{t}</div>", f"<div><span>{t}</span></div>", f"<div{attrs('absatz', 'par', 'row')}><span>{t}</span></div>"))
        if family == "cells":
            return f"<tr><td>{t}</td></tr>"
        return f"<p>{t}</p>" if rng.random() < 0.9 else f"<p>{t}"

    def article() -> str:
        out = []
        if rng.random() < 0.9:
            t = sentence(2, 12)
            out.append(kept(f"<h1>{t}</h1>" if family != "divisions" or rng.random() < 0.6 else f"<div{attrs('titel', 'big')}>{t}</div>", t))
        for _ in range(rng.choice((1, 1, 2, 3, 5, 9, 15))):
            r, t = rng.random(), prose()
            if family == "figures" and r < 0.3:
                t = sentence(2, 14)
                out.append(kept(f"<figure><img src=x><figcaption>{t}</figcaption></figure>", t))
            elif family == "cells" and r < 0.36:
                out.append(kept(block(t), t))
            elif r < 0.12:
                t = sentence(1, 10)
                out.append(kept(f"<p><b>{t}<br>" if rng.random() < 0.5 else f"<h2>{t}</h2>", t))
            elif r < 0.2:
                items = [sentence(2, 14) for _ in range(rng.randint(2, 5))]
                out.append("<ul>" + "".join(kept(f"<li>{i}</li>", i) for i in items) + "</ul>")
            elif r < 0.25:
                out.append(kept(f"<blockquote>{t}</blockquote>", t))
            elif r < 0.3:
                a, b = sentence(2, 9), sentence(2, 9)
                out.append(kept(f'<p>{a} <a href="/y">{b}</a> {t}</p>', f"{a} {b} {t}"))
            elif r < 0.36:
                out.append(rng.choice((advert, form, sidebar, notice))())
            else:
                out.append(kept(block(t), t))
        tag, hint = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry text"), ("section", "story")))
        if family in ("bare", "divisions") and tag in ("div", "section"):
            hint = ""
        elif abroad and hint:
            hint = rng.choice(ABROAD["text"])
        if family == "cells":
            out = [out[0], "<table>", *out[1:], "</table>"] if out and not out[0].startswith("<tr") else ["<table>", *out, "</table>"]
        return f'<{tag}{f" class={chr(34)}{hint}{chr(34)}" if hint else ""}>{"".join(out)}{comments() if rng.random() < 0.1 else ""}</{tag}>'

    head = [part() for part, p in ((notice, 0.2), (menu, 0.85), (advert, 0.6), (form, 0.15)) if rng.random() < p]
    rng.shuffle(head)
    if rng.random() < 0.3:
        head.insert(0, f"<header><h1>{sentence(1, 4)}</h1><p>{sentence(2, 8)}</p></header>")
    tail = [part() for part, p in ((sidebar, 0.4), (comments, 0.35), (advert, 0.3), (form, 0.2), (notice, 0.1)) if rng.random() < p]
    rng.shuffle(tail)
    body = "".join(head) + article() + "".join(tail) + (footer() if rng.random() < 0.9 else "")
    if rng.random() < 0.3:
        body = f'<div{attrs("page", "wrapper", "container")}>{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><style>p{{}}</style></head><body>{body}" + rng.choice(("</body></html>", "")), texts


@lru_cache(maxsize=8)
def trained(without: str | None = None) -> Trees:
    """The trees, from nodes labelled by where their text lies; containers of both kinds teach nothing.

    ``without`` names a layout that is left out, to see how pages of a kind that was never shown fare.
    """
    rng = random.Random(7)
    families = [f for f in FAMILIES if f != without]
    shares = [s for f, s in zip(FAMILIES, SHARES, strict=True) if f != without]
    pages, labels, weights = [], [], []
    for _ in range(TRAINING_PAGES):
        source, texts = generate(rng, rng.choices(families, shares)[0])
        page, left = parse(source), list(texts)
        good = [0.0] * len(page.kind)
        for node, text in page.blocks:
            if left and text == left[0]:
                left.pop(0)
                good[node] += len(text)
        total = [t[0] for t in page.text]
        for i in range(len(good) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            total[page.parent[i]] += total[i]
        share = [g / t if t else 0.0 for g, t in zip(good, total, strict=True)]
        pages.append(page)
        labels += [s > 0.5 for s in share]
        weights += [1.0 if t and (s < 0.02 or s > 0.75) else 0.0 for s, t in zip(share, total, strict=True)]
    x, y, w = describe(pages), np.array(labels, dtype=float), np.array(weights)
    return boost(x[w > 0], y[w > 0], w[w > 0])


def main_texts(sources: Iterable[str | None], trees: Trees) -> Iterator[str]:
    """The main text of each page: blocks in page order, joined by a line break. Holds the nodes of a few pages."""
    pages, nodes = [], 0

    def decided() -> Iterator[str]:
        p, at = trees.probability(describe(pages)), 0
        for page in pages:
            label = decode(page, p[at : at + len(page.kind)])
            at += len(page.kind)
            yield "\n".join(text for node, text in page.blocks if label[node] == ARTICLE)

    for source in sources:
        pages.append(parse(source))
        nodes += len(pages[-1].kind)
        if nodes >= MOST_NODES:
            yield from decided()
            pages, nodes = [], 0
    if pages:
        yield from decided()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars (its code points).

    Null or empty html gives an empty text. Time is linear in a page's length, however deep it nests and whatever it leaves
    unclosed. Null ids and urls stay null; repeated rows give repeated rows; other columns
    are ignored. White space inside a block, line breaks of ``<br>`` included, becomes one space.
    """
    trees = trees or trained()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(main_texts(batch["html"], trees))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]})

    # ids go as text: a batch with nulls would turn large ones into floats
    slim = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = slim.mapInPandas(texts, struct("page_id string, url string, text string, n_chars long"))
    return found.withColumn("page_id", F.col("page_id").cast("long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
