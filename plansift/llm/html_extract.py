"""Main text of web pages by a tree-structured graphical model over their elements and text runs.

Each node is content or not. Node potentials come from features of tag, names, text and links; edge potentials tie a child to its
parent. Sum-product messages up and down the tree give exact marginals; weights are fitted to labelled pages by the conditional
likelihood. Trees of many pages are worked on together, level by level.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plansift.llm.html_pages import labelled_pages
from plansift.llm.sampling import portions

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr del img picture source track area map math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose merror".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown as part of a page's text, or belongs to its head or to form fields.
SILENT = frozenset("script style noscript template title textarea select iframe object svg audio video canvas noframes head button option datalist".split())
RAW = frozenset("script style textarea title noscript iframe noframes".split())
#: What an opening tag ends: the innermost open elements of these kinds, no further than the bound.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KNOWN_TAGS = "html body div p h1 h2 h3 h4 h5 h6 ul ol li nav article section main header footer aside form table tr td th tbody blockquote pre figure figcaption dl dt dd fieldset details summary address center hr dialog menu".split()
#: Parts of class, id, role and itemprop values that are features.
HINTS = "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login register nav menu navbar navigation breadcrumb breadcrumbs sidebar side widget complementary footer copyright contentinfo header masthead comment comments reply replies respond discussion disqus share social related recommended recommendations popular more tags tag meta pagination pager toolbar search form skip content article articlebody post entry main story text body page wrapper container role:main role:article role:navigation role:banner role:contentinfo role:complementary role:search role:alert role:form itemprop:articlebody".split()
_tag_id = {t: k for k, t in enumerate(KNOWN_TAGS)}
_hint_id = {h: k for k, h in enumerate(HINTS)}
OTHER_TAG = len(KNOWN_TAGS)
TEXT = OTHER_TAG + 1
HINT_AT = TEXT + 1
SIZE_AT = HINT_AT + len(HINTS)
LINK_AT = SIZE_AT + 12
MORE_AT = LINK_AT + 2 * 6
FEATURES = MORE_AT + 6

TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[^>]*+(?:>|\Z)))", re.S)
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*")


class Page:
    """The tree of one page: parent, depth and features of each node; the text of text runs, None for elements."""

    def __init__(self, source: str):
        self.parent, self.depth, self.features, self.texts = [-1], [0], [[_tag_id["html"]]], [None]
        self.chars, self.linked = [0], [0]
        self._parse(source or "")
        self._aggregate()

    def _parse(self, source: str) -> None:
        stack = [(0, "html")]
        raw: list[tuple[str, bool]] = []
        link = 0  # the depth of the stack at an open <a>
        silent = 0
        at = 0
        closing: dict[str, re.Pattern] = {}

        def flush() -> None:
            if not raw:
                return
            text = " ".join("".join([t for t, _ in raw]).split())
            if text:
                linked = sum(len(t) for t, a in raw if a)
                self._node(stack[-1][0], [TEXT], text, min(len(text), linked))
            raw.clear()

        def close(depth: int) -> None:
            nonlocal link
            flush()
            del stack[depth:]
            if link > len(stack):
                link = 0

        while at < len(source):
            mark = source.find("<", at)
            if mark < 0:
                mark = len(source)
            if mark > at and not silent:
                raw.append((html.unescape(source[at:mark]), bool(link)))
            if mark == len(source):
                break
            found = TOKEN.match(source, mark)
            if not found:
                if not silent:
                    raw.append(("<", bool(link)))
                at = mark + 1
                continue
            at = found.end()
            if not found[2]:
                continue
            tag, ends = found[2].lower(), bool(found[1])
            if ends:
                if tag == "a":
                    link = 0
                elif tag == "br":
                    raw.append((" ", bool(link)))
                elif tag not in INLINE:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][1] == tag:
                            close(depth)
                            silent = sum(1 for _, t in stack if t in SILENT)
                            break
                continue
            if tag == "br":
                raw.append((" ", bool(link)))
                continue
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                continue
            if stack[-1][1] == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
                close(len(stack) - 1)
                silent = sum(1 for _, t in stack if t in SILENT)
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if tag not in closing:
                    closing[tag] = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I)
                end = closing[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in ("html", "body"):
                flush()
                continue
            if tag in ENDS:
                kinds, stop = ENDS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] in stop:
                        break
                    if stack[depth][1] in kinds:
                        close(depth)
                        break
            if stack[-1][1] == "p":
                close(len(stack) - 1)
            flush()
            if tag in SILENT:
                silent += 1
            names = [_tag_id.get(tag, OTHER_TAG)]
            if found[3]:
                for name, *value in NAMED.findall(found[3]):
                    before = f"{name.lower()}:" if name.lower() in ("role", "itemprop") else ""
                    for part in PARTS.findall("".join(value)) if not before else ["".join(value)]:
                        if (hint := _hint_id.get(before + part.lower())) is not None:
                            names.append(HINT_AT + hint)
            stack.append((self._node(stack[-1][0], names, None, 0), tag))
        flush()

    def _node(self, parent: int, features: list[int], text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.features.append(features)
        self.texts.append(text)
        self.chars.append(len(text) if text else 0)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _aggregate(self) -> None:
        chars, linked = self.chars, self.linked
        for k in range(len(self.parent) - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
        alone = sum(t is not None for t in self.texts) == 1
        for k, text in enumerate(self.texts):
            kind = int(text is None)
            more = self.features[k]
            if text is not None:
                more.append(SIZE_AT + min(11, max(6, chars[k].bit_length())))
            more.append(LINK_AT + 6 * kind + (min(5, -(-5 * linked[k] // chars[k])) if chars[k] else 0))
            if text is not None:
                more.append(MORE_AT + (text[-1] in ".!?…。:;\"”»"))
                if alone:
                    more.append(MORE_AT + 5)
                if "©" in text:
                    more.append(MORE_AT + 2)
                if self.parent[k] and _tag_id.get("p") in self.features[self.parent[k]]:
                    more.append(MORE_AT + 3)
            if chars[k] == 0:
                more.append(MORE_AT + 4)


class Forest:
    """The trees of several pages as arrays, with their nodes by level."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        first = np.cumsum([0, *sizes])
        self.first = first
        self.parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=False)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        lengths = np.array([len(f) for p in pages for f in p.features])
        self.ids = np.fromiter((x for p in pages for f in p.features for x in f), np.int64)
        self.row = np.repeat(np.arange(len(depth)), lengths)
        self.is_text = np.array([t is not None for p in pages for t in p.texts])
        self.n = len(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])


@dataclass
class Model:
    """weights: the log potential of content for each feature; edges[kind, parent's state, child's state]: log potentials, kind 1 for text runs."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, child's state) of each node's edge to its parent."""
        unary = np.zeros((f.n, 2))
        unary[:, 1] = np.bincount(f.row, self.weights[f.ids], f.n)
        up, sent = unary.copy(), np.zeros((f.n, 2))
        edge = self.edges[f.is_text.astype(int)]
        for level in f.levels[:0:-1]:
            sent[level] = np.logaddexp(edge[level, :, 0] + up[level, None, 0], edge[level, :, 1] + up[level, None, 1])
            for state in (0, 1):
                np.add.at(up[:, state], f.parent[level], sent[level, state])
        belief, pairs = up.copy(), np.zeros((f.n, 2, 2))
        for level in f.levels[1:]:
            from_above = belief[f.parent[level]] - sent[level]
            joint = from_above[:, :, None] + edge[level] + up[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            pairs[level] = np.exp(joint) / np.exp(joint).sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp(from_above[:, 0, None] + edge[level, 0], from_above[:, 1, None] + edge[level, 1])
            belief[level] = up[level] + down - down.max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pairs


def truth(page: Page, wanted: str) -> np.ndarray:
    """States of a page's nodes: a run is content if it comes next in the wanted text, an element if most of its text does."""
    rest = wanted.split("\n") if wanted else []
    state, good, at = np.zeros(len(page.texts), int), [0] * len(page.texts), 0
    for k, text in enumerate(page.texts):
        if text is not None and at < len(rest) and text == rest[at]:
            state[k], good[k], at = 1, len(text), at + 1
    if at < len(rest):
        raise ValueError("the wanted text isn't among the page's runs")
    for k in range(len(page.texts) - 1, 0, -1):
        good[page.parent[k]] += good[k]
        if page.texts[k] is None:
            state[k] = 2 * good[k] > page.chars[k]
    state[0] = 2 * good[0] > page.chars[0]
    return state


def fit(pages: list[tuple[str, str]], steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights that maximise the likelihood of the labelled pages' states, by Adam: seen less expected counts, from the marginals."""
    trees = [Page(source) for source, _ in pages]
    f = Forest(trees)
    y = np.concatenate([truth(t, wanted) for t, (_, wanted) in zip(trees, pages, strict=True)])
    model = Model(np.zeros(FEATURES), np.zeros((2, 2, 2)))
    inner = f.parent >= 0
    inner[f.first[:-1]] = False
    kind = f.is_text.astype(int)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[inner], y[f.parent[inner]], y[inner]), 1)
    m, v = [np.zeros(FEATURES), np.zeros((2, 2, 2))], [np.zeros(FEATURES), np.zeros((2, 2, 2))]
    for step in range(1, steps + 1):
        p, pairs = model.marginals(f)
        expected = np.stack([pairs[inner & (kind == k)].sum(axis=0) for k in (0, 1)])
        grads = [np.bincount(f.ids, (p - y)[f.row], FEATURES) / len(trees), (expected - seen) / len(trees)]
        for i, part in enumerate((model.weights, model.edges)):
            g = grads[i] + decay * part
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            part -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return model


@functools.cache
def default_model() -> Model:
    return fit(labelled_pages())


def texts(sources: list[str], model: Model) -> list[str]:
    """The content runs of each page, white space squeezed, joined by line feeds."""
    if not sources:
        return []
    pages = [Page(s) for s in sources]
    f = Forest(pages)
    p, _ = model.marginals(f)
    return ["\n".join([t for t, keep in zip(page.texts, p[a:b] >= 0.5, strict=True) if t is not None and keep]) for page, a, b in zip(pages, f.first[:-1], f.first[1:], strict=True)]


def extract(pages: DataFrame, model: Model | None = None, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns of keep, and text: the main text of every whole page, empty if it has none.

    A null page counts as empty. Pages without tags are one text run and judged by it. Broken markup (unclosed or misplaced tags, cut
    comments) is read as far as it goes. Rows may repeat; other columns don't matter; an empty table gives no rows.
    """
    model = model or default_model()
    rows = pages.select(key, *keep, source)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in portions(batches, 1 + len(keep), rows=256):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts(sources, model), pa.string())], [key, *keep, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
