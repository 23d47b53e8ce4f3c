"""HTML main-text extraction with a tree-structured graphical model.

Block elements are nodes with a hidden label, content or not. Each node emits its tag, the names in its class, id and role,
and buckets of its subtree's text length and link share; each child's label depends on its parent's. The tables are counted
from labelled pages. Sum-product messages go up from the leaves and down from the roots, all pages of a batch level by level,
and a block's text is kept where its content marginal is over one half.

Defined cases: null and empty html give empty text; unclosed, misnested or cut markup is read as browsers do in the
common cases (implied ends of p, li, cells; raw text of script and style); repeated pages are extracted each; very long
pages are handled whole.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from soldlens.llm._shared import map_arrow, text_of
from soldlens.llm.labelled_pages import pages as labelled_pages

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Fixed values of HTML: how elements behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr area".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body html nav aside form header footer blockquote".split())
LENGTHS = (1, 25, 80, 200, 1000)
SHARES = (0.05, 0.3, 0.7)


@dataclass
class Tree:
    """Nodes of one page in the order they open, and its text in page order."""

    tags: list[str]
    parents: list[int]
    names: list[list[str]]
    labels: list[int]
    own: list[int]
    linked: list[int]
    texts: list[tuple[int, str]]  # (node, raw text); node -1 is a break between blocks


def _attributes(raw: str) -> tuple[list[str], int]:
    names, label = [], -1
    for m in _ATTR.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1] == "data-y":
            label = int(value)
        else:
            for word in value.split():
                names.append(word)
                parts = _NAME.findall(word)
                if parts != [word]:
                    names += parts
    return list(dict.fromkeys(names)), label


def read(page: str) -> Tree:
    t = Tree(["#root"], [-1], [[]], [1], [0], [0], [])
    stack: list[tuple[str, int]] = [("#root", 0)]  # element, its node; inline elements share their block's node
    at, links = 0, 0

    def said(lo: int, hi: int) -> None:
        if hi > lo:
            node = stack[-1][1]
            text = page[lo:hi]
            t.texts.append((node, text))
            n = len(text.strip())
            t.own[node] += n
            if links:
                t.linked[node] += n

    def close(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            opened[tag] -= 1
            links -= tag == "a"
            if tag not in INLINE:
                t.texts.append((-1, ""))
        del stack[k:]

    n, last, begun, tags, opened = len(page), page.rfind(">"), 0, _TAG, Counter()
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:  # no tag closes any more
            said(begun, n)
            break
        at = lt + 1
        after = page[at : at + 2]
        if after[:1] in ("!", "?"):
            said(begun, lt)
            ends = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", at) + 1
            at = begun = ends if ends > lt + 1 else n
            continue
        if not after.lstrip("/")[:1].isalpha() or not after.isascii():
            continue  # no tag: part of the text
        m = tags.match(page, lt)
        if m is None and tags is _TAG:
            tags = _LOOSE_TAG  # a quote is left open: from here on quotes do not count, so no second look at the whole rest
            m = tags.match(page, lt)
        said(begun, lt)
        at = begun = m.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(0) if not opened[tag] else range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPE and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag == "br" or tag == "hr":
            t.texts.append((-1, ""))
            if tag == "br":
                continue
        if tag in ENDS_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, {"p"}) | {"p"}
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[k][0] in ends:
                    close(k)
                    if "p" in ends and len(ends) == 1:
                        break
                elif stack[k][0] in SCOPE:
                    break
        if tag in INLINE:
            if tag not in VOID:
                links += tag == "a"
                opened[tag] += 1
                stack.append((tag, stack[-1][1]))
            continue
        if tag in VOID:
            continue
        names, label = _attributes(m[3]) if "=" in m[3] else ([], -1)
        t.tags.append(tag)
        t.parents.append(stack[-1][1])
        t.names.append(names)
        t.labels.append(label)
        t.own.append(0)
        t.linked.append(0)
        t.texts.append((-1, ""))
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = begun = end.end() if end else n
        elif not m[3].endswith("/") or tag in ENDS_P:
            opened[tag] += 1
            stack.append((tag, len(t.tags) - 1))
    return t


class Forest:
    """Many trees as arrays: parents by global index, levels by depth."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = [len(t.tags) for t in trees]
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.tags = [x for t in trees for x in t.tags]
        self.names = [x for t in trees for x in t.names]
        parent = np.array([p for t in trees for p in t.parents], np.int64)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.starts[:-1], sizes))
        depth: list[int] = []
        for p in self.parent.tolist():  # parents open before their children
            depth.append(0 if p < 0 else depth[p] + 1)
        order = np.argsort(np.array(depth, np.int64), kind="stable")
        self.levels = np.split(order, np.searchsorted(np.array(depth, np.int64)[order], np.arange(1, max(depth, default=0) + 1)))
        length = np.array([x for t in trees for x in t.own], np.float64)
        linked = np.array([x for t in trees for x in t.linked], np.float64)
        for level in reversed(self.levels[1:]):
            np.add.at(length, self.parent[level], length[level])
            np.add.at(linked, self.parent[level], linked[level])
        self.length = np.searchsorted(LENGTHS, length, "right")
        self.share = np.where(length > 0, np.searchsorted(SHARES, linked / np.maximum(length, 1), "right"), len(SHARES) + 1)


@dataclass
class Model:
    """Log tables: label 0 is not content, label 1 is content."""

    tag: dict[str, np.ndarray]
    name: dict[str, np.ndarray]
    length: np.ndarray
    share: np.ndarray
    step: np.ndarray  # [parent's label, child's label]
    root: np.ndarray

    def emissions(self, f: Forest) -> np.ndarray:
        zero = np.zeros(2)
        out = np.array([self.tag.get(x, zero) for x in f.tags]).reshape(-1, 2)
        out += self.length[f.length] + self.share[f.share]
        known = self.name
        for i, names in enumerate(f.names):
            for x in names:
                if x in known:
                    out[i] += known[x]
        return out

    def marginals(self, f: Forest) -> np.ndarray:
        """P(content) of every node, by messages up and then down."""
        own = self.emissions(f)
        up = own.copy()
        sent = np.zeros_like(own)  # message of each node to its parent
        for level in reversed(f.levels[1:]):
            sent[level] = np.logaddexp(up[level, :1] + self.step[:, 0], up[level, 1:] + self.step[:, 1])
            np.add.at(up, f.parent[level], sent[level])
        belief = up.copy()
        belief[f.levels[0]] += self.root
        for level in f.levels[1:]:
            rest = belief[f.parent[level]] - sent[level]
            belief[level] += np.logaddexp(rest[:, :1] + self.step[0], rest[:, 1:] + self.step[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def train(pages: list[str]) -> Model:
    """Counts with add-half smoothing over pages whose blocks carry data-y; an unmarked block has its parent's label."""
    trees = [read(p) for p in pages]
    for t in trees:
        for i, y in enumerate(t.labels):
            if y < 0:
                t.labels[i] = t.labels[t.parents[i]]
    f = Forest(trees)
    y = np.array([x for t in trees for x in t.labels])
    n = np.bincount(y, minlength=2).astype(float)

    def logs(keys, values) -> dict:
        c = Counter(zip(keys, values, strict=True))
        kinds = set(keys)
        return {k: np.log([(c[k, v] + 0.5) / (n[v] + 0.5 * len(kinds)) for v in (0, 1)]) for k in kinds}

    step = np.full((2, 2), 0.5)
    inner = f.parent >= 0
    np.add.at(step, (y[f.parent[inner]], y[inner]), 1)
    flat = [(x, y[i]) for i, names in enumerate(f.names) for x in names]
    buckets = lambda b, k: np.array([np.log((np.bincount(b[y == v], minlength=k) + 0.5) / (n[v] + 0.5 * k)) for v in (0, 1)]).T
    return Model(logs(f.tags, y.tolist()), logs([a for a, _ in flat], [b for _, b in flat]), buckets(f.length, len(LENGTHS) + 1), buckets(f.share, len(SHARES) + 2), np.log(step / step.sum(1, keepdims=True)), np.log([0.01, 0.99]))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: list[str], model: Model) -> list[str]:
    if not pages:
        return []
    trees = [read(p) for p in pages]
    f = Forest(trees)
    keep = model.marginals(f) > 0.5
    out = []
    for t, start in zip(trees, f.starts.tolist(), strict=False):
        parts = [" " if node < 0 else (html_lib.unescape(text) if "&" in text else text) if keep[start + node] else "" for node, text in t.texts]
        out.append(" ".join("".join(parts).split()))
    return out


def main_text(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or default_model()
    source = pages.select("page_id", "url", text_of(html).alias("__html"))

    def run(batches):
        for batch in batches:
            texts = []
            for lo in range(0, batch.num_rows, 100):
                texts += extract(batch.column(2).slice(lo, 100).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(source, run, f"page_id {kind}, url string, text string, n_chars long")
