"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is content or not.  A node's
potential comes from features of the element (kind, names in its attributes,
text, links); an edge's potential couples parent and child.  Sum-product
messages pass from the leaves up and from the root down, which gives each
node's exact probability of being content; the pages of a batch pass their
messages level by level together.  The weights are trained on the labelled
pages of ``labelled`` by gradient ascent of the conditional likelihood, whose
gradient is the features under the labels less those under the marginals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import PAGES
from .pagetree import Page, parse

# fixed values: kinds of elements, and words that name parts of pages
KINDS = (
    ("article", "main"), ("p", "blockquote", "pre", "figcaption", "dd", "dt"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("li",),
    ("ul", "ol", "dl", "menu"), ("div", "section", "figure", "center"), ("nav",), ("header",), ("footer",), ("aside", "dialog"),
    ("form", "fieldset", "button", "legend", "option"), ("table", "tbody", "thead", "tr", "td", "th"), ("body",),
)
CHROME = frozenset(
    "ad adbox ads advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs button buttons comment commentlist comments complementary consent contentinfo cookie cookiebanner cookiebar cookies copyright dialog disqus foot footer form gdpr header infobar login masthead menu modal nav navbar navigation navmenu newsletter notice notices notification notifications overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup site skyscraper social sponsor sponsored subnav subscribe tags teaser toolbar topbar topnav userbar widget widgets".split()
)
BODY = frozenset("article articlebody blogpost body content entry main maincontent post prose story text".split())

#: Elements that divide a page.
_BOXES = frozenset((*KINDS[0], *KINDS[4], *KINDS[5], *KINDS[6], *KINDS[7], *KINDS[8], *KINDS[9], *KINDS[10], *KINDS[11]))
#: Share of a page's prose that makes an element with a heading its main part.
RICH = 0.5
FEATURES = len(KINDS) + 10
STEPS, RATE, DECAY = 400, 0.5, 1e-3
BATCH_PAGES = 256


def features(page: Page) -> np.ndarray:
    """One row per block.

    A name is evidence, not a fact: it doesn't count against an ``article`` or
    ``main`` element, nor against an element that holds an article and most of
    the page's prose.  What stands beside an article or beside most of the prose
    under a heading, whatever its name, is ``apart``: by how much it has less
    text than that.  Sections aren't, as they divide articles too.
    """
    n = len(page.tag)
    own, pieces, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for block, text in page.pieces:
        own[block] += len(text)
        pieces[block] += 1
        stops[block] += text[-1] in ".!?…”\""
    linked, kids = np.minimum(np.array(page.linked, dtype=float), own), np.zeros(n)
    prose = np.where([tag in KINDS[1] for tag in page.tag], own - linked, 0.0)
    heads = np.array([tag in ("h1", "h2") for tag in page.tag], dtype=float)
    below, below_linked, below_prose, below_heads = own.copy(), linked.copy(), prose, heads
    marked = [bool(names & CHROME) for names in page.names]
    holds = np.array([tag in KINDS[0] and not m for tag, m in zip(page.tag, marked)])
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        below[up] += below[i]
        below_linked[up] += below_linked[i]
        below_prose[up] += below_prose[i]
        below_heads[up] += below_heads[i]
        holds[up] |= holds[i]
        kids[up] += 1
    plain = below - below_linked
    # holds much of the page's prose, and a heading or an article
    rich = ((below_heads > 0) | holds) & (below_prose > 0) & (below_prose > RICH * below_prose[0])
    best = np.zeros(n)  # text of the richest child that holds prose under a heading, or an article
    for i in range(1, n):
        if (rich[i] or holds[i]) and page.tag[i] in _BOXES:
            best[page.parent[i]] = max(best[page.parent[i]], plain[i])
    out = np.zeros((n, FEATURES))
    inside, main, apart = np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n)
    for i, (tag, names) in enumerate(zip(page.tag, page.names)):
        out[i, _KIND.get(tag, len(KINDS))] = 1
        up = page.parent[i]
        within = i > 0 and inside[up] > 0
        chrome = marked[i] and (within or not (tag in KINDS[0] or (rich[i] and holds[i])))
        main[i] = tag in KINDS[0] or bool(names & BODY) or (i > 0 and main[up])
        # a header outside the main part is the site's; inside, it has the article's title
        inside[i] = chrome or tag in ("nav", "footer", "aside", "form") or (tag == "header" and not main[i]) or within
        if i and not main[i]:
            beside = tag in _BOXES and tag != "section" and best[up] > 0 and not (rich[i] or holds[i])
            apart[i] = max(apart[up], 1 - min(1, plain[i] / best[up]) if beside else 0)
        out[i, -9] = chrome
        out[i, -8] = bool(names & BODY) and not chrome
    out[:, -7] = inside
    out[:, -6] = apart
    out[:, -5] = np.minimum(1, np.log1p(below) / 8)
    out[:, -4] = below_linked / np.maximum(1, below)
    out[:, -3] = stops > 0
    out[:, -2] = own == 0
    out[:, -1] = 1
    return out


_KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags}


class Forest:
    """Pages side by side: node arrays, and the nodes of each depth below 0."""

    def __init__(self, pages: Sequence[Page]):
        self.starts = np.cumsum([0, *(len(p.tag) for p in pages)])
        self.features = np.concatenate([features(p) for p in pages])
        self.parent = np.concatenate([np.array(p.parent) + (np.array(p.parent) >= 0) * s for p, s in zip(pages, self.starts)])
        depth = np.zeros(len(self.parent), dtype=np.int64)
        for i, up in enumerate(self.parent.tolist()):
            if up >= 0:
                depth[i] = depth[up] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)[1:]


def marginals(forest: Forest, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of every node, and P(parent = a, child = b) of every node but the roots' (which stay 0).

    ``edge[a, b]`` is the log potential of parent a and child b.
    """
    n = len(forest.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = forest.features @ weights
    up = np.zeros((n, 2))
    for level in reversed(forest.levels):
        up[level] = np.logaddexp(edge[:, 0] + belief[level, :1], edge[:, 1] + belief[level, 1:])
        np.add.at(belief, forest.parent[level], up[level])
    pair = np.zeros((n, 2, 2))
    for level in forest.levels:
        parent = forest.parent[level]
        rest = belief[parent] - up[level]
        joint = rest[:, :, None] + edge + belief[level][:, None, :]
        joint -= np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None]
        pair[level] = np.exp(joint)
        belief[level] += np.logaddexp(rest[:, :1] + edge[0], rest[:, 1:] + edge[1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def train(pages: Sequence[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials from pages whose ``data-y`` attributes mark content (1) and the rest (0).

    A label holds for the element and what is in it, unless marked otherwise;
    a page's own label is 0.  The result is the same at every call.
    """
    parsed = [parse(p) for p in pages]
    forest = Forest(parsed)
    y = np.array([float(v or 0) for p in parsed for v in p.label])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    weights, edge, n = np.zeros(FEATURES), np.zeros((2, 2)), len(y)
    for _ in range(steps):
        p, pair = marginals(forest, weights, edge)
        weights += RATE * (10 * forest.features.T @ (y - p) / n - DECAY * weights)
        edge += RATE * (10 * (seen - pair.sum(axis=0)) / n - DECAY * edge)
    return weights, edge


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(PAGES)


def extract(pages: Sequence[str], weights: np.ndarray, edge: np.ndarray) -> list[str]:
    """Main text of each page: the pieces of its content blocks, one a line."""
    parsed = [parse(p, labels=False) for p in pages]
    forest = Forest(parsed)
    p, _ = marginals(forest, weights, edge)
    return ["\n".join(text for block, text in page.pieces if p[start + block] > 0.5) for page, start in zip(parsed, forest.starts)]


def extract_pages(pages: DataFrame, html: str = "html", into: str = "text", trained: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``pages`` with column ``into``: the main text; other columns pass through.

    A null or empty page, and one without content, gives the empty text.
    Repeated pages give repeated rows.  A column named like ``into`` is replaced.
    """
    weights, edge = trained or model()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            values = s.fillna("").tolist()
            found = [t for i in range(0, len(values), BATCH_PAGES) for t in extract(values[i : i + BATCH_PAGES], weights, edge)]
            yield pd.Series(found, dtype=object)

    return pages.withColumn(into, text(F.col(html)))


def extraction_report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    weights, edge = model()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BATCH_PAGES):
                b = batch.slice(i, BATCH_PAGES)
                found = extract([h or "" for h in b.column(2).to_pylist()], weights, edge)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(of, "page_id long, url string, text string, n_chars long")
