"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of blocks, text between the borders of block elements. A block's features are its own
and its neighbours' word counts and link densities, and whether it lies inside an element that is marked as
content or as boilerplate. A small labelled table of blocks trains the tree.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared

MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)|<[!?/][^>]*+>?""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose text is never shown as text. Without an end tag, those in TO_END reach to the end of the page or of its
#: head, as in browsers, and of others only the tag goes. A head's own elements are in RAW or VOID, so it needs no rule.
RAW = frozenset("script style noscript template iframe title textarea select canvas audio video annotation annotation-xml".split())
TO_END = frozenset("script style noscript template iframe title textarea".split())
HEAD_END = r"|</head\b[^>]*>?|(?=<body\b)"
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT_TAG = frozenset("article main".split())
#: Whole names that mark content in pages without such an element.
CONTENT_NAME = frozenset("content main-content maincontent page-content post-content entry-content article-content article-body articlebody post-body entry story story-body post article main".split())
HAS_CONTENT_TAG = re.compile(r"<(?:article|main)[\s/>]", re.I)
BOILER_TAG = frozenset("nav footer header aside form menu dialog button fieldset".split())
COMMENT_NAME = frozenset("comment comments commentlist disqus replies reply respond responses discussion".split())
BOILER_NAME = COMMENT_NAME | frozenset(
    "ad ads adv advert advertisement adverts advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar side footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login register search searchbox share sharing social related recommended "
    "pagination pager widget copyright legal disclaimer skip toc contentinfo complementary search-form".split()
)
WORDS = re.compile(shared.WORD)

#: Labelled blocks, of which no two columns alone decide: words and link density of the block, of the one before and of the one after; its place (2 in a
#: content element, 0 outside, 1 in a page without one); inside a boilerplate element; it is main text.
LABELLED = np.array(
    [
        # outside the page's content element, marked as boilerplate or not
        (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0), (1, 1.0, 2, 1.0, 12, 0.0, 0, 1, 0),
        (12, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (8, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0), (40, 0.0, 3, 1.0, 7, 0.0, 0, 1, 0),
        (10, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0), (25, 0.1, 70, 0.0, 0, 0.0, 0, 1, 0), (60, 0.0, 30, 0.0, 12, 0.0, 0, 1, 0),
        (6, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0), (30, 0.2, 90, 0.0, 5, 0.8, 0, 0, 0), (70, 0.0, 90, 0.0, 4, 0.0, 0, 0, 0),
        (1, 0.0, 20, 0.0, 40, 0.0, 0, 0, 0), (12, 0.0, 8, 0.0, 9, 0.0, 0, 0, 0), (45, 0.0, 25, 0.0, 60, 0.0, 0, 0, 0),
        (100, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0), (3, 1.0, 4, 1.0, 2, 1.0, 0, 0, 0), (22, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0),
        # in it: what isn't boilerplate inside it
        (9, 0.0, 12, 0.0, 70, 0.0, 2, 0, 1), (1, 0.0, 45, 0.0, 60, 0.0, 2, 0, 1), (3, 0.0, 9, 0.0, 5, 0.0, 2, 0, 1),
        (45, 0.0, 9, 0.0, 33, 0.0, 2, 0, 1), (120, 0.0, 40, 0.0, 10, 0.0, 2, 0, 1), (200, 0.05, 90, 0.0, 9, 0.0, 2, 0, 1),
        (20, 0.3, 60, 0.0, 50, 0.1, 2, 0, 1), (6, 0.5, 60, 0.0, 50, 0.0, 2, 0, 1), (2, 1.0, 60, 0.0, 40, 0.0, 2, 0, 1),
        (15, 0.0, 8, 0.0, 0, 0.0, 2, 0, 1), (80, 0.0, 7, 0.0, 11, 0.0, 2, 0, 1), (5, 0.0, 10, 0.0, 9, 0.0, 2, 0, 1),
        (4, 0.0, 3, 1.0, 2, 0.0, 2, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 2, 0, 1), (6, 0.3, 5, 0.4, 7, 0.2, 2, 0, 1),
        (10, 0.0, 2, 0.9, 3, 0.6, 2, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 2, 0, 1), (1, 0.0, 2, 1.0, 1, 1.0, 2, 0, 1),
        (30, 0.7, 60, 0.1, 50, 0.0, 2, 0, 1), (2, 1.0, 9, 0.0, 70, 0.0, 2, 0, 1), (5, 1.0, 90, 0.0, 0, 0.0, 2, 0, 1),
        (2, 1.0, 20, 0.0, 5, 0.0, 2, 0, 1), (3, 1.0, 12, 0.0, 14, 0.0, 2, 0, 1), (2, 1.0, 6, 0.0, 30, 0.0, 2, 0, 1),
        (6, 1.0, 8, 0.0, 9, 0.2, 2, 0, 1), (1, 1.0, 25, 0.1, 10, 0.0, 2, 0, 1), (3, 1.0, 15, 0.0, 0, 0.0, 2, 0, 1),
        (4, 0.6, 5, 0.0, 6, 0.5, 2, 0, 1), (12, 1.0, 70, 0.0, 80, 0.0, 2, 0, 1), (9, 0.8, 0, 0.0, 20, 0.0, 2, 0, 1),
        (4, 0.0, 20, 0.0, 3, 1.0, 2, 0, 1), (7, 0.0, 60, 0.0, 2, 1.0, 2, 0, 1), (8, 0.45, 12, 0.0, 5, 1.0, 2, 0, 1),
        (10, 0.4, 30, 0.0, 3, 1.0, 2, 0, 1), (60, 0.4, 30, 0.0, 6, 1.0, 2, 0, 1), (5, 0.2, 2, 1.0, 4, 1.0, 2, 0, 1),
        (6, 0.0, 40, 0.0, 0, 0.0, 2, 0, 1), (9, 0.0, 30, 0.0, 0, 0.0, 2, 0, 1), (8, 0.2, 5, 0.0, 0, 0.0, 2, 0, 1),
        (4, 0.3, 70, 0.0, 0, 0.0, 2, 0, 1), (11, 0.4, 2, 1.0, 0, 0.0, 2, 0, 1), (5, 0.0, 90, 0.0, 0, 0.0, 2, 0, 1),
        # but bare links in a row are a menu wherever they lie
        (2, 1.0, 2, 1.0, 3, 1.0, 2, 0, 0), (1, 1.0, 40, 0.0, 2, 1.0, 2, 0, 0), (3, 1.0, 2, 1.0, 0, 0.0, 2, 0, 0),
        (3, 1.0, 2, 1.0, 50, 0.0, 2, 0, 0), (8, 1.0, 9, 1.0, 7, 1.0, 2, 0, 0), (12, 0.95, 10, 1.0, 11, 1.0, 2, 0, 0),
        (4, 1.0, 0, 0.0, 3, 1.0, 2, 0, 0), (6, 1.0, 2, 0.0, 8, 1.0, 2, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 2, 0, 0),
        (2, 1.0, 20, 0.0, 3, 1.0, 2, 0, 0), (6, 1.0, 5, 1.0, 9, 0.0, 2, 0, 0), (3, 1.0, 60, 0.0, 4, 1.0, 2, 0, 0),
        (2, 1.0, 3, 1.0, 80, 0.0, 2, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (12, 1.0, 70, 0.0, 9, 1.0, 2, 0, 0),
        (7, 1.0, 12, 1.0, 30, 0.0, 2, 0, 0), (15, 1.0, 14, 0.95, 0, 0.0, 2, 0, 0), (9, 1.0, 35, 0.0, 11, 0.95, 2, 0, 0),
        (14, 0.0, 80, 0.0, 60, 0.0, 2, 1, 0), (50, 0.0, 80, 0.0, 60, 0.0, 2, 1, 0), (3, 1.0, 60, 0.0, 3, 1.0, 2, 1, 0),
        (3, 1.0, 50, 0.0, 30, 0.0, 2, 1, 0), (1, 1.0, 20, 0.0, 40, 0.0, 2, 1, 0), (6, 0.9, 50, 0.0, 0, 0.0, 2, 1, 0),
        (2, 1.0, 9, 0.2, 12, 0.0, 2, 1, 0), (8, 1.0, 70, 0.0, 60, 0.0, 2, 1, 0), (4, 1.0, 6, 0.0, 5, 0.1, 2, 1, 0),
        (30, 0.0, 20, 0.0, 22, 0.0, 2, 1, 0), (2, 0.0, 30, 0.0, 30, 0.0, 2, 1, 0), (100, 0.0, 4, 0.0, 0, 0.0, 2, 1, 0),
        # pages without a content element: long blocks with few links, and short ones between such
        (1, 1.0, 0, 0.0, 1, 1.0, 1, 1, 0), (12, 0.0, 2, 1.0, 40, 0.0, 1, 1, 0), (60, 0.0, 20, 0.0, 40, 0.0, 1, 1, 0),
        (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 1, 0, 0), (20, 0.9, 3, 1.0, 5, 1.0, 1, 0, 0),
        (30, 0.7, 20, 0.5, 20, 0.6, 1, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0), (7, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0),
        (6, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0), (9, 0.3, 4, 0.5, 0, 0.0, 1, 0, 0), (5, 0.6, 40, 0.0, 6, 0.7, 1, 0, 0),
        (45, 0.0, 30, 0.0, 25, 0.0, 1, 0, 1), (25, 0.0, 40, 0.0, 60, 0.0, 1, 0, 1), (120, 0.02, 7, 0.0, 50, 0.0, 1, 0, 1),
        (90, 0.1, 60, 0.0, 8, 0.0, 1, 0, 1), (35, 0.15, 2, 1.0, 40, 0.0, 1, 0, 1), (8, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1),
        (3, 0.0, 40, 0.0, 45, 0.0, 1, 0, 1), (6, 0.0, 33, 0.0, 70, 0.1, 1, 0, 1), (50, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1),
        (2, 1.0, 2, 1.0, 0, 0.0, 1, 0, 0), (1, 1.0, 3, 0.0, 0, 0.0, 1, 0, 0), (3, 0.9, 60, 0.0, 0, 0.0, 1, 0, 0), (4, 1.0, 30, 0.0, 40, 0.0, 1, 0, 0),
        (16, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1), (18, 0.0, 40, 0.0, 3, 1.0, 1, 0, 1), (30, 0.0, 50, 0.0, 0, 0.0, 1, 0, 1), (25, 0.0, 2, 1.0, 0, 0.0, 1, 0, 1),
        (5, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1), (8, 0.0, 2, 1.0, 45, 0.0, 1, 0, 1), (4, 0.0, 3, 1.0, 60, 0.0, 1, 0, 1), (14, 0.0, 33, 0.0, 2, 1.0, 1, 0, 1),
        (22, 0.0, 28, 0.0, 30, 0.0, 1, 0, 1), (28, 0.2, 60, 0.0, 60, 0.0, 1, 0, 1), (70, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    ]
)


class Tree:
    """Binary classification by axis-parallel cuts that lower the Gini impurity most."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value, self.cut = int(2 * y.sum() > len(y)), None
        if depth and 0 < y.sum() < len(y):
            gini = lambda v: 2 * v.mean() * (1 - v.mean())
            tried = []
            for f in range(x.shape[1]):
                u = np.unique(x[:, f])
                for c in (u[1:] + u[:-1]) / 2:
                    low = x[:, f] < c
                    tried.append((low.sum() * gini(y[low]) + (~low).sum() * gini(y[~low]), f, c))
            if tried and min(tried)[0] < len(y) * gini(y) - 1e-12:
                _, f, c = min(tried)
                low = x[:, f] < c
                self.cut, self.below, self.above = (f, c), Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, row) -> int:
        at = self
        while at.cut:
            at = at.below if row[at.cut[0]] < at.cut[1] else at.above
        return at.value


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(LABELLED[:, :-1], LABELLED[:, -1])


def names(attributes: str) -> set[str]:
    """The words of an element's class, id and role."""
    out = set()
    for m in NAMES.finditer(attributes):
        for name in re.split(r"\s+", (m[2] or m[3] or m[4] or "").lower()):
            out.add(name)
            out.update(re.split(r"[-_]", name))
    return out


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Text, words, words in links, in a content element, in a boilerplate element, of each block with a word."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, int, int]] = []  # element, and content and boilerplate elements down to it
    text, linked, links, at, content, boiler = [], [], 0, 0, 0, 0

    def close():
        nonlocal text, linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                n = whole.count(" ") + 1
                out.append((whole, n, min(n, len(" ".join(linked).split())), content > 0, boiler > 0))
        text, linked = [], []

    def add(s: str):
        if s:
            s = html.unescape(s) if "&" in s else s
            text.append(s)
            if links:
                linked.append(s)

    end, by_name = len(page), HAS_CONTENT_TAG.search(page) is None
    head, missing = False, set()  # missing: elements without an end tag from here on
    while at < end:
        m = MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        head = not m[1] if tag == "head" else head and tag in IN_HEAD
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or (stack[k - 1][1:] if k else (0, 0)) != (content, boiler):
                        close()
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    content, boiler = stack[-1][1:] if stack else (0, 0)
                    break
            else:
                if tag in BLOCK:
                    close()
            continue
        if tag == "head":
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                found = None if tag in missing else re.compile(rf"</{tag}\b[^>]*>?" + (HEAD_END if head and tag == "title" else ""), re.I).search(page, at)
                if found is None:
                    missing.add(tag)
                    if tag in TO_END:
                        found = re.compile(HEAD_END[1:], re.I).search(page, at) if head else None
                        at = end if found is None else at
                at = found.end() if found else at
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            close()
        if tag in VOID or m[3].endswith("/>"):
            continue
        attributes = m[3]
        called = names(attributes) if len(attributes) > 1 else ()
        is_content = tag in CONTENT_TAG or by_name and tag in ("div", "section", "td") and any(x in CONTENT_NAME for x in called)
        marks = COMMENT_NAME if is_content else BOILER_NAME
        is_boiler = tag in BOILER_TAG or tag not in ("html", "body") and (any(x in marks for x in called) or len(attributes) > 1 and HIDDEN.search(attributes) is not None)
        if is_boiler and tag not in BLOCK:
            close()
        content, boiler = content + is_content, boiler + is_boiler
        stack.append((tag, content, boiler))
        links += tag == "a"
    close()
    return out


def main_text(page: str | None) -> str:
    """The blocks that the tree takes as main text, joined by an empty line."""
    found = blocks(page or "")
    has = any(b[3] for b in found)
    own = [(b[1], b[2] / b[1]) for b in found]
    around = [(0, 0.0), *own, (0, 0.0)]
    decide = tree().predict
    return "\n\n".join(b[0] for k, b in enumerate(found) if decide((*own[k], *around[k], *around[k + 2], 1 if not has else 2 * b[3], b[4])))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text, and n_chars, its code points, in place of html_col.

    A null or empty page, and one without main text, gives an empty text. Marks that never end reach to the
    page's end. Other columns stay; those named as the new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    schema = pages.select(*kept).withColumn(text_col, F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def get(batches):
        for batch in batches:
            for part in shared.slices(batch, html_col):
                texts = [main_text(x) for x in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, text_col, "n_chars"])

    return shared.spread(pages).mapInArrow(shared.tidy(get), schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`: page_id, url, text, n_chars."""
    return extract(shared.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html")))
