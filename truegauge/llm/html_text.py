"""Main text of web pages: flat text blocks, described by words and link density of themselves and their neighbours, judged by a decision tree.

A page is read tag by tag into blocks (runs of text between block-level tags). Each block has its number of words, the share of its words inside links, the same two numbers of the
blocks before and after it, whether it is a heading, and whether its innermost telling container speaks for (article, main, ...) or against it (nav, footer, aside, form, adverts,
comments, ...). A small tree, grown on the labelled table below, tells article from the rest. Names that tell what a container has or how it looks (has-sidebar,
share-enabled) say nothing of its text. Containers of other names in ``BAD_NAMES`` lose their text, but for article and main elements inside.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import ready

TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S
)
RAW = frozenset("script style noscript template textarea svg annotation iframe object select button title option datalist canvas audio video".split())
#: Of these, the ones that swallow the rest of the page if they are never closed; the text of others ends with the next block-level tag.
TO_END = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p"
    " pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("address article aside body blockquote center details dialog div dl fieldset figure footer form head header main menu nav ol section table ul td".split())
AGAINST = frozenset("nav footer aside form menu dialog fieldset head".split())
FOR = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: Parts of class, id and role names that speak against or for a container.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer footnav gdpr"
    " header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted promotion related respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription tags teaser toc toolbar topbar widget alert".split()
)
#: First and last parts of names that tell how a container looks or what it has, not what it is (has-sidebar, share-enabled).
STATES = frozenset("has with without no is hide show hidden".split()), frozenset("enabled disabled on off open closed left right layout visible hidden none".split())
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())

#: words, link density, words before, link density before, words after, link density after, container (-1, 0, 1), heading, article
LABELLED = (
    (40, 0.0, 6, 0.0, 60, 0.0, 1, 0, 1), (1, 0.0, 30, 0.0, 25, 0.0, 1, 0, 1), (3, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1), (8, 0.0, 5, 1.0, 50, 0.0, 1, 1, 1), (25, 0.2, 40, 0.0, 30, 0.1, 1, 0, 1),
    (2, 0.0, 3, 0.0, 4, 0.0, 1, 0, 1), (120, 0.1, 20, 0.0, 4, 1.0, 1, 0, 1), (6, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (3, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0), (5, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0),
    (6, 0.9, 80, 0.0, 8, 1.0, 1, 0, 0), (9, 0.4, 30, 0.0, 40, 0.0, 1, 0, 1), (4, 0.0, 2, 0.0, 40, 0.0, 1, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (14, 0.5, 60, 0.0, 70, 0.0, 1, 0, 1),
    (50, 0.0, 40, 0.0, 30, 0.0, -1, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, -1, 0, 0), (7, 0.0, 60, 0.0, 0, 0.0, -1, 0, 0), (12, 0.0, 2, 1.0, 8, 0.0, -1, 0, 0), (3, 0.0, 40, 0.0, 40, 0.0, -1, 1, 0),
    (25, 0.3, 5, 1.0, 5, 1.0, -1, 0, 0), (1, 0.0, 0, 0.0, 90, 0.0, -1, 0, 0), (80, 0.0, 4, 1.0, 60, 0.0, -1, 0, 0), (15, 0.1, 15, 0.0, 15, 0.0, -1, 0, 0), (200, 0.0, 3, 0.0, 3, 0.0, -1, 0, 0),
    (45, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1), (22, 0.0, 3, 1.0, 35, 0.0, 0, 0, 1), (70, 0.1, 8, 0.0, 2, 1.0, 0, 0, 1), (18, 0.0, 40, 0.0, 3, 0.0, 0, 0, 1), (30, 0.2, 0, 0.0, 25, 0.0, 0, 0, 1),
    (100, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (26, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (16, 0.1, 20, 0.0, 20, 0.0, 0, 0, 1), (6, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1), (3, 0.0, 30, 0.0, 30, 0.0, 0, 0, 1),
    (9, 0.0, 25, 0.0, 20, 0.0, 0, 0, 1), (7, 0.0, 2, 1.0, 50, 0.0, 0, 1, 1), (5, 0.0, 40, 0.0, 45, 0.0, 0, 1, 1), (10, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1), (3, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 1.0, 30, 0.0, 3, 1.0, 0, 0, 0), (12, 0.9, 8, 1.0, 9, 1.0, 0, 0, 0), (30, 0.8, 10, 1.0, 10, 1.0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0), (6, 0.5, 3, 1.0, 40, 0.0, 0, 0, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (7, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0),
    (15, 0.7, 40, 0.0, 30, 0.0, 0, 0, 0), (1, 1.0, 50, 0.0, 50, 0.0, 0, 0, 0), (10, 0.6, 30, 0.0, 5, 1.0, 0, 0, 0), (2, 0.0, 5, 1.0, 5, 1.0, 0, 0, 0), (6, 0.0, 4, 0.5, 3, 0.5, 0, 0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """Decision tree by Gini impurity: ``(feature, threshold, below, above)``, or a leaf's label."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return int(share >= 0.5)
    best = (2.0, None, None)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            parts = [labels[low], labels[~low]]
            worth = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts) / len(labels)
            if worth < best[0] - 1e-12:
                best = (worth, f, cut)
    if best[1] is None:
        return int(share >= 0.5)
    low = rows[:, best[1]] < best[2]
    return best[1], float(best[2]), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def trained():
    table = np.array(LABELLED, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def _judge(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def _stance(name: str, attributes: str, around: int) -> int:
    """What a container says about its text; 0 leaves it to the containers around."""
    if name in AGAINST:
        return -1
    named = [[p.lower() for p in PART.findall(n)] for m in NAMES.finditer(attributes) for n in m[1].split()] if attributes else []
    bad = any(n[0] not in STATES[0] and n[-1] not in STATES[1] and not BAD_NAMES.isdisjoint(n) for n in named if n)
    good = any(not GOOD_NAMES.isdisjoint(n) for n in named)
    if name in ("body", "html") or bad and good:
        bad = good = False
    if name == "header":
        bad = around != 1
    if name in FOR:
        return -1 if bad else 1
    return -1 if bad else 1 if good else 0


def blocks_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words in links, stance, heading, inside an article or main element) of every non-empty block of a page, in order."""
    out: list[tuple[str, int, int, int, bool]] = []
    stack: list[tuple] = []
    marks: list[tuple[int, int | None]] = []
    claims: list[int] = []
    unclosed: set[str] = set()
    muted: int | None = None  # stance of the block that an unclosed element cuts short
    pieces: list[str] = []
    linked, link, heading, at = 0, 0, 0, 0
    stance, inner = 0, False
    #: Containers around whose names alone speak against their text, whether a tag does, the claim and whether an article is around.
    doubt, hard, claim, told = 0, False, None, False

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, linked, stance, heading, inner))
                marks.append((doubt, claim))
            pieces.clear()
        linked = 0

    def take(text: str, decode: bool = True):
        nonlocal linked
        if text:
            text = html.unescape(text) if decode and "&" in text else text
            pieces.append(text)
            linked += len(text.split()) if link else 0

    while m := TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            take(m[1], False)
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name in RAW and not closing and not attributes.endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name in ("title", "button", "option", "select", "textarea", "noscript"):
                flush()
            if end or name in TO_END:
                at = end.end() if end else len(page)
                continue
            unclosed.add(name)
            flush()
            muted = stance if muted is None else muted
            stance = -1
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if muted is not None:
            stance, muted = muted, None
        link = 0
        heading = int(name in HEADINGS and not closing)
        if name in CONTAINERS:
            if not closing:
                around = stance
                own = _stance(name, attributes, around)
                stack.append((name, around, doubt, hard, claim, told, inner))
                if around == -1 and own == 1 and name in FOR and not hard and not (told and name == "article"):
                    # A name such as has-sidebar may stand on a wrapper: main and article inside speak for themselves.
                    stance = 1
                    if name == "article":
                        claim = len(claims)
                        claims.append(doubt)
                else:
                    # Else what speaks against a text holds for all inside.
                    stance = -1 if around == -1 and name not in ("body",) else own or around
                    if own == -1:
                        by_tag = name in AGAINST or name == "header"
                        doubt, hard = doubt + (not by_tag), hard or by_tag
                told = told or name == "article" and stance == 1
                inner = inner or name in FOR and stance == 1
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        _, stance, doubt, hard, claim, told, inner = stack[i]
                        del stack[i:]
                        break
    rest = page[at:]
    take(rest if not re.match(r"<[a-zA-Z/!]", rest) else "")
    flush()
    return _settle(out, marks, claims) if claims else out


def _settle(blocks: list[tuple[str, int, int, int, bool]], marks: list[tuple[int, int | None]], claims: list[int]) -> list[tuple[str, int, int, int, bool]]:
    """Articles inside containers whose names speak against them (comments and teasers are often articles) lose against more words in less doubtful places."""
    words = [len(b[0].split()) - b[1] for b in blocks]
    stances = [b[2] for b in blocks]
    levels, own = defaultdict(int), defaultdict(int)
    for (doubt, claim), n, stance in zip(marks, words, stances):
        if stance == 1 and claim is not None:
            own[claim] += n
        elif stance >= 0:
            levels[doubt] += n
    lost = set()
    for i in sorted(range(len(claims)), key=lambda i: claims[i]):
        if sum(n for doubt, n in levels.items() if doubt < claims[i]) > own[i]:
            lost.add(i)
        else:
            levels[claims[i]] += own[i]
    return [(b[0], b[1], -1 if claim in lost else b[2], *b[3:]) for b, (_, claim) in zip(blocks, marks)]


def article(page: str | None, tree) -> str:
    """Article text of a page: accepted blocks, joined by line feeds.

    What stands in an article or main element that nothing speaks against is article, links and all. Where such elements hold more words than all
    undecided blocks outside them, those are none of it; else the tree decides.
    """
    blocks = blocks_of(page or "")
    words = lambda which: sum(len(b[0].split()) - b[1] for b in blocks if which(b))
    found = words(lambda b: b[4] and b[2] == 1)
    whole = found > 0 and found > words(lambda b: b[2] == 0)
    size = [(len(b[0].split()), b[1] / max(1, len(b[0].split()))) for b in blocks]
    edge = (0, 0.0)
    kept = []
    for i, (text, _, stance, heading, inner) in enumerate(blocks):
        if stance == 1 and inner or whole and stance == 0:
            kept += [text] if stance else []
            continue
        before, after = size[i - 1] if i else edge, size[i + 1] if i + 1 < len(blocks) else edge
        if _judge(tree, (*size[i], *before, *after, stance, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text`` (main text, empty if there is none) and ``n_chars``, its characters.

    NULL and empty pages have an empty text. Malformed markup never fails: an unclosed comment, script, style, title or textarea swallows the rest, other unclosed elements the rest of their block, a stray ``<`` is text. NULL keys and
    repeated rows pass through; other columns are left out. Rows are handled alone, no shuffle.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(markup).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        tree = trained()
        for batch in batches:
            text = [article(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
