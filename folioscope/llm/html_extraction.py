"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Text between block tags is a block; its path is the chain of open tags with
their class words, from the root. For every path of a page, text length and punctuation are summed over its blocks
and related to the number of tags in them: two ratios. Each is smoothed along the page by a Gaussian over neighbouring
blocks of the same parent. Their product is fused with a weight for paths inside `<article>` or `<main>`, in logs, and
paths at `THRESHOLD` times the page's highest or more hold content.

Paths through menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments never hold content,
whatever their ratios: their tags and class or id words are the fixed values below.

Unclosed tags are closed as browsers do: `p` by the next block, `li` by the next `li`, and an end tag closes what is open
inside it. Character references are decoded; white space inside a block becomes one space; blocks are joined by one
space in page order. `br` is white space, inline tags are nothing.

Defined results: null or empty pages give an empty text, as do pages without content. A cut-off page gives what it holds;
text that ends in an open tag or comment drops that tag. Repeated pages are read each; extra columns stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
SIGMA = 1.0
CONTAINER = 27.6  # log of 1e12, above any product of ratios

# Fixed values.
BLOCK_TAGS = set(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("script style textarea title noscript iframe xmp noembed noframes template".split())
NEVER_TAGS = set(
    "script style head title noscript template iframe object embed svg math canvas audio video select option button input "
    "textarea label form fieldset nav menu footer aside dialog header search".split())
NEVER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners promo promoted promotion sponsor sponsored "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot sidebar side aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion reviews share sharing social related recommended "
    "recommendations masthead topbar toolbar skip copyright legal disclaimer form search hidden".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = BLOCK_TAGS - {"body", "head", "html", "title", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
CLOSES_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PUNCTUATION = re.compile(r"[.,;:!?…\"“”„«»()¿¡-]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """A path step, the tag with its class and id words, and whether the step bars content."""
    barred = tag in NEVER_TAGS
    if not attributes or not attributes.strip():
        return tag, barred
    names = []
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            barred |= value in NEVER_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            barred = True
        elif name in ("class", "id"):
            names += value.split()
    words = {word for name in names for word in re.split(r"[^a-z0-9]+", re.sub(r"\d+$", "", name)) if word}
    if tag not in ("html", "body", "article", "main"):
        barred |= bool(words & NEVER_WORDS)
    return ".".join([tag, *sorted(names)]), barred


def blocks(page: str) -> list[tuple[str, bool, bool, str, int]]:
    """(path, barred, inside article or main, text, tags) of every block with text, in page order."""
    found, text, tags = [], [], 0
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]

    def close_block() -> None:
        nonlocal text, tags
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            inner = next(step for step in reversed(stack) if step[0] in BLOCK_TAGS or not step[0])
            found.append((inner[1], stack[-1][2], inner[3], whole, tags))
        text, tags = [], 0

    def pop_to(depth: int) -> None:
        close_block()
        del stack[depth:]

    def open_at(names: set[str], stops: set[str]) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in stops:
                return 0
        return 0

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            text.append(page[at:])
            break
        text.append(page[at:token.start()])
        at = token.end()
        tag = (token[1] or token[2] or token[5] or "").lower()
        if not tag:
            continue
        tags += 1
        if token[1]:
            depth = open_at({tag}, set())
            if tag == "br" or not depth:
                text.append(" " if tag in BLOCK_TAGS or tag == "br" else "")
            elif tag in BLOCK_TAGS or any(step[0] in BLOCK_TAGS for step in stack[depth:]) or stack[-1][2]:
                pop_to(depth)
            else:
                del stack[depth:]
            continue
        attributes = token[3] if token[2] else token[6]
        step, barred = _label(tag, attributes)
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK_TAGS:
            close_block()
            if tag in CLOSES_P and (depth := open_at({"p"}, {"table", "td", "th", "button", "object", "caption"})):
                del stack[depth:]
            if tag in CLOSES_SAME and (depth := open_at({tag} | ({"dt", "dd"} if tag in ("dt", "dd") else set()) | ({"td", "th"} if tag in ("td", "th") else set()), CLOSES_SAME[tag])):
                del stack[depth:]
        if tag in VOID_TAGS or attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        if barred and not stack[-1][2]:
            close_block()
        inside = stack[-1][3] or tag in ("article", "main")
        stack.append((tag, f"{stack[-1][1]}/{step}" if tag in BLOCK_TAGS else stack[-1][1], stack[-1][2] or barred, inside))
    close_block()
    return found


def path_scores(found: list[tuple[str, bool, bool, str, int]]) -> dict[str, float]:
    """Fused score of every path: the sum of the logs of its smoothed ratios, and of its container's weight."""
    paths = [block[0] for block in found]
    names, at = np.unique(paths, return_inverse=True)
    tags = np.bincount(at, weights=[block[4] + 1.0 for block in found], minlength=len(names))
    parents = np.array([path.rpartition("/")[0] for path in paths])
    fused = np.array([CONTAINER if block[2] else 0.0 for block in found])
    for values in ([len(block[3]) for block in found], [len(PUNCTUATION.findall(block[3])) for block in found]):
        ratio = (np.bincount(at, weights=np.array(values, dtype=float), minlength=len(names)) / tags)[at]
        smooth, weight = ratio.copy(), np.ones(len(ratio))
        for step in (1, 2):
            share = np.exp(-step * step / (2 * SIGMA * SIGMA))
            same = parents[step:] == parents[:-step]
            smooth[step:] += share * ratio[:-step] * same
            weight[step:] += share * same
            smooth[:-step] += share * ratio[step:] * same
            weight[:-step] += share * same
        fused += np.log1p(smooth / weight)
    best: dict[str, float] = {}
    for path, score in zip(paths, fused, strict=True):
        best[path] = max(best.get(path, 0.0), float(score))
    return best


def main_text(page: str | None) -> str:
    """The blocks of the page's content paths, joined by one space."""
    found = [block for block in blocks(page or "") if not block[1]]
    if not found:
        return ""
    scores = path_scores(found)
    cut = THRESHOLD * max(scores.values())
    return " ".join(block[3] for block in found if scores[block[0]] >= cut)


def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extracted(pages: DataFrame) -> DataFrame:
    """`pages` with `text`, the main text of `html`; a column of that name is replaced."""
    return pages.withColumn("text", F.pandas_udf(_main_texts, "string")(F.coalesce("html", F.lit(""))))
