"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of the page. The length of each line's text counts as nothing where markup
says that it is not the article: menus, forms, adverts, comments, links. Lengths are summed over a sliding window of lines;
where the sum surges the text begins, where it dives to nothing the text ends, and what lies between is kept. An article or
main element is also one window as a whole, whose surge needs half the length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOW = 3  # lines per sum
SURGE = 80  # characters in a window that begin a text

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for name in ("script", "style", "textarea", "iframe")}  # text up to the end tag
EMPTIED = frozenset("noscript template svg object select button".split())  # dropped up to the end tag, if there is one
NESTING = frozenset("template svg object".split())
PAIRED = re.compile(r"<(/?)(" + "|".join(sorted(EMPTIED)) + r")(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("head nav footer aside header form menu dialog".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# A class or id is noise if its parts are these words (the first kind never names what holds an article, the second may
# by its layout) ...
NEVER = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|comments?|commentlist|disqus|respond|repl(?:y|ies)", re.I)
NOISE = re.compile(
    NEVER.pattern + r"|banners?|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footer|header|masthead|notices?|newsletter|subscribe|signup|login|share|sharing|"
    r"social|related|recommend\w*|widgets?|toolbar|pagination|pager", re.I)
# ... and words of place and shape, which tell nothing by themselves.
PLACE = re.compile(
    r"\d+(?:x\d+)?|top|bottom|left|right|main|primary|secondary|site|page|global|mobile|desktop|sticky|fixed|inner|outer|box|bar|block|wrap|wrapper|container|area|section|panel|"
    r"group|row|col|column|list|lists|item|items|link|links|button|buttons|icon|icons|slot|unit|text|title|body|form|message|posts?|articles?|entry|blog|user|reader|stories", re.I)
OWN_HEADER = re.compile(r"(?:posts?|articles?|entry|blog)[-_]header", re.I)


def _named_noise(names: str, noise: re.Pattern) -> bool:
    for name in names.split():
        parts = [part for part in re.split(r"[-_]+", name) if part]
        if any(map(noise.fullmatch, parts)) and all(noise.fullmatch(part) or PLACE.fullmatch(part) for part in parts) and not OWN_HEADER.fullmatch(name):
            return True
    return False


def _noisy(name: str, attributes: str, noise: re.Pattern) -> bool:
    """Whether an element's attributes say that it is not the article; of classes and ids those made of `noise`."""
    given: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(attributes):  # one after the other, so that a value is never taken for a name
        given.setdefault(key.lower(), next((v for v in values if v), ""))  # of a repeated name the first counts
    return name not in ("html", "body") and bool(
        _named_noise(given.get("class", ""), noise) or _named_noise(given.get("id", ""), noise) or given.get("role", "").strip().lower() in ROLES or "hidden" in given
        or given.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I))


def _ends(page: str) -> dict[int, int]:
    """Where the elements of EMPTIED end, by where they begin: those that have an end tag. One that cannot hold its like
    ends nowhere if another begins first."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for tag in PAIRED.finditer(page):
        name, open_ = tag[2].lower(), begun.setdefault(tag[2].lower(), [])
        if tag[1]:
            if open_:
                ends[open_.pop()] = tag.end()
        elif tag[3][-1:] != "/":
            if name not in NESTING:
                open_.clear()
            open_.append(tag.start())
    return ends


def lines_of(page: str, noise: re.Pattern = NOISE) -> list[tuple[str, int, int]]:
    """Blocks in page order: text, characters outside links, number of the outermost article or main element around it
    or 0. Blocks of elements that are not the article are left out; of classes and ids those made of `noise` tell them.

    A truncated or unclosed element ends where the article or body begins, or at the end; an unclosed button, select or
    the like (EMPTIED) ends at the next tag that is not inline. Self-closed elements are empty, also where only XML has
    such; of scripts and other RAW ones only if the slash cannot be part of a value. A name that merely begins like
    another, as custom elements have, is a name of its own.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = inside = elements = links = depth = at = 0
    skipped, dropping = "", False
    ends = _ends(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, max(0, len(text) - linked), elements if inside else 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    while token := TOKEN.search(page, at):
        if token.start() > at and not skipped and not dropping:
            add(page[at:token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(token[1])
        dropping = dropping and name in INLINE
        if name in RAW or name in EMPTIED:
            if not closing and not (token[3][-1:] == "/" and (name in EMPTIED or token[3][-2:-1] in ("", " ", "\t", "\n", "\r", "\f", "'", '"'))):
                if name in RAW:
                    at = RAW[name].search(page, at).end()
                else:
                    at = ends.get(token.start(), at)
                    dropping = token.start() not in ends
            continue
        if skipped:
            if name == skipped and token[3][-1:] != "/":
                depth += -1 if closing else 1
            if depth and not (not closing and (name in MAIN and skipped not in MAIN and not _noisy(name, token[3], noise) or name == "body")
                              or closing and name == "body"):
                continue
            reopened, skipped = depth > 0, ""
            if not reopened:
                continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if closing or name in VOID or name in ("a", "b", "i", "em", "strong") or not _noisy(name, token[3], noise):
                continue
        close()
        if closing:
            inside -= name in MAIN and inside > 0
            if name in ("article", "main", "p", "div", "li", "td"):
                links = 0
        elif name not in VOID and token[3][-1:] != "/":
            if (name in ASIDE and not (name == "header" and inside)) or token[3] and _noisy(name, token[3], noise):
                skipped, depth = name, 1
            else:
                elements += name in MAIN and not inside
                inside += name in MAIN
    if at < len(page) and not skipped and not dropping:
        add(page[at:])
    close()
    return lines


def _sums(weights: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Weights of each line and those after it in the window, as far as they have the same owner."""
    sums = weights.copy()
    for k in range(1, WINDOW):
        sums[:-k] += np.where(owners[k:] == owners[:-k], weights[k:], 0)
    return sums


def _between(weights: np.ndarray, owners: np.ndarray, least: int, whole: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and the dive after it. A text ends where an article element begins or ends; lines
    of `whole`, elements that surge as one window, are all between."""
    kept, running, before = [], False, None
    for weight, total, owner, own in zip(weights.tolist(), _sums(weights, owners).tolist(), owners.tolist(), whole.tolist()):
        running = own or total > 0 and (running and owner == before or total >= least)
        before = owner
        kept.append(own or running and weight > 0)
    return np.array(kept, bool)


def _kept(lines: list[tuple[str, int, int]], floor: int = 0) -> np.ndarray:
    lengths, owners = (np.array([line[k] for line in lines], np.int64) for k in (1, 2))
    least = max(floor, min(SURGE, int(lengths.sum()) // 2))  # a page shorter than a surge is judged by its own length
    own, none = owners > 0, np.zeros(len(lines), bool)
    text = _between(lengths, owners, least, none)
    # An article element is a window of all its lines, and half a surge will do. Where more text surges outside of such
    # elements they may be teasers: then only those count that surge by three lines of their own.
    in_all = np.bincount(owners, weights=lengths)[owners]
    whole = own & (2 * in_all >= least) & (in_all > 0)
    if lengths[own].sum() < lengths[text & ~own].sum():
        whole &= np.isin(owners, owners[text & own])
    return _between(lengths, owners, least, whole)


def main_text(page: str) -> str:
    """The article of a page. If nothing is left, what surges in full in elements named by their layout only (a sidebar, a
    header: NOISE but not NEVER) is the text; if nothing does, there is none."""
    for noise, floor in ((NOISE, 0), (NEVER, SURGE)):
        lines = lines_of(page, noise)
        if lines:
            kept = _kept(lines, floor)
            if kept.any():
                return "\n".join(line[0] for line, keep in zip(lines, kept.tolist()) if keep)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Character references are decoded once, white space inside a block (any Unicode white space) becomes one space, and
    blocks are joined by a line feed. Null or empty html, and pages without text, give an empty text. Nothing is shared
    between rows, so the work is one scan.
    """
    def texts(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([main_text(page or "") for page in column], dtype=object)

    own = F.pandas_udf(texts, "string")
    return (pages.select("page_id", "url", own(F.col("html").cast("string")).alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
