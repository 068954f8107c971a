"""Main text of web pages by consensus of each host's pages.

First each page scores its containers: blocks of text count for the element that holds them and by half for its
parent, less where they are links. Each page then votes for the generalised paths (tags and classes without digits)
of its containers, in Spark, by host; the paths with most votes win. At last each page is read again and the first
of its host's winning paths that it has is its article; a page that has none takes its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import keep, others, tick
from .url_lists import url_host

#: A tag's attributes: quotes count right after an equals sign, if they are closed. Read once (possessive).
WITHIN = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
#: Comments, elements whose text is no markup, and tags. A tag that the page's end cuts is dropped with what follows.
MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b{WITHIN}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({WITHIN})(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option input menu dialog object canvas audio video".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
NEVER_DROPPED = frozenset("html body article main".split())
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget widgets footer "
    "header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments reply replies respond discussion disqus share sharing social "
    "related recommended form login search".split()
)
WANTED = frozenset("article content post entry story main text body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())


def _unwanted(attributes: dict[str, str]) -> bool:
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
        if parts and parts[0] not in ("with", "has", "no") and any(x in UNWANTED for x in parts):
            return True
    return False


class Element:
    __slots__ = ("dropped", "end", "name", "path", "score", "share", "start")

    def __init__(self, name: str, parent: Element | None, attributes: dict[str, str], start: int, paths: dict[tuple[int, str], int]) -> None:
        self.name, self.score, self.start, self.end = name, 0.0, start, start
        words = attributes.get("class", "").split() + attributes.get("id", "").split()
        names = sorted({re.sub(r"\d+", "#", x.lower()).replace("/", "|") for x in words})
        # paths are numbered: a step from the parent's number
        self.path = paths.setdefault((parent.path if parent else 0, ("/" if parent else "") + name + "".join("." + x for x in names)), len(paths) + 1)
        self.dropped = bool(parent and parent.dropped) or name in DROPPED or (name not in NEVER_DROPPED and _unwanted(attributes))
        self.share = 1.5 if name in ("article", "main") else 1.25 if any(p in WANTED for x in names for p in re.findall(r"[a-z]+", x)) else 1.0


class Page(NamedTuple):
    blocks: list[str]
    containers: list[Element]  # each holds the blocks from start to end
    paths: dict[tuple[int, str], int]

    def path(self, number: int) -> str:
        back = {n: step for step, n in self.paths.items()}
        parts = []
        while number:
            number, step = back[number]
            parts.append(step)
        return "".join(reversed(parts))


def parse(page: str) -> Page:
    """The page's blocks of text and its containers, in order; time in proportion to the page's length."""
    root = Element("", None, {}, 0, {})
    paths: dict[tuple[int, str], int] = {}
    root.path = 0
    stack, found, blocks, holders = [root], [], [], [root]
    open_: Counter[str] = Counter()
    piece: list[str] = []
    linked = 0

    def pop(k: int) -> None:
        for e in reversed(stack[k:]):
            open_[e.name] -= 1
            e.end = len(blocks)
            if holders[-1] is e:
                holders.pop()
        del stack[k:]

    def close_block() -> None:
        nonlocal linked
        raw = "".join(piece)
        piece.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        links, linked = linked, 0
        if not text:
            return
        blocks.append(text)
        weight = len(text) * max(0.0, 1 - links / len(text))
        for k, e in enumerate(reversed(holders[-4:])):
            e.score += weight / 2**k

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].dropped:
            piece.append(text)
            if open_["a"]:
                linked += len(text)

    at = 0
    for m in MARK.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in ("br", "wbr", "hr") and not m[2]:
            if name == "br" and not stack[-1].dropped:
                piece.append(" ")
            elif name == "hr":
                close_block()
            continue
        block = name not in INLINE
        if m[2]:
            if block:
                close_block()
            for k in range(len(stack) - 1, 0, -1) if open_[name] > 0 else ():
                if stack[k].name == name:
                    if not (name in INLINE and any(e.name not in INLINE for e in stack[k + 1 :])):
                        pop(k)
                    break
                if name == "p" and stack[k].name in CONTAINERS:
                    break
            continue
        if block:
            close_block()
            # an open paragraph ends where a block begins, with the inline elements left open in it
            for k in range(len(stack) - 1, 0, -1) if open_["p"] > 0 or (open_[name] > 0 and name in ("li", "dt", "dd", "tr", "td", "th", "option")) else ():
                if stack[k].name == "p" or (stack[k].name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    pop(k)
                    break
                if stack[k].name not in INLINE:
                    break
        if name in VOID or m[0].endswith("/>"):
            continue
        raw = m[4]
        attributes = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(raw)} if raw.strip() else {}
        element = Element(name, stack[-1] if stack[-1] is not root else None, attributes, len(blocks), paths)
        element.dropped = element.dropped or stack[-1].dropped
        stack.append(element)
        open_[name] += 1
        if name in CONTAINERS:
            holders.append(element)
            if not element.dropped:
                found.append(element)
    add(page[at:])
    close_block()
    pop(1)
    root.end = len(blocks)
    return Page(blocks, [root, *found], paths)


def votes(page: str, most: int = 5) -> list[tuple[str, float]]:
    """Paths of the page's ``most`` best containers with their share of the best one's score."""
    parsed = parse(page)
    scored: dict[int, float] = {}
    for e in parsed.containers[1:]:
        if e.end > e.start:
            scored[e.path] = max(scored.get(e.path, 0.0), e.score * e.share)
    top = sorted(((p, s) for p, s in scored.items() if s > 0), key=lambda x: (-x[1], x[0]))[:most]
    return [(parsed.path(p), s / top[0][1]) for p, s in top]


def extract(page: str, paths: list[str]) -> str:
    """The text of the containers of the first path that the page has."""
    parsed = parse(page)
    root, *found = [e for e in parsed.containers[:1]] + [e for e in parsed.containers[1:] if e.end > e.start]
    have: dict[int, list[Element]] = {}
    for e in found:
        have.setdefault(e.path, []).append(e)
    chosen = None
    for path in paths:
        number: int | None = 0
        for k, step in enumerate(path.split("/")):
            number = parsed.paths.get((number, "/" * (k > 0) + step)) if number is not None else None
        if number in have:
            chosen = have[number]
            break
    if chosen is None:
        chosen = [max(found, key=lambda e: e.score * e.share, default=root)]
    out, last = [], 0
    for e in sorted(chosen, key=lambda e: (e.start, -e.end)):
        out += parsed.blocks[max(last, e.start) : e.end]
        last = max(last, e.end)
    return "\n".join(out)


def extract_pages(pages: DataFrame, most_paths: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Add text (main text, '' if none) and n_chars to pages(url, html); columns of these names are replaced.

    Null html is empty; a page of any length is read whole, once for its votes and once for its text. Each page votes
    for its most_paths best paths, and so many stand for a host. An empty table gives an empty one. Rows without a host vote together. Repeated rows each vote and each get their text.
    """
    names = others(pages, "text", "n_chars")
    pages = pages.select(*map(tick, names)).withColumn("__host", url_host(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                rows = [(h, p, v) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, v in votes(page or "", most_paths)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["host", "path", "vote"])

    cast = pages.select("__host", "html").mapInArrow(vote, "host string, path string, vote double")
    # rounded, so that the order of addition can't turn a tie
    counted = cast.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    won = counted.withColumn("n", place).where(F.col("n") <= most_paths).groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path"))), lambda s: s.path).alias("__paths"))
    won = keep(won, "host-paths")
    size = won.select(F.sum(F.length("host") + F.length(F.array_join("__paths", "")) + 64)).first()[0] or 0
    won = won.withColumnRenamed("host", "__won")
    joined = pages.join(F.broadcast(won) if size <= broadcast_bytes else won, F.col("__host") == F.col("__won"), "left").drop("__host", "__won")
    at, last = names.index("html"), len(names)
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                texts = [extract(page or "", paths or []) for page, paths in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
