"""Main text of web pages: marked structure, and a suffix array for each host.

``parse`` turns a page into blocks: runs of text between block-level tags, with
character references decoded and white space joined. Blocks inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are boilerplate by their mark-up; blocks inside an article or main
element are its text. The rest is unmarked.

Boilerplate that no mark-up tells is found by what a host repeats. The token
streams of a host's blocks outside its articles are concatenated and the suffixes
named by prefix doubling, as when a suffix array is built: the name of a suffix
at depth 2d joins its name at depth d and that of the suffix d tokens on. Suffixes
with one name at depth ``DEPTH`` share that many tokens; a name that occurs on two
distinct pages of a host marks a repeated substring, which covers the tokens of
all its occurrences. Unmarked text keeps the runs that nothing covers.

Names replace the order of the array: equal names stand for neighbours with a
common prefix of ``DEPTH`` tokens, which needs no sort of a host in one task. Names
are counted with partial sums, so a host that holds a third of all pages, or a
line that stands on all its pages, costs no more than any other.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.url_filter import host_of

#: Tokens from which a substring that distinct pages share counts as repeated; a power of 2.
DEPTH = 8

# Elements by what they hold.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select option textarea button datalist".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice gdpr newsletter subscribe popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar share sharing social related recommended "
    "comment comments discussion replies respond disqus login signup search skip pagination pager widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements that the start of another ends.
CLOSES = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

# A quote opens a value only after an equals sign; elsewhere it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_RAW = frozenset("script style textarea title noscript iframe".split())


def _marked_out(name: str, attributes: str) -> tuple[bool, bool]:
    """(boilerplate, main) by the element's name and attributes."""
    if name in BOILERPLATE:
        return True, False
    if "=" not in attributes and "hidden" not in attributes:
        return False, name in MAIN
    found = {m[0].lower(): m[1] or m[2] or m[3] or "" for m in (x.groups("") for x in _ATTRIBUTE.finditer(attributes)) for m in [(m[0], m[1], m[2], m[3])]}
    role = found.get("role", "").lower().strip()
    told = set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
    # An article that carries such a word (class="article ad-free") stays one.
    out = role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    comment = bool(told & {"comment", "comments", "replies", "discussion", "disqus"})
    if name not in MAIN and name not in ("body", "html"):
        out = out or bool(told & MARKS)
    else:
        out = out or (comment and name == "article")
    return out, not out and (name in MAIN or role == "main" or found.get("itemprop", "").lower() == "articlebody")


def parse(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block that holds text, in page order; kind 0: unmarked, 1: main text, 2: boilerplate."""
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    kind, hidden, at, end = 0, False, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((kind, text))
            parts.clear()

    def pop(depth: int) -> None:
        nonlocal kind, hidden
        if any(name in BLOCKS or k != kind for name, k, _ in stack[depth:]):
            flush()
        _, kind, hidden = stack[depth]
        del stack[depth:]

    while at < end:
        match = _TAG.search(page, at)
        if not match:
            parts += [] if hidden else [page[at:]]
            break
        if not hidden and match.start() > at:
            parts.append(page[at : match.start()])
        at = match.end()
        if match[1] is not None:
            parts += [] if hidden else [match[1].replace("&", "&amp;")]
        if not match[3]:
            continue
        name = match[3].lower()
        if match[2]:
            if name == "br" or (name == "p" and not any(n == "p" for n, _, _ in stack)):
                flush()
                continue
            # A block's end leaves open inline elements behind; an inline end never crosses a block.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop(depth)
                    break
                if name not in BLOCKS and stack[depth][0] in BLOCKS:
                    break
            continue
        while stack and name in CLOSES.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        if name in BLOCKS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" and name in CLOSES["p"]:
                    pop(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
            flush()
        if name in VOID or match[4].endswith("/") and name not in BLOCKS | HIDDEN:
            continue
        out, main = _marked_out(name, match[4])
        if out and kind != 2:
            flush()
        if main and kind == 0:
            flush()
        stack.append((name, kind, hidden))
        kind = 2 if out or kind == 2 else 1 if main or kind == 1 else 0
        if name in HIDDEN:
            # Their text is none of the page's; raw text ends at its own end tag only.
            if name in _RAW:
                close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = close.start() if close else end
            hidden = True
    flush()
    return blocks


def suffix_names(tokens: list[str], depth: int = DEPTH) -> np.ndarray:
    """Name of each suffix at that depth, for suffixes of at least so many tokens, by prefix doubling."""
    if len(tokens) < depth:
        return np.zeros(0, np.int64)
    known: dict[str, int] = {}
    name = np.array([known.get(t) or known.setdefault(t, int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")) for t in tokens], np.uint64)
    step = 1
    while step < depth:
        name = (name[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (name[step:] + np.uint64(step))
        name ^= name >> np.uint64(29)
        name *= np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(32)
        step *= 2
    return name.view(np.int64)


def keep_uncovered(tokens: list[str], repeated: list[int]) -> str:
    """The tokens that no repeated suffix beginning covers, in order."""
    covered = np.zeros(len(tokens) + 1, np.int64)
    for at in repeated:
        covered[at] += 1
        covered[min(at + DEPTH, len(tokens))] -= 1
    return " ".join(t for t, c in zip(tokens, np.cumsum(covered)) if not c)


BLOCK = "array<struct<kind:int,text:string>>"


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks) of each row; a null html has no blocks."""
    kind = pages.schema["page_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[{"kind": k, "text": t} for k, t in parse(h or "")] for h in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, struct)], names=["page_id", "url", "host", "blocks"])

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(cut, f"page_id {kind}, url string, host string, blocks {BLOCK}")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of each row of ``pages``.

    text: the main blocks and what is left of unmarked ones, in page order, joined
    by one space; empty for a null or empty html. n_chars: its code points.
    n_boilerplate: tokens outside the article that a repeated substring covers.

    Pages of a host with equal blocks are copies of one page, whatever their ids: they
    make nothing repeated, and each gives the same result. Pages without a host form
    a host of their own. An empty table gives no rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    blocks = page_blocks(pages)
    # A page's key is told by its content, so that copies are one page.
    keyed = blocks.withColumn("page", F.xxhash64("host", "blocks"))
    outside = keyed.select("host", "page", F.filter("blocks", lambda b: b["kind"] != 1)["text"].alias("texts")).filter(F.size("texts") > 0)

    def names(batches):
        for batch in batches:
            host, page, at, name = [], [], [], []
            for h, p, texts in zip(*(c.to_pylist() for c in batch.columns)):
                found = suffix_names(" ".join(texts).split())
                host += [h] * len(found)
                page += [p] * len(found)
                at += range(len(found))
                name.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(at, pa.int32()), pa.array(np.concatenate(name) if name else [], pa.int64())], names=["host", "page", "at", "name"])

    suffixes = outside.mapInArrow(names, "host string, page bigint, at int, name bigint").select("page", "at", F.xxhash64("host", "name").alias("name"))
    repeated = suffixes.groupBy("name").agg(F.min("page").alias("low"), F.max("page").alias("high")).filter("low < high").select("name")
    covered = suffixes.join(repeated, "name", "left_semi").groupBy("page").agg(F.array_sort(F.collect_set("at")).alias("covered"))

    def keep(batches):
        for batch in batches:
            texts, counts = [], []
            for found, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text, n = _kept(found or [], covered or [])
                texts.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_boilerplate"]
            )

    joined = keyed.join(covered, "page", "left").select("page_id", "url", "blocks", "covered")
    return joined.mapInArrow(keep, f"page_id {kind}, url string, text string, n_chars bigint, n_boilerplate bigint")


def _kept(blocks: list[dict], covered: list[int]) -> tuple[str, int]:
    """The page's text, and how many tokens outside its article are covered."""
    stream = [(i, t) for i, b in enumerate(blocks) if b["kind"] != 1 for t in b["text"].split()]
    mark = np.zeros(len(stream) + 1, np.int64)
    for at in covered:
        mark[at] += 1
        mark[min(at + DEPTH, len(stream))] -= 1
    mark = np.cumsum(mark)[:-1] > 0
    unmarked: dict[int, list[str]] = {}
    for (i, token), out in zip(stream, mark):
        if not out and blocks[i]["kind"] == 0:
            unmarked.setdefault(i, []).append(token)
    texts = [b["text"] if b["kind"] == 1 else " ".join(unmarked.get(i, ())) for i, b in enumerate(blocks) if b["kind"] != 2]
    return " ".join(t for t in texts if t), int(mark.sum())
