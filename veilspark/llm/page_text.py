"""Main text of web pages: the article's blocks, and elsewhere what no other page of the host repeats.

A page is read as a sequence of blocks (headings, paragraphs, list items, cells and the like). Blocks inside
elements that hold no main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments; by element name, role, class or id) are marked. Where a page has an article or main
element, its unmarked blocks are the text, whole and with repeats.

Elsewhere the host decides. The token streams of a host's blocks outside articles are concatenated, a
suffix array over them (prefix doubling, so suffixes are sorted by their first `RUN` tokens) gives
the runs of at least `RUN` tokens that occur on two pages of different content, and a block that such runs
cover is boilerplate. Blocks that are not marked and not covered are the text of a page without an article
element; if all of them are covered, the page is a copy, and its unmarked blocks stay.

A host's pages are dealt out in groups of about `GROUP_BYTES`, so a host of any size stays
within a task's memory. Each group has a suffix array of its own, and of a host with several groups the suffixes' first `RUN`
tokens are also shuffled by their hash: those that pages of different content hold in different groups are handed to these
groups, so the groups do not change a text. Null pages are empty texts. Rows without an url share one
host. Repeated pages are equal content and do not make each other boilerplate.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged

RUN = 4
COVERED = 0.8
GROUP_BYTES = 8 << 20
#: Hosts of more than one group are broadcast up to this number; Spark joins more as it sees fit.
MAX_BROADCAST_HOSTS = 100_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|iframe|svg|xmp|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
#: One attribute, name and value: what stands in another attribute's name or value is never one.
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset("nav header footer aside form button select dialog menu fieldset head".split())
#: Words in a class, id or role that mark an element without main text.
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "disclaimer disqus dialog footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words for the form of a part: inside an article, comment-list names comments, and social-impact a subject.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center col column container content count desktop form group header holder icon icons "
    "inline inner item items left link links list main mobile outer panel post posts row section site slot small title top unit wrap "
    "wrapper right".split()
)


class _Page:
    """The blocks of one page: (text, in an article, marked)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, in an article, marked
        self.parts: list[str] = []
        end = 0
        for match in _TAG.finditer(source):
            if match.start() > end:
                self.parts.append(source[end : match.start()])
            end = match.end()
            if name := match[3]:
                name = name.lower()
                if name == "br" or (name in VOID and name not in INLINE):
                    self.parts.append(" ")
                if name not in INLINE:
                    self.flush()
                if match[2]:
                    self.close(name)
                elif name not in VOID and not match[4].rstrip().endswith("/"):
                    self.begin(name, match[4])
        self.parts.append(source[end:])
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                _, inside, marked = self.open[-1] if self.open else ("", False, False)
                self.blocks.append((text, inside, marked))

    def close(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                del self.open[k:]
                return
            if self.open[k][0] in ARTICLE and name in INLINE | {"p", "li"}:
                return

    def begin(self, name: str, attributes: str) -> None:
        if name == "p":  # a paragraph ends the one before it, with what is open in that
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    del self.open[k:]
                    break
                if self.open[k][0] not in INLINE:
                    break
        _, inside, marked = self.open[-1] if self.open else ("", False, False)
        if name in ARTICLE and not inside:
            inside, marked = True, False  # an unclosed menu before the article does not swallow it
        elif name == "header" and inside:
            pass  # holds the article's heading
        elif not marked:
            marked = name in MARKED or bool(attributes) and _is_marked(attributes, inside, name)
        self.open.append((name, inside, marked))


def _is_marked(attributes: str, inside: bool, element: str = "div") -> bool:
    """Whether an element's hidden, class, id or role attribute marks it.

    Inside an article a whole name must be made of marked words, as sections are named after their subject; and the id of a
    heading or of a part of a line says nothing there, as it repeats the text.
    """
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            return True
        if key not in ("class", "role", "id") or key == "id" and inside and element in INLINE | HEADINGS:
            continue
        for name in "".join(values).split():
            parts = set(_PART.findall(_CAMEL.sub(" ", name).lower()))
            if not MARKED_WORDS.isdisjoint(parts) and (not inside or parts <= MARKED_WORDS | PLAIN_WORDS):
                return True
    return False


def page_blocks(source: str | None) -> list[tuple[str, bool, bool]]:
    return _Page(source or "").blocks


def run_hashes(stream: list[str], run: int = RUN) -> np.ndarray:
    """The hash of the `run` tokens from each place on that has so many."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, map(" ".join, zip(*(stream[k:] for k in range(run)), strict=False))), np.uint64)


def repeated_runs(streams: list[list[str]], run: int = RUN, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of at least `run` tokens that another, different stream has too.

    The first `run` tokens of runs that streams elsewhere have are given by their hashes, `known`.
    """
    content: dict[tuple[str, ...], int] = {}
    number = [content.setdefault(tuple(s), len(content)) for s in streams]
    distinct = list(content)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    owner = np.repeat(np.arange(len(distinct)), sizes + 1)
    ids: dict[str, int] = {}
    # Every stream ends with a token of its own, so no run reaches into the next one.
    text = np.fromiter((k for s, own in enumerate(distinct) for k in (*(ids.setdefault(t, len(ids)) for t in own), -1 - s)), np.int64, int(starts[-1]))
    covered = np.zeros(len(text), bool)
    if len(text):
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        length = 1
        while length < run:  # ranks of the suffixes by their first `length` tokens
            step = min(length, run - length)
            after = np.full(len(rank), -1, np.int64)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
            length += step
        order = np.lexsort((owner, rank))  # the suffix array, to that depth
        of, page = rank[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        low, high = page[first], page[np.concatenate((first[1:], [len(of)])) - 1]
        begins = order[np.repeat(low != high, np.diff(np.concatenate((first, [len(of)]))))]
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, np.minimum(begins + run, len(text)), -1)
        if known is not None and len(known):
            for at, own in zip(starts, distinct, strict=False):
                begins = at + np.flatnonzero(np.isin(run_hashes(list(own), run), known))
                edge[begins] += 1
                edge[begins + run] -= 1
        covered = np.cumsum(edge[:-1]) > 0
    return [covered[starts[n] : starts[n] + len(s)] for n, s in zip(number, streams, strict=True)]


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _loose(blocks: list[tuple[str, bool, bool]]) -> list[tuple[list[str], str, bool]]:
    """(words, text, marked) of the blocks outside articles."""
    return [(t.split(), t, marked) for t, inside, marked in blocks if not inside]


def _stream(loose: list[tuple[list[str], str, bool]]) -> list[str]:
    return [w for words, _, _ in loose for w in words]


def _shared_runs(dealt: DataFrame, run: int) -> DataFrame:
    """(host, part, start) of `dealt` (host, part, html): hashes of the runs that pages of different content hold in several groups of a host.

    Runs within one group are left to its suffix array.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for k, source in enumerate(batch.column("html").to_pylist()):
                stream = _stream(_loose(page_blocks(source)))
                starts = np.unique(run_hashes(stream, run))
                page = np.full(len(starts), xxh64_intdigest(" ".join(stream)), np.uint64)
                host, part = (pa.repeat(batch.column(c)[k], len(starts)) for c in ("host", "part"))
                yield pa.RecordBatch.from_arrays([host, part, pa.array(starts.view(np.int64)), pa.array(page.view(np.int64))], ["host", "part", "start", "page"])

    runs = dealt.select("host", "part", "html").mapInArrow(cut, "host string, part long, start long, page long")
    held = runs.groupBy("host", "start").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.collect_set("part").alias("parts"))
    return held.where("low <> high AND size(parts) > 1").select("host", F.explode("parts").alias("part"), "start")


def extract(pages: DataFrame, run: int = RUN, covered: float = COVERED) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of every row of `pages` (page_id, url, html).

    `n_boilerplate` counts the blocks outside articles that other pages of the host repeat.
    """
    rows = pages.select("page_id", "url", _host(F.col("url")).alias("host"), "html")
    groups = F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / GROUP_BYTES)
    large = staged(rows.groupBy("host").agg(groups.alias("groups")).where("groups > 1"), "hosts")
    if large.count() <= MAX_BROADCAST_HOSTS:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("page_id", "html"), F.coalesce("groups", F.lit(1)))
    dealt = rows.join(large, "host", "left").withColumn("part", part).drop("groups")
    shared = _shared_runs(rows.join(large, "host").withColumn("part", part), run)

    def keep(group: pa.Table, known: pa.Table) -> pa.Table:
        parsed = [page_blocks(source) for source in group.column("html").to_pylist()]
        loose = [_loose(blocks) for blocks in parsed]
        found = repeated_runs([_stream(page) for page in loose], run, known.column("start").to_numpy().view(np.uint64))
        texts, counts = [], []
        for blocks, page, repeated in zip(parsed, loose, found, strict=True):
            ends = np.cumsum([len(words) for words, _, _ in page], dtype=np.int64)
            shares = [repeated[end - len(words) : end].mean() for (words, _, _), end in zip(page, ends, strict=True)]
            unmarked = [t for _, t, marked in page if not marked]
            unique = [t for (_, t, marked), share in zip(page, shares, strict=True) if not marked and share < covered]
            article = [t for t, inside, marked in blocks if inside and not marked]
            texts.append("\n\n".join(article if any(inside for _, inside, _ in blocks) else unique or unmarked))
            counts.append(sum(share >= covered for share in shares))
        columns = [group.column("page_id"), group.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
        return pa.Table.from_arrays(columns, ["page_id", "url", "text", "n_boilerplate"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_boilerplate long"
    kept = dealt.groupBy("host", "part").cogroup(shared.groupBy("host", "part")).applyInArrow(keep, schema)
    return kept.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")
