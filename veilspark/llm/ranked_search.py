"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

Documents are dealt into shards as they are read; nothing is shuffled. A shard holds the term frequencies of its documents (as the factor
of the score that depends on the document) and for every term a posting list. A list longer than a block is clustered: documents are compared by a
random projection of their weighted terms with some of the list, and those nearest to the same one are
neighbours. A block stores, for its own and every lighter term, the largest factor over its documents. The weighted sum of these maxima
over a query's terms is at least what these terms add to the score of each of its documents.

A query takes its lists from the heaviest term to the lightest. A document that holds a heavier term was met in that term's list, so
the terms from the current one on are all that counts. A block is skipped only if its bound is below the score that the
query's k-th best document of this task already has; otherwise its documents are scored exactly. A query leaves a shard when
all that its remaining terms could add is below that score. The best of every task are ranked at the end. So the result is that of scoring all documents.

    weight of a term = floor(1000 ln((2N + 2) / (2 df + 1)))
    m of a document  = 50 + (50 n N) div L
    score            = sum over the query's distinct terms of weight * ((10^9 tf) div (1000 tf + 20 m))

N counts documents with a term, L all terms, n a document's terms, df the documents that hold a term, tf its occurrences.

The lists have the terms of one block of queries (at most `BLOCK_TERMS`), so many queries are a read of the documents for each
block, and a shard is searched by the task that builds it. A block's terms and weights are all that the driver holds. Items that share an id,
or have none, are one item with the terms of all. Items without terms, or whose terms no document holds, give no rows. Null and empty texts
have no terms. A null doc_id comes after all others of its score; rows with equal ids are ranked each. Columns beyond id and text are
ignored. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import plain_words, staged, utf8

#: Distinct terms of the queries that are answered in one pass.
BLOCK_TERMS = 30_000
#: Postings of a shard and documents of a block. Blocks below SMALL have no summary: their documents cost less than a bound.
SHARD_POSTINGS, BLOCK, SMALL = 400_000, 256, 16
#: Dimensions of the projection that documents of a list are compared by.
DIMENSIONS = 16
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms array<binary>): the distinct terms of every item that has some."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(utf8(batch.column(1))):
                terms = list(set(plain_words(text)))
                for part in range(0, len(terms), 10_000):
                    some = terms[part : part + 10_000]
                    ids = batch.column(0).take(pa.array([at] * len(some), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(some, pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, term binary")
    return found.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def query_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their terms, in lists with at most `most` terms altogether (or of one item)."""
    block, size = [], 0
    for item_id, terms in item_terms(items).toLocalIterator():
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        block.append((item_id, [bytes(t) for t in terms]))
        size += len(terms)
    if block:
        yield block


def term_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of `docs` that has terms: those of the vocabulary by number, with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(shared.value)}
        size = len(number)
        for batch in batches:
            lengths, found = [], []
            for at, text in enumerate(utf8(batch.column("text"))):
                words = plain_words(text)
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                lengths.append(len(words))
                found.append(ids[ids >= 0] + at * size)
            codes, tfs = np.unique(np.concatenate([np.array([], np.int64), *found]), return_counts=True)
            offsets = pa.array(np.searchsorted(codes, np.arange(len(lengths) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (codes % max(size, 1), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def term_weights(frequencies: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(N, L, weight of each of the `size` terms; 0 for terms that no document holds)."""
    n_docs, length = frequencies.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(size, np.int64)
    for term, df in frequencies.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most `size` rows
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return n_docs, length, weights


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges `start .. start + size - 1`, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _clustered(own: np.ndarray, sketch: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts the documents of a list into blocks, and where the blocks start."""
    if len(own) <= block:
        return np.arange(len(own)), np.array([0])
    pivots = own[np.linspace(0, len(own) - 1, -(-len(own) // block)).astype(np.int64)]
    cell = np.argmax(sketch[own] @ sketch[pivots].T, 1)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    place = (np.arange(len(cell)) - np.searchsorted(cell, cell)) // block  # a cell larger than a block is several blocks
    return order, np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))


@dataclass
class Shard:
    """Documents and their posting lists. Terms are numbered from the heaviest to the lightest, and sorted in each document.

    `doc_start` and `block_start` tell where the entries (`term`, `factor`) of a document and the documents (`posting`) of a block start, `list_start`
    where the blocks of a term start; a block's summary is `summary_term` and `summary_most` from its `summary_start` on.
    """

    doc_id: np.ndarray
    doc_start: np.ndarray
    term: np.ndarray
    factor: np.ndarray
    most: np.ndarray
    list_start: np.ndarray
    block_start: np.ndarray
    posting: np.ndarray
    summary_start: np.ndarray
    summary_term: np.ndarray
    summary_most: np.ndarray


def build_shard(doc_id: np.ndarray, doc_start: np.ndarray, term: np.ndarray, factor: np.ndarray, weights: np.ndarray, block: int = BLOCK) -> Shard:
    """The posting lists of some documents, in blocks with their summaries."""
    size, sizes = len(weights), np.diff(doc_start)
    projection = np.random.default_rng(5).standard_normal((size, DIMENSIONS)).astype(np.float32)
    scores = (weights[term] * factor).astype(np.float32)
    sketch = np.add.reduceat(projection[term] * scores[:, None], doc_start[:-1], axis=0)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-6)
    by_term = np.argsort(term, kind="stable")
    doc_of = np.repeat(np.arange(len(sizes)), sizes)[by_term]
    bounds = np.searchsorted(term[by_term], np.arange(size + 1))
    n_blocks, block_start, posting, summary_start = np.zeros(size, np.int64), [], [], [0]
    summary_term, summary_most = [np.array([], np.int64)], [np.array([], np.int64)]
    at = filled = 0
    for t in np.flatnonzero(np.diff(bounds)).tolist():
        places = by_term[bounds[t] : bounds[t + 1]]
        order, cuts = _clustered(doc_of[bounds[t] : bounds[t + 1]], sketch, block)
        own = doc_of[bounds[t] : bounds[t + 1]][order]
        n_blocks[t] = len(cuts)
        block_start.append(cuts + at)
        posting.append(own)
        at += len(own)
        held = np.diff(cuts, append=len(own))
        if held.max() < SMALL:
            summary_start += [filled] * len(cuts)
            continue
        whole = np.repeat(held >= SMALL, held)
        # A document's entries from this term on are those of this and all lighter terms.
        first = places[order][whole]
        length = doc_start[own[whole] + 1] - first
        entries = _ranges(first, length)
        width = size - t
        at_block = np.repeat(np.repeat(np.arange(len(cuts)), held)[whole] * width - t, length)
        most = np.zeros(len(cuts) * width, np.int64)
        np.maximum.at(most, at_block + term[entries], factor[entries])
        kept = np.flatnonzero(most)
        summary_start += (filled + np.searchsorted(kept, np.arange(1, len(cuts) + 1) * width)).tolist()
        summary_term.append(kept % width + t)
        summary_most.append(most[kept])
        filled += len(kept)
    most = np.zeros(size, np.int64)
    np.maximum.at(most, term, factor)
    list_start = np.concatenate(([0], np.cumsum(n_blocks)))
    starts = np.concatenate((*block_start, [at]))
    return Shard(
        doc_id, doc_start, term, factor, most, list_start, starts, np.concatenate(posting), np.array(summary_start),
        np.concatenate(summary_term), np.concatenate(summary_most),
    )


class _Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.array([], np.int64), np.array([], np.int64)
        self.least = 1  # a document below this score is not among them

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[good]))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.k:
                self.least = int(self.scores[-1])


def search_shard(shard: Shard, query: np.ndarray, weights: np.ndarray, best: _Best) -> tuple[int, int]:
    """Add a shard's documents to the best of a query, given by its terms in ascending order; returns how many of its blocks there were and how many were scored."""
    query = query[shard.most[query] > 0]
    left = np.zeros(len(weights), np.int64)  # the weights of the terms that are still to come
    left[query] = weights[query]
    full = left.copy()
    rest = np.cumsum((left[query] * shard.most[query])[::-1])[::-1]
    seen = np.zeros(len(shard.doc_id), bool)
    scored = 0
    for term, most_left in zip(query.tolist(), rest.tolist(), strict=True):
        if most_left < best.least:
            break
        a, b = int(shard.list_start[term]), int(shard.list_start[term + 1])
        ends = shard.summary_start[a : b + 1]
        has = np.diff(ends) > 0
        chosen = ~has
        if has.any():
            entries = slice(ends[0], ends[-1])
            parts = left[shard.summary_term[entries]] * shard.summary_most[entries]
            chosen[has] = np.add.reduceat(parts, (ends[:-1] - ends[0])[has]) >= best.least
        scored += int(chosen.sum())
        own = np.arange(a, b)[chosen]
        docs = shard.posting[_ranges(shard.block_start[own], shard.block_start[own + 1] - shard.block_start[own])]
        docs = docs[~seen[docs]]
        if len(docs):
            seen[docs] = True
            sizes = shard.doc_start[docs + 1] - shard.doc_start[docs]
            entries = _ranges(shard.doc_start[docs], sizes)
            parts = full[shard.term[entries]] * shard.factor[entries]
            best.add(np.add.reduceat(parts, np.cumsum(sizes) - sizes), shard.doc_id[docs])
        left[term] = 0
    return int((shard.list_start[query + 1] - shard.list_start[query]).sum()), scored


def search(
    frequencies: DataFrame, stats: tuple[int, int, np.ndarray], queries: list[np.ndarray], k: int, shard_postings: int = SHARD_POSTINGS, block: int = BLOCK
) -> DataFrame:
    """(query, doc_id, score): the k best documents `(doc_id, n, terms, tfs)` of each task for every query, given by numbers of terms."""
    shared = frequencies.sparkSession.sparkContext.broadcast((stats, queries))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (n_docs, length, weights), queries = shared.value
        # From here on terms are numbered from the heaviest to the lightest.
        number = np.empty(len(weights), np.int64)
        number[np.argsort(-weights, kind="stable")] = np.arange(len(weights))
        weights = np.sort(weights)[::-1]
        queries = [np.sort(number[q]) for q in queries]
        best = [_Best(k) for _ in queries]
        ids, sizes, terms, factors, held = [], [], [], [], 0

        def search_held() -> None:
            starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            term, factor = np.concatenate(terms), np.concatenate(factors)
            order = np.argsort(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * len(weights) + term)
            shard = build_shard(np.concatenate(ids), starts, term[order], factor[order], weights, block)
            for query, found in zip(queries, best, strict=True):
                search_shard(shard, query, weights, found)

        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
            bounds = batch.column("terms").offsets.to_numpy().astype(np.int64)
            all_terms, all_tfs = (batch.column(c).values.to_numpy()[: bounds[-1]].astype(np.int64) for c in ("terms", "tfs"))
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // length
            at = 0
            while at < len(doc_ids):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + shard_postings - held, "right")) - 1)
                of = slice(bounds[at], bounds[end])
                sizes.append(np.diff(bounds[at : end + 1]))
                tf = all_tfs[of]
                ids.append(doc_ids[at:end])
                terms.append(number[all_terms[of]])
                factors.append(1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m[at:end], sizes[-1])))
                held += len(tf)
                at = end
                if held >= shard_postings or at < len(doc_ids):
                    search_held()
                    ids, sizes, terms, factors, held = [], [], [], [], 0
        if ids:
            search_held()
        for query, found in enumerate(best):
            ids_found = pa.array(found.ids, mask=found.ids == _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids_found), query, np.int32)), ids_found, pa.array(found.scores)], ["query", "doc_id", "score"])

    # Documents without a term of the vocabulary score 0.
    return frequencies.where(F.size("terms") > 0).mapInArrow(find, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, **options: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents `(doc_id, text)` with the highest scores above 0 for each of `items` (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in query_blocks(items, block_terms):
        vocabulary = sorted({term for _, terms in block for term in terms})
        number = {term: at for at, term in enumerate(vocabulary)}
        frequencies = staged(term_frequencies(docs, vocabulary), "frequencies")
        stats = term_weights(frequencies, len(vocabulary))
        queries = [np.array([x for x in (number[t] for t in terms) if stats[2][x] > 0], np.int64) for _, terms in block]
        found = search(frequencies, stats, queries, k, **options)
        names = spark.createDataFrame([(at, item_id) for at, (item_id, _) in enumerate(block)], f"query int, item_id {kind}")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", place).where(F.col("rank") <= k)
        result = result.union(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return result
