"""Near copies by text: groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: a text's fingerprint has the bits that are set in over half of its shingles' hashes, repeats included
(`simhash`, there with three words), and what `simhash.near_links` finds within `RADIUS` bits, the radius published with the method, is a candidate.
Similar texts may differ in more bits, about ten at a similarity of 0.8, so an exact join follows, and the groups are exact.

Shingles are 64-bit XXH64 values, and equal sets are one node. Nodes with n shingles, put in one global order, can
only be similar if they share one of their first n - ceil(0.8 n) + 1 shingles (prefix filter), are alike in size (length
filter) and have enough shingles left after the first shared one (positional filter). The order changes no result; shingles that a
sample of the documents repeats come last, so that a common passage is in few prefixes.

Each candidate pair is counted in full. First come those of the fingerprints, and every node with
one typical copy: of the nodes that have most repeated shingles, one for each shingle it has in its prefix, the one it shares most of them with. Then the pairs
that share a prefix shingle and are still in different components are compared, and only these: a large group of near copies is mostly one
component by then. Sets differ in at least as many shingles as their marks differ in bits, so pairs whose marks differ
too much go before any shingles are fetched, and the shingles of a text are cut again only if it is in a pair that is left.

A text of fewer than five words is one shingle. Texts without words, null ones included, have the empty set, and so are one group.
Documents are kept in a struct meanwhile, so no column name can clash. Without documents nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import simhash
from veilspark.llm.common import packed, spaced_words, staged, unpacked, utf8
from veilspark.llm.components import components

SHINGLE = 5
#: Similarity as a fraction, so that counts are compared as integers.
SIMILARITY = (4, 5)
#: About so many documents are sampled, and a shingle that so many of them hold comes late in the order.
SAMPLE, REPEATED = 10_000, 10
#: Bits in which fingerprints of candidates may differ.
RADIUS = 3
#: Words of 64 bits that mark the shingles of a small node.
MARKS = 4
#: Pairs whose ends are broadcast: a row number and three node numbers each.
BROADCAST_PAIRS = 1_000_000
#: Nodes of a shingle that are compared with each other in one piece.
PIECE = 500


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, in order and with repeats."""
    from xxhash import xxh64_intdigest

    words = spaced_words(text)
    if not words:
        return np.array([], np.uint64)
    parts = [words[i : len(words) - n + 1 + i] for i in range(n)] if len(words) >= n else [[b" ".join(words)]]
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*parts, strict=True)), repeat(42)), np.uint64)


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, n))


def _node(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), 7)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array([], np.uint64), *arrays]).view(np.int64)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def repeated_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count) of what a sample of `rows` repeats, sorted by shingle: at most the sample's shingles / `REPEATED`."""
    every = max(1, rows.count() // SAMPLE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["h"])

    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    found = sample.mapInArrow(cut, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def signatures(rows: DataFrame) -> DataFrame:
    """(row, node, size, fp, marks, shared, prefix) of rows `(row, text)`: `shared` is the part of the shingles that a sample repeats."""
    hot = rows.sparkSession.sparkContext.broadcast(repeated_shingles(rows))
    p, q = SIMILARITY

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, count = hot.value
        for batch in batches:
            nodes, sizes, prints, marks, shares, prefixes = [], [], [], [], [], []
            for text in utf8(batch.column("text")):
                hashes = shingle_hashes(text)
                own = np.unique(hashes)
                rank = np.zeros(len(own), np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    rank = np.where(late[at] == own, count[at], 0)
                length = len(own) - -(-p * len(own) // q) + 1 if len(own) else 0
                nodes.append(_node(own))
                sizes.append(len(own))
                prints.append(simhash.majority(hashes))
                marks.append(_marks(own))
                shares.append(float(np.mean(rank > 0)) if len(own) else 0.0)
                prefixes.append(own[np.lexsort((own, rank))[:length]])
            columns = [_longs(nodes), pa.array(sizes, pa.int64()), _longs(prints), _lists(marks), pa.array(shares, pa.float64()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "node", "size", "fp", "marks", "shared", "prefix"])

    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, node long, size long, fp long, marks array<long>, shared double, prefix array<long>"
    return rows.select("row", "text").mapInArrow(sign, schema)


def _marks(own: np.ndarray) -> np.ndarray:
    """Bits for the shingles by their hash, each the parity of how many it stands for: about as many as there are shingles, a power of two."""
    width = max(64 * MARKS, 1 << max(len(own) - 1, 0).bit_length())
    return np.packbits(np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) % 2 == 1).view(np.uint64)


def _folded(marks: Column) -> Column:
    """Marks of half as many bits."""
    half = F.shiftright(F.size(marks), 1)
    return F.zip_with(F.slice(marks, F.lit(1), half), F.slice(marks, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, own) of rows `(node, text)`: the shingles of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], ["node", "own"])

    return texts.select("node", "text").mapInArrow(cut, "node long, own array<long>")


def _possible(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether nodes of these sizes, whose first shared shingle is at these places, can be similar."""
    p, q = SIMILARITY
    alike = (F.least(n, other_n) * q) >= (F.greatest(n, other_n) * p)
    return alike & (F.least(n - at, other_n - other_at) * (p + q) >= (n + other_n) * p)


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The links (node, root) among distinct candidate `pairs` (a, b): each is counted in full.

    A pair whose sizes or marks differ too much goes before its shingles are fetched from `rows`.
    """
    p, q = SIMILARITY

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("marks").alias(f"marks_{x}"))

    marked = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("marks_a"), F.col("marks_b")
    # Sizes that are alike have marks of the same width, or of twice that.
    small_a, small_b = (F.when(F.size(x) > F.size(y), _folded(x)).otherwise(x) for x, y in ((a, b), (b, a)))
    apart = F.aggregate(F.zip_with(small_a, small_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = F.least("size_a", "size_b") * q >= F.greatest("size_a", "size_b") * p
    near = F.when(alike, apart * (p + q) <= (F.col("size_a") + F.col("size_b")) * (q - p))
    maybe = staged(marked.where(near).select("a", "b", "size_a", "size_b"), "maybe")

    few = maybe.count() <= BROADCAST_PAIRS  # else Spark chooses the joins
    hint = F.broadcast if few else lambda df: df
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")), F.struct(F.col("b").alias("node"), F.lit(False).alias("first"))))
    sides = maybe.select("a", "b", "size_a", "size_b", ends.alias("end")).select("a", "b", "size_a", "size_b", "end.node", "end.first")
    wanted = staged(nodes.join(hint(sides.select("node").distinct()), "node", "left_semi").select("row", "node"), "wanted")
    own = _shingle_sets(rows.join(hint(wanted), "row")).join(hint(sides), "node")

    def set_of(first: bool) -> Column:  # rows may come twice, with the same text
        return F.first(F.when(F.col("first") == first, F.col("own")), ignorenulls=True)

    both = own.groupBy("a", "b", "size_a", "size_b").agg(F.size(F.array_intersect(set_of(True), set_of(False))).alias("common"))
    return both.where(F.col("common") * (p + q) >= (F.col("size_a") + F.col("size_b")) * p).select(F.col("b").alias("node"), F.col("a").alias("root"))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that connect the nodes whose fingerprints `fp` are equal or linked by SimHash."""
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = nodes.join(prints, "fp").where("node <> rep").select("node", "rep")
    links = simhash.near_links(prints.select("fp"), RADIUS)
    one, two = (prints.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_rep")) for x in ("node", "root"))
    linked = links.join(one, "node").join(two, "root").select("node_rep", "root_rep")
    return _ordered(equal.union(linked))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs of two columns, the smaller one first."""
    x, y = pairs.columns
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _repeated_entries(signed: DataFrame) -> DataFrame:
    """(h, node, size, at) of prefix shingles that several nodes have, from one shuffle of what all nodes have.

    Entries are sorted into ranges of (h, node), so a shingle that very many nodes have is cut between ranges. One whose
    neighbours in its range differ is alone; the first and the last of a range stay, as their neighbours are elsewhere.
    """
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size_and_place = F.shiftleft("size", 32).bitwiseOR(F.col("at").cast("long")).alias("size_at")
    nodes = signed.select("node", "size", "prefix").dropDuplicates(["node"])
    entries = nodes.select("node", "size", F.posexplode("prefix").alias("at", "h")).select("h", "node", size_and_place)
    ordered = entries.repartitionByRange(parts, "h", "node").sortWithinPartitions("h")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the shingle before the held batch, and a batch that waits for what follows
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield held.filter(_not_alone(held, before, batch.column("h")[0].as_py()))
                before = held.column("h")[-1].as_py()
            held = batch
        if held is not None:
            yield held.filter(_not_alone(held, before, None))

    found = ordered.mapInArrow(keep, "h long, node long, size_at long")
    return found.select("h", "node", F.shiftright("size_at", 32).alias("size"), F.col("size_at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"))


def _not_alone(batch: pa.RecordBatch, before: int | None, after: int | None) -> pa.Array:
    """Which rows of a sorted batch have an equal neighbour, or one that is not known."""
    h = batch.column("h").to_numpy()
    same = h[1:] == h[:-1]
    return pa.array(np.concatenate(([before is None or before == h[0]], same)) | np.concatenate((same, [after is None or after == h[-1]])))


def _crossed(apart: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among rows (h, node, size, at, part) of one shingle that are in different parts.

    The rows of a shingle are dealt into pieces of about `PIECE`, and each pair of pieces is a key of its own, so that a shingle
    that very many nodes have is compared by many tasks.
    """
    pieces = apart.groupBy("h").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = apart.join(pieces, "h").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    columns = ("node", "size", "at", "part")
    one = dealt.select("h", F.col("piece").alias("i"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("j"), *(F.col(c).alias(f"{c}_a") for c in columns))
    two = dealt.select("h", F.explode(F.sequence(F.lit(0), "piece")).alias("i"), F.col("piece").alias("j"), *(F.col(c).alias(f"{c}_b") for c in columns))
    met = one.join(two, ["h", "i", "j"]).where("part_a <> part_b AND (i < j OR node_a < node_b)")
    met = met.where(_possible(F.col("size_a"), F.col("at_a"), F.col("size_b"), F.col("at_b")))
    return _ordered(met.select("node_a", "node_b")).distinct()


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows `(row, node)`, `(node, group)` of every node) of rows `(row, text)`."""
    signed = staged(signatures(rows), "signatures")
    same = [F.first(c).alias(c) for c in ("size", "marks")]
    nodes = staged(signed.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.max("shared").alias("shared"), *same), "nodes")
    index = staged(_repeated_entries(signed), "prefixes")
    # The most typical node of each prefix shingle; a node is compared with the one of these that it meets most often.
    typical = F.max(F.struct("shared", "node", "size", "at")).alias("hub")
    hubs = index.join(nodes.select("node", "shared"), "node").groupBy("h").agg(typical)
    near = index.join(hubs, "h").where(F.col("node") != F.col("hub.node")).where(_possible(F.col("size"), F.col("at"), F.col("hub.size"), F.col("hub.at")))
    met = near.groupBy("node", F.col("hub.node").alias("other")).agg(F.count("*").alias("times"))
    best = met.groupBy("node").agg(F.max(F.struct("times", "other")).alias("best"))
    pairs = _ordered(best.select("node", "best.other"))
    links = staged(_similar(_fingerprint_pairs(nodes).union(pairs).distinct(), nodes, rows), "links")

    joined = components(links).select("node", "root")
    placed = index.join(joined, "node", "left").select("h", "node", "size", "at", F.coalesce("root", "node").alias("part"))
    apart = placed.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h")
    open_ = staged(placed.join(apart, "h"), "apart")
    links = links.union(staged(_similar(_crossed(open_), nodes, rows), "links"))

    groups = nodes.select("node").join(components(links), "node", "left")
    return signed.select("row", "node"), groups.select("node", F.coalesce("root", "node").alias("group"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group: the one with the smallest id (then the smallest text hash).

    Rows equal in id and text are one row afterwards. Null ids come last.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.length("text"))
    marked, groups = grouped(docs.select(order.alias("row"), "text"))
    smallest = marked.groupBy("node").agg(F.min("row").alias("row")).join(groups, "node")
    kept = smallest.groupBy("group").agg(F.min("row").alias("row")).select("row")
    # One shuffle, by row, both removes repeated rows and finds the ones that stay.
    rows = packed(docs, row=order).withColumn("kept", F.lit(None).cast("boolean"))
    both = rows.unionByName(kept.select(F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), "row", F.lit(True).alias("kept")))
    found = both.groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.max("kept").alias("kept"))
    return unpacked(found.where("kept"), docs.columns)
