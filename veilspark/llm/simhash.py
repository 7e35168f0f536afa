"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (UTF-8, seed 42) of a text's three-word
shingles, repeats included. Distinct fingerprints are laid out in tiles by the number of bits set in
each of their four 16-bit parts. The sum of the differences of two such counts is a lower bound of the
number of differing bits, so a pair of tiles beyond the radius is skipped and every other pair is
compared in full by numpy, exclusive-or and bit counts. Tiles hold at most about `TILE` fingerprints; a larger one
is split by hash, and its pieces are compared with each other. A pair of tiles gives a spanning forest
of its links, never all of them, and a connected-components job joins the forests.

Copies have one fingerprint, so a group of copies of any size is one node. A null or empty text has
fingerprint zero and is linked like any other. Null ids come last when the smallest id is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import packed, spaced_words, staged, unpacked, utf8
from veilspark.llm.components import components

RADIUS = 2
TILE = 2048
_PARTS, _PART_BITS, _PAD, _BASE = 4, 16, 7, 32
#: Fingerprint pairs compared at once: the largest array is eight times as many bytes.
_CELLS = 1 << 20


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a word list."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    parts = [words[i : i + n] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    return majority(np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*parts, strict=True)), repeat(seed)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, zero of none."""
    n = len(hashes)
    # Bits are added as bytes in groups of 255, which cannot overflow, and the groups as integers.
    groups = -(-n // 255)
    padded = np.zeros(groups * 255, np.uint64)
    padded[:n] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits.reshape(groups, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, others: str) -> DataFrame:
    """Rows `(others, text)` with `text` replaced by `fp`, the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(spaced_words(t)) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(others), pa.array(np.array(values, np.uint64).view(np.int64))], [others, "fp"]
            )

    kind = rows.schema[others].dataType.simpleString()
    return rows.select(others, "text").mapInArrow(score, f"{others} {kind}, fp long")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label` (the root of every node) after joining the groups of both ends of every link (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) that connect what is linked between fingerprints of `a` and `b`, or within `a` if `b` is None."""
    other = a if b is None else b
    nodes = a if b is None else np.concatenate((a, b))
    shift = 0 if b is None else len(a)
    label = np.arange(len(nodes))
    step = max(1, _CELLS // max(1, len(other)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= radius)
        if len(i):
            label = _joined(label, i + at, j + shift)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tile(fp: Column) -> Column:
    """The bit counts of the four parts as digits of one number, each large enough to add or take the radius."""
    counts = (F.bit_count(F.shiftrightunsigned(fp, _PART_BITS * k).bitwiseAND(0xFFFF)) for k in range(_PARTS))
    return sum(((count + _PAD) * _BASE**k for k, count in enumerate(counts)), F.lit(0)).cast("long")


def near_links(distinct: DataFrame, radius: int = RADIUS, tile_size: int = TILE) -> DataFrame:
    """(node, root) links that connect all fingerprints `fp` (distinct rows) within `radius` of each other."""
    if radius > _PAD:
        raise ValueError(f"radius above {_PAD}")
    tiled = distinct.select("fp", _tile(F.col("fp")).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_size).alias("pieces"))
    placed = tiled.join(sizes, "tile").select("fp", "tile", F.pmod(F.xxhash64("fp"), F.col("pieces")).alias("piece"))
    tiles = staged(placed.groupBy("tile", "piece").agg(F.collect_list("fp").alias("fps")), "tiles")
    # Of a tile and its neighbour, the one that comes first in order of offsets looks for the other.
    steps = [d for d in product(range(-radius, radius + 1), repeat=_PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * _PARTS]
    offsets = F.explode(F.array(*(F.lit(sum(x * _BASE**k for k, x in enumerate(d))) for d in steps)))
    left = tiles.select(F.col("tile").alias("own"), F.col("piece").alias("own_piece"), F.col("fps").alias("own_fps"), offsets.alias("step"))
    left = left.withColumn("tile", F.col("own") + F.col("step"))
    same = F.col("own") == F.col("tile")
    pairs = left.join(tiles, "tile").where(~same | (F.col("own_piece") <= F.col("piece")))
    alone = same & (F.col("own_piece") == F.col("piece"))
    pairs = pairs.select("own_fps", F.when(~alone, F.col("fps")).alias("fps"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                own = a.values.to_numpy().view(np.uint64)
                other = b.values.to_numpy().view(np.uint64) if b.is_valid else None
                node, root = tile_links(own, other, radius)
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["node", "root"])

    return pairs.mapInArrow(compare, "node long, root long")


def grouped(rows: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(fingerprinted rows `(row, fp)`, `(fp, group)` of every fingerprint) of rows `(row, text)`."""
    marked = staged(fingerprints(rows, "row"), "fingerprints")
    distinct = staged(marked.select("fp").distinct(), "distinct")
    linked = components(near_links(distinct, radius))
    groups = distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return marked, groups.select("fp", F.coalesce("root", "fp").alias("group"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text)."""
    marked, groups = grouped(docs.select(F.col("doc_id").alias("row"), "text"), radius)
    smallest = marked.groupBy("fp").agg(F.min("row").alias("least")).join(groups, "fp")
    of_group = smallest.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = smallest.select("fp", "group").join(of_group, "group").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_fp, "fp").select(F.col("row").alias("doc_id"), text, "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` for each group: the one with the smallest id (then the smallest text hash).

    Rows equal in id and text are one row afterwards. Null ids come last.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.length("text"))
    marked, groups = grouped(docs.select(order.alias("row"), "text"), radius)
    smallest = marked.groupBy("fp").agg(F.min("row").alias("row")).join(groups, "fp")
    kept = smallest.groupBy("group").agg(F.min("row").alias("row")).select("row")
    rows = packed(docs, row=order)
    return unpacked(rows.join(kept, "row", "left_semi").dropDuplicates(["row"]), docs.columns)
