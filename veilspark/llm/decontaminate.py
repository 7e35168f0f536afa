"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, looked up in every text.

A window is ten consecutive words of an item; an item of fewer words, but not none, is one window. Texts are
scanned for places where every word occurs in some window, a test that costs one set lookup a word,
and only there are the words joined and looked up, so every hit is exact.

The set is built from as many slices of the windows as its size asks for: one slice of at most
`slice_windows` windows is broadcast at a time, and beyond one slice the words hit so far are written
to the shared folder between passes. Null texts have no words; an item without words or with a null id hits
nothing; items that share an id count as one. Repeated documents are scanned each. Without
benchmark rows nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import packed, plain_words, staged, unpacked, utf8

WINDOW = 10
#: Windows of one broadcast set: about 100 bytes each, so some 200 MB in a Python worker at most.
SLICE_WINDOWS = 1_000_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id string, words binary) of `(item_id, text)`; words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = plain_words(text)
                last = max(len(words) - window, 0)
                found = list({b" ".join(words[i : i + window]) for i in range(last + 1)} - {b""})
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item_id", "words"]
                    )

    items = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL")
    return items.mapInArrow(cut, "item_id string, words binary").distinct()


def _find(words: list[bytes], vocabulary: set[bytes], windows: dict[int, dict[bytes, list[str]]]):
    """(start, words, items) of every window in `words`."""
    known = np.fromiter(map(vocabulary.__contains__, words), np.int32, len(words))
    total = np.concatenate(([0], np.cumsum(known)))
    for n, items_of in windows.items():
        if n <= len(words):
            for i in np.flatnonzero(total[n:] - total[:-n] == n).tolist():
                if items := items_of.get(b" ".join(words[i : i + n])):
                    yield i, n, items


_STATE = "doc {}, hit binary, items array<string>"
_TOTALS = "doc {}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _pass(state: DataFrame, grams: DataFrame, last: bool) -> DataFrame:
    """`state` with the windows `grams` (at most one slice) added to `hit` (a bit a word) and `items`; the last pass counts them."""
    rows = grams.toArrow()  # bounded by SLICE_WINDOWS
    shared = state.sparkSession.sparkContext.broadcast(
        (rows.column("item_id").to_pylist(), rows.column("words").to_pylist())
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[int, dict[bytes, list[str]]] = {}
        vocabulary: set[bytes] = set()
        for item, gram in zip(*shared.value, strict=True):
            words = gram.split(b" ")
            vocabulary.update(words)
            windows.setdefault(len(words), {}).setdefault(gram, []).append(item)
        for batch in batches:
            sizes, hits, found = [], [], []
            old = zip(batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (bits, items) in zip(utf8(batch.column("doc").field("text")), old, strict=True):
                words = plain_words(text)
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)) if bits else np.zeros(len(words), np.uint8)
                names = set(items or ())
                for i, n, more in _find(words, vocabulary, windows):
                    mask[i : i + n] = 1
                    names.update(more)
                sizes.append(len(words))
                hits.append(int(mask.sum()) if last else np.packbits(mask).tobytes())
                found.append(sorted(names))
            if last:
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                totals = (sizes, hits, list(map(len, found)))
                columns = [*(pa.array(x, pa.int64()) for x in totals), pa.array(sha, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
                labels = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            else:
                columns = [pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))]
                labels = ["hit", "items"]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", *labels])

    return state.mapInArrow(scan, (_TOTALS if last else _STATE).format(state.schema["doc"].dataType.simpleString()))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(doc struct, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs` (doc_id, text, ...)."""
    grams = staged(benchmark_windows(benchmark, window), "windows")
    slices = -(-grams.count() // slice_windows) or 1
    none = {"hit": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")}
    state = packed(docs, **none)
    for k in range(slices):
        part = grams.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k)
        state = _pass(staged(state, "scan") if k else state, part, last=k == slices - 1)
    return state


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, as they are."""
    return unpacked(scanned(docs, benchmark, **options).where("NOT contaminated"), docs.columns)
