"""Token-id output: Parquet files of token lists that allow reading few tokens or only metadata.

One row per document, in ascending (doc_id, text hash) order over the numbered files. The columns are
`doc_id`, `part` (number of the range that the row was sorted into), `before` (ids of earlier documents
of the same part), `n_tokens` and `ids`. Ids are dictionary encoded (the writer falls back to delta
encoding where a dictionary does not pay), row groups and pages have set sizes, and the files carry
column and offset indexes, so that a filter on `doc_id` reads only the pages it needs and a query
that names no ids reads none. A document's global start is its part's offset plus `before`.

Null texts are empty: they hold the end id only. Null doc_ids sort first; documents with equal ids
are ordered by a hash of their texts. An empty table gives files without rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import worker_state

#: Sizes in bytes. A row group is the unit of skipping by file footer, a page that of the page index.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
#: Texts go to the tokenizer in portions of about so many bytes.
_PORTION = 4 << 20
#: Texts that are not cut at their spaces: with other white space than single spaces and line ends between words.
_ODD = "^ | $|  |\n\n| \n|\n |[\t\x0b-\r\x1c-\x1f\x00\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Bytes of words whose ids a worker keeps; beyond, the older half goes. With the ids, about three times as much.
_KEPT = 24 << 20


def _portions(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + _PORTION, "right")))
        yield texts.slice(at, end - at)
        at = end


class _Encoder:
    """Ids of texts by a byte-level tokenizer, which is asked once for each distinct word.

    Its pre-tokens never reach past a single space between words, so a text's ids are those of its words, each with the
    space before it, in order; a line end is part of the word it is in. A text with other white space is encoded in one piece, and so is
    one that holds an added token such as <|endoftext|>, which gets its own id as in the library's plain encoding.
    Words are cut, numbered and compared as Arrow arrays; only words that are new become Python strings.
    """

    def __init__(self, model, end_id: int) -> None:
        self.model, self.end_id = model, end_id
        added = [re.escape(token.content) for token in model.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *added])
        self.words, self.ids, self.starts = pa.array([], pa.string()), np.array([], np.int32), np.array([0])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        ids, sizes = [np.array([], np.int32)], [np.array([], np.int64)]
        for at in range(0, len(words), 10_000):  # the tokenizer's own results are far larger than the ids
            lists = [e.ids for e in self.model.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: pa.StringArray) -> np.ndarray:
        """Where the distinct `words`, each after a space, are among the words that are kept."""
        if self.words.nbytes > _KEPT:
            half = len(self.words) // 2
            first = self.starts[half]
            self.words, self.ids, self.starts = pa.concat_arrays([self.words.slice(half)]), self.ids[first:].copy(), self.starts[half:] - first
        where = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = where < 0
        if unknown.any():
            new = words.filter(pa.array(unknown))
            ids, sizes = self._encoded(pc.binary_join_element_wise(" ", new, "").to_pylist())
            where[unknown] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids, self.starts = np.concatenate((self.ids, ids)), np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        return where

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end in it."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = cut.values.dictionary_encode()
        place = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        starts, sizes = self.starts[place], self.starts[place + 1] - self.starts[place]
        offsets = cut.offsets.to_numpy().astype(np.int64)
        # The first word of a text has no space before it, and an odd text is encoded whole in its place.
        first = offsets[:-1]
        own, own_sizes = self._encoded(pc.if_else(pa.array(odd), texts, cut.values.take(pa.array(first))).to_pylist())
        starts[first] = len(self.ids) + 1 + np.cumsum(own_sizes) - own_sizes
        sizes[first] = own_sizes
        # Every text ends with the end id.
        starts, sizes = np.insert(starts, offsets[1:], len(self.ids)), np.insert(sizes, offsets[1:], 1)
        ends = np.cumsum(sizes)
        places = np.arange(int(ends[-1])) + np.repeat(starts - ends + sizes, sizes)
        pool = np.concatenate((self.ids, np.array([self.end_id], np.int32), own))
        return pool[places], ends[offsets[1:] + np.arange(len(texts))]


def _encoder(vocabulary: str, end_id: int, keep: bool) -> _Encoder:
    """An encoder: this worker's, which keeps its words from task to task, or a new one."""
    encoders = worker_state().setdefault("encoders", {}) if keep else {}
    key = (hashlib.sha256(vocabulary.encode()).hexdigest(), end_id)
    if key not in encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(vocabulary)
        encoders[key] = _Encoder(model, end_id)
    return encoders[key]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, parts: int, keep_words: bool = True) -> DataFrame:
    """Sorted (doc_id, part, before, n_tokens, ids) of documents `(doc_id, text)`.

    With `keep_words` a Python worker keeps its tokenizer and words from task to task, which saves about a third of the time and takes
    some 150 MB of each worker until it ends; without, they go with the task.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a file of fixed size
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, end_id, keep_words)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in _portions(batch.column(1)):
                ids, ends = encoder.encode(texts)
                sizes = np.diff(ends, prepend=0)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(np.full(len(texts), part, np.int32)),
                        pa.array(before + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    ],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                at += len(texts)
                before += int(ends[-1])
        pa.default_memory_pool().release_unused()  # the worker goes on to other work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(encode, f"doc_id {kind}, part int, before long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None, keep_words: bool = True) -> None:
    """Encode `docs` and write the files under `path`; `parts` files (default: the shuffle partitions)."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded(docs, tokenizer, end_id, parts, keep_words).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.block.size": str(ROW_GROUP_BYTES),
            "parquet.page.size": str(PAGE_BYTES),
        }
    ).parquet(path)


_SCHEMA = "doc_id {}, part int, before long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) of the files; select without `ids` to read metadata only.

    `start` counts the ids of all documents before this one. It needs one number per part, so only
    three small columns are read for it, and the offsets, a row for each part, go to the files and not the ids to them.
    """
    files = spark.read.schema(_SCHEMA.format(id_type)).parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    start = (F.col("offset") + F.col("before")).alias("start")
    return files.join(F.broadcast(offsets), "part").select("doc_id", "part", start, "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Tokens of the documents with low <= doc_id <= high: page indexes skip the rest."""
    return read_tokens(spark, path).where(F.col("doc_id").between(low, high))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of `read_tokens`: the checksum is over little-endian uint32 ids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            bounds = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].data) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        sums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )
