"""Prefix trie of conversations: one row for every distinct opening of a conversation, with totals of what shares it.

A turn is 24 bytes: 16 of the SHA-256 of its role and text, and its number of words. A conversation's path is its
turns one after the other, so the order of paths is the order of the trie. Paths are sorted into ranges, and a range is cut into
shards of a bounded number of turns. A shard is a double-array trie over dense turn ids: state s has a child t =
BASE[s] + id if CHECK[t] = s. All sequences of the shard walk it level by level, and totals are summed in its states.

Shards are neighbours in the order of paths, so a node can be in several only if it is on the path of the first or the
last sequence of a shard. These edge nodes, a few for each shard, are merged over all shards: equal ones are grouped by
a hash of their path, and one pass in path order adds up their subtrees with a stack as deep as the longest of them. A hot opening or a
conversation that thousands repeat is cut between shards like any other. The hash of a node's ids is over one string, so its ids are
hashed in one stream, in pieces of bounded size.

A conversation's digests (24 bytes a turn, no text) are one row. Null roles and texts are empty. Null turns come first, equal turns
are ordered by their digests, repeated rows are repeated turns. Rows without a conv_id belong to no conversation and give nothing. Columns
beyond the four are ignored. Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged
from veilspark.llm.mixing import word_count

#: Bytes of a turn in a path, and how many of them are its digest; the rest is its number of words, big-endian.
UNIT, DIGEST = 24, 16
#: Turns of a shard, and bytes of conversation ids that are kept or sent in one piece.
SHARD_TURNS, PIECE_BYTES = 500_000, 1 << 20
_NO_IDS = hashlib.sha256(b"").hexdigest()
#: Free slots that are tried for a node with several children; nodes with more children than _WIDE go to the end at once.
_TRIES, _WIDE = 64, 4096


def turn_unit(role: Column, text: Column) -> Column:
    """The unit of a turn as hex digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(word_count(text)), 2 * (UNIT - DIGEST), "0"))


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of rows `(conv_id, turn, role, text)`; paths are hex digits."""
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_unit(F.col("role"), F.col("text")).alias("unit"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "unit")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["unit"]), "").alias("path"))


def with_shared_heads(paths: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Paths whose first h turns are those of conversation `conv_id - conv_id % block`, h = crc32(conv_id as text) % `heads`."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads * 2 * UNIT).cast("int")
    rows = paths.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    first = paths.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, (heads - 1) * 2 * UNIT).alias("head"))
    head = F.coalesce(F.substr("head", F.lit(1), F.col("h")), F.lit(""))
    return rows.join(first, "base", "left").select("conv_id", F.concat(head, F.substr("path", F.col("h") + 1)).alias("path"))


class DoubleArray:
    """A trie in two arrays, filled level by level; state 0 is the root."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = -2
        self.low, self.top = 1, 1  # all slots before `low` are taken, all from `top` on are free

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def _free(self, n: int) -> np.ndarray:
        """The first `n` free slots."""
        self._reach(self.top + n)
        width = 4096
        while True:
            free = np.flatnonzero(self.check[self.low : self.low + width] < 0) + self.low
            if len(free) >= n:
                self.low = int(free[0])
                return free[:n]
            width *= 4
            self._reach(min(self.low + width, self.top + n))

    def _place(self, parent: int, symbols: np.ndarray) -> None:
        base = self.top - int(symbols[0])
        if len(symbols) <= _WIDE:
            bases = self._free(_TRIES) - symbols[0]
            self._reach(int(bases[-1] + symbols[-1]) + 1)
            fits = np.flatnonzero((self.check[bases[:, None] + symbols] < 0).all(1))
            base = int(bases[fits[0]]) if len(fits) else base
        self._reach(base + int(symbols[-1]) + 1)
        self.base[parent] = base
        self.check[base + symbols] = parent
        self.top = max(self.top, base + int(symbols[-1]) + 1)

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Give `parents`, which have no children yet, one child for each of the distinct pairs (grouped by parent)."""
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(starts, append=len(parents))
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            self._place(int(parents[start]), np.sort(symbols[start : start + size]))
        single = starts[sizes == 1]
        if len(single):
            slots = self._free(len(single))
            self.base[parents[single]] = slots - symbols[single]
            self.check[slots] = parents[single]
            self.top = max(self.top, int(slots[-1]) + 1)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of `states` by `symbols`; -1 where there is none."""
        at = self.base[states] + symbols
        inside = np.where((at >= 0) & (at < len(self.check)), at, 0)
        return np.where((self.check[inside] == states) & (at == inside), inside, -1)


_KINDS = {
    "kind": pa.string(), "shard": pa.int64(), "side": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "words": pa.int64(),
    "key": pa.binary(), "parent": pa.binary(), "ends": pa.string(),
}
_SCHEMA = pa.schema(_KINDS.items())
_DDL = ", ".join(f"{name} {({pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[kind]}" for name, kind in _KINDS.items())


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of `n` rows; a missing column is null, a single value fills its column."""

    def column(name: str, kind: pa.DataType) -> pa.Array:
        value = columns.get(name)
        if value is None:
            return pa.nulls(n, kind)
        if isinstance(value, pa.Array):
            return value
        return pa.array(value, kind) if isinstance(value, np.ndarray | list) else pa.repeat(pa.scalar(value, kind), n)

    return pa.RecordBatch.from_arrays([column(*x) for x in _KINDS.items()], schema=_SCHEMA)


def _chain(path: bytes) -> list[bytes]:
    """A hash for every prefix of a path, the empty one first."""
    keys = [b"\0" * 16]
    for at in range(0, len(path), UNIT):
        keys.append(hashlib.blake2b(keys[-1] + path[at : at + UNIT], digest_size=16).digest())
    return keys


class _Run:
    """The conversations with one path: how many, the smallest id, and the text of ids that were not sent yet."""

    def __init__(self, path: bytes, conv_id: int) -> None:
        self.path, self.conv_id, self.count, self.last, self.size, self.sent = path, conv_id, 0, [], 0, False

    def add(self, conv_id: int) -> None:
        self.count += 1
        text = str(conv_id)
        self.last.append(text)
        self.size += len(text) + 1

    def take(self) -> str:
        text, self.last, self.size = ",".join(self.last), [], 0
        return text


def _shard(number: int, runs: list[_Run]) -> Iterator[pa.RecordBatch]:
    """The nodes, edge nodes and edge ids of a shard with these sequences, which are sorted by path."""
    lengths = np.array([len(r.path) // UNIT for r in runs])
    ends = np.cumsum(lengths)
    units = np.frombuffer(b"".join(r.path for r in runs), np.uint8)
    by_level = np.lexsort((np.repeat(np.arange(len(runs)), lengths), np.arange(len(units) // UNIT) - np.repeat(ends - lengths, lengths)))
    level_units = units.reshape(-1, UNIT)[by_level]
    # Numbered as they appear level by level, so that ids of siblings are close to each other.
    coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(UNIT), len(by_level), [None, pa.py_buffer(level_units.tobytes())]).dictionary_encode()
    symbols = coded.indices.to_numpy().astype(np.int64)
    words_of = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint8).reshape(-1, UNIT)[:, DIGEST:].copy().view(">i8").ravel().astype(np.int64)

    trie, states, levels, at = DoubleArray(), np.zeros(len(runs), np.int64), [np.array([0])], 0
    first, last = [0], [0]  # the states on the paths of the first and the last sequence
    active = np.arange(len(runs))
    walked, visits = [states.copy()], [active]
    level_words = [np.array([0])]
    for depth in range(int(lengths.max(initial=0))):
        active = active[lengths[active] > depth]
        parents, own = states[active], symbols[at : at + len(active)]
        at += len(active)
        new = np.flatnonzero((np.diff(parents, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        trie.add(parents[new], own[new])
        states[active] = walked_now = trie.step(parents, own)
        levels.append(walked_now[new])
        level_words.append(words_of[own[new]])
        walked.append(walked_now)
        visits.append(active)
        if lengths[0] > depth:
            first.append(int(states[0]))
        if lengths[-1] > depth:
            last.append(int(states[-1]))

    size = trie.top
    weight, ids = np.array([r.count for r in runs]), np.array([r.conv_id for r in runs])
    n_convs, conv = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    for now, active in zip(walked, visits, strict=True):
        np.add.at(n_convs, now, weight[active])
        np.minimum.at(conv, now, ids[active])
    edge = np.zeros(size, bool)
    edge[first + last] = True
    n_children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for level, words in zip(levels[:0:-1], level_words[:0:-1], strict=True):
        inner = level[~edge[level]]
        leaves[inner] += n_children[inner] == 0
        saved[inner] += (n_convs[inner] - 1) * words[~edge[level]]
        above = trie.check[inner]
        np.add.at(n_children, above, 1)
        np.add.at(leaves, above, leaves[inner])
        np.add.at(saved, above, saved[inner])

    keys_first, keys_last = _chain(runs[0].path), _chain(runs[-1].path)
    key_of = dict(zip(first, keys_first, strict=True)) | dict(zip(last, keys_last, strict=True))
    ends_of = {}
    for state, run in zip(states.tolist(), runs, strict=True):
        if not edge[state]:
            ends_of[state] = hashlib.sha256(run.take().encode()).hexdigest()
        elif text := run.take():
            yield _rows(1, kind="ids", shard=number, key=key_of[state], ends=text)
    for depth, level in enumerate(levels[1:], 1):
        inner = level[~edge[level]]
        above = trie.check[inner]
        for part in range(0, len(inner), 10_000):
            own, over = inner[part : part + 10_000], above[part : part + 10_000]
            yield _rows(
                len(own), kind="node", shard=number, depth=depth, conv_id=conv[own], n_convs=n_convs[own], n_children=n_children[own],
                n_leaves=leaves[own], saved_tokens=saved[own], ends=[ends_of.get(s, _NO_IDS) for s in own.tolist()],
                parent_conv_id=pa.array(conv[over], mask=edge[over]), parent=[key_of.get(s) for s in over.tolist()],
            )
    words = np.zeros(size, np.int64)
    for level, n in zip(levels, level_words, strict=True):
        words[level] = n
    for side, (path, keys) in enumerate(((first, keys_first), (last, keys_last))):
        shared = next((d for d, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last))) if side else 0
        own = np.array(path[shared:], np.int64)
        if len(own):
            yield _rows(
                len(own), kind="edge", shard=number, side=side, depth=np.arange(shared, len(path)), conv_id=conv[own], n_convs=n_convs[own],
                n_children=n_children[own], n_leaves=leaves[own], saved_tokens=saved[own], words=words[own], key=keys[shared : len(path)],
            )


def shards(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The rows of all shards of `(conv_id, path)`: kind `node` is complete, `edge` and `ids` are to be merged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, runs, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for path, conv_id in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if not runs or runs[-1].path != path:
                    # A sequence whose ids went out in pieces ends its shard, as only edges are merged.
                    if runs and (turns >= shard_turns or runs[-1].sent):
                        yield from _shard(number, runs)
                        number, runs, turns = number + 1, [], 0
                    runs.append(_Run(path, conv_id))
                    turns += len(path) // UNIT
                run = runs[-1]
                run.add(conv_id)
                if run.size >= PIECE_BYTES:
                    run.sent = True
                    yield _rows(1, kind="ids", shard=number, key=_chain(path)[-1], ends=run.take())
        if runs:
            yield from _shard(number, runs)

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binary = paths.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex("path").alias("path"))
    ordered = binary.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(build, _DDL)


def _merged_edges(edges: DataFrame) -> DataFrame:
    """Every edge node once, complete but for its ids, with its key. The single ordered pass has only edge rows."""
    one = edges.groupBy("key").agg(
        F.min(F.struct("shard", "side", "depth")).alias("place"),
        F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    ordered = one.select("place.depth", "key", "conv_id", "words", "n_convs", "n_children", "n_leaves", "saved_tokens", "place").repartition(1).sortWithinPartitions("place").drop("place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # the open nodes, from the root down
        done: list[list] = []

        def close() -> None:
            node = stack.pop()
            depth, _, conv_id, words, n_convs, n_children, n_leaves, saved = node
            node[6], node[7] = n_leaves + (n_children == 0), saved + (n_convs - 1) * words
            above = stack[-1] if stack else None
            if above:
                above[5], above[6], above[7] = above[5] + 1, above[6] + node[6], above[7] + node[7]
            done.append([above[2] if above else None, *node])

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                columns = list(zip(*done, strict=True))
                names = ["parent_conv_id", "depth", "key", "conv_id", "words", "n_convs", "n_children", "n_leaves", "saved_tokens"]
                kinds = [_KINDS[n] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                done.clear()

        for batch in batches:
            for node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and stack[-1][0] >= node[0]:
                    close()
                stack.append(list(node))
                if len(done) >= 10_000:
                    yield from out()
        while stack:
            close()
        yield from out()

    return ordered.mapInArrow(
        merge, "parent_conv_id long, depth long, key binary, conv_id long, words long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    )


def _hashed_ids(pieces: DataFrame) -> DataFrame:
    """(key, ends) from pieces of ids: those of a key are hashed as one stream, in order."""
    # Ids of a path ascend from piece to piece, so a piece's first id is its place.
    first = F.substring_index("ends", ",", 1).cast("long").alias("first")
    ordered = pieces.select("key", "ends", first).repartition("key").sortWithinPartitions("key", "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for now, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if now != key:
                    if sha:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])
                    key, sha = now, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])

    return ordered.select("key", "ends").mapInArrow(digest, "key binary, ends string")


def prefix_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of `(conv_id, path)`: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = staged(shards(staged(paths, "paths"), shard_turns), "shards")
    edges = rows.where("kind = 'edge'")
    merged = staged(_merged_edges(edges), "edges")
    ids = _hashed_ids(rows.where("kind = 'ids'"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = merged.join(ids, "key", "left").select(*columns, F.coalesce("ends", F.lit(_NO_IDS)).alias("ends_sha256"))
    own = rows.where("kind = 'node'")
    # A node below an edge node finds it by its shard, so the many children of the root meet it once in each shard.
    parents = edges.select("shard", F.col("key").alias("parent")).distinct()
    parents = parents.join(merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("of")), "parent")
    below = own.where("parent IS NOT NULL").join(parents, ["shard", "parent"]).withColumn("parent_conv_id", F.col("of"))
    inner = own.where("parent IS NULL")
    return below.select(*columns, F.col("ends").alias("ends_sha256")).union(inner.select(*columns, F.col("ends").alias("ends_sha256"))).union(shared)
