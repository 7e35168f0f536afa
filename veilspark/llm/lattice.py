"""LM scoring: the marginal likelihood of a text over all segmentations of its words into subword pieces.

Every word of a text is either drawn whole, with its absolutely discounted training count, or spelled
from the pieces of an existing subword vocabulary: a piece that starts a word, pieces that go on, and an end of
word. The mass that the discount frees is the spelling's. A forward recursion in log space over the
lattice of pieces sums all spellings. Words and the end of a text are independent draws, and all shares
add up to one, so the sum of their log10 is the log10 probability of the text.

The vocabulary is fixed. Its own scores (a merge order, no probabilities) give the first weights, 1 / (2 + rank), and
stay as a prior of `PRIOR` pieces; `ROUNDS` rounds of expectation-maximisation over all distinct
training words fit the weights. Every single byte is a piece, so any text has a probability.

Words are counted per block, a set of documents of about `BLOCK_BYTES` of text chosen by hash, so that a
frequent word is one row a block and no text is joined by its words. Counts are summed over blocks,
each distinct word is scored once, and the scores go back to the blocks that hold it, where the
documents are scored. Tables on the way grow with the number of distinct words.

Null texts are empty: the end is their one token. A null id counts as empty text in the choice of held-out
documents. Without training documents every word is spelled with the first weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import run_folder, spaced_words, staged, utf8

DISCOUNT = 0.75
ROUNDS = 2
PRIOR = 2_000.0
BLOCK_BYTES = 8 << 20
BLOCKS_PER_BUCKET, MAX_BUCKETS = 4, 20_000
#: Stands for the end of a text among words, none of which is empty.
END = b""
_MARK = "▁"
_CHUNK = 20_000


@dataclass
class Pieces:
    """Pieces as byte strings with natural-log weights: `start` ones (word-initial) come first, then the others.

    Piece 0 starts a word with nothing, the last one ends a word.
    """

    names: list[bytes]
    n_start: int
    weights: np.ndarray

    @classmethod
    def from_vocabulary(cls, scored: list[tuple[str, int]]) -> Pieces:
        """From `(piece, rank)`; single bytes are added with the last rank."""
        last = max((r for _, r in scored), default=0) + 1
        groups: tuple[dict[bytes, int], dict[bytes, int]] = ({b"": 0}, {bytes([b]): last for b in range(256)})
        for piece, rank in scored:
            text = piece.removeprefix(_MARK).encode()
            first = piece.startswith(_MARK)
            if text == text.lower() and _MARK.encode() not in text and (text or first):
                groups[0 if first else 1][text] = min(rank, groups[0 if first else 1].get(text, rank))
        names = [*groups[0], *groups[1], b""]
        ranks = np.array([*groups[0].values(), *groups[1].values(), 0], float)
        pieces = cls(names, len(groups[0]), np.zeros(len(names)))
        return pieces.weighted(1 / (2 + ranks), 0.0)

    def weighted(self, counts: np.ndarray, prior: float = PRIOR) -> Pieces:
        """With the weights of `counts`, smoothed by `prior` pieces of the present weights; both groups sum to one."""
        counts = counts + prior * np.exp(self.weights) if prior else counts
        total = np.concatenate((np.full(self.n_start, counts[: self.n_start].sum()), np.full(len(counts) - self.n_start, counts[self.n_start :].sum())))
        return Pieces(self.names, self.n_start, np.log(counts) - np.log(total))


def vocabulary(path: str) -> list[tuple[str, int]]:
    """(piece, rank) of a sentencepiece file whose scores are the negative order of its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return [(model.id_to_piece(i), round(-model.get_score(i))) for i in plain]


class Lattice:
    """Forward and backward recursions over many words of one length at a time."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        children: list[dict[int, int]] = [{}, {}, {}]  # node 0 is dead, 1 starts a word, 2 goes on
        ends = {}
        for k, name in enumerate(pieces.names[:-1]):
            node = 1 if k < pieces.n_start else 2
            for byte in name:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = k
        self.next = np.zeros((len(children), 256), np.int32)
        for node, to in enumerate(children):
            if to:
                self.next[node, list(to)] = list(to.values())
        self.piece = np.full(len(children), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.piece[1] = -1  # the empty start has no letters; it is the step to position 0 of the others

    def _arcs(self, letters: np.ndarray, root: int, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the pieces that start at `at` in each row."""
        rows = np.arange(len(letters))
        nodes = np.full(len(letters), root, np.int32)
        for end in range(at + 1, letters.shape[1] + 1):
            nodes = self.next[nodes, letters[rows, end - 1]]
            alive = nodes > 0
            rows, nodes = rows[alive], nodes[alive]
            if not len(rows):
                return
            piece = self.piece[nodes]
            whole = piece >= 0
            if whole.any():
                yield end, rows[whole], piece[whole]

    def run(self, letters: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural-log probability of each row of `letters`; adds expected piece counts to `expected`."""
        n, size = letters.shape
        weights = self.pieces.weights
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = weights[0]
        kept = []
        for at, root in [(0, 1), *((k, 2) for k in range(size))]:
            if root == 2 and at and not np.isfinite(alpha[at]).any():
                continue
            for end, rows, piece in self._arcs(letters, root, at):
                before = alpha[at, rows] if root == 2 else 0.0
                alpha[end, rows] = np.logaddexp(alpha[end, rows], before + weights[piece])
                if expected is not None:
                    kept.append((at, root, end, rows, piece))
        total = alpha[size] + weights[-1]
        if expected is not None:
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = weights[-1]
            for at, root, end, rows, piece in reversed(kept):
                after = weights[piece] + beta[end, rows]
                before = alpha[at, rows] if root == 2 else 0.0
                expected += np.bincount(piece, np.exp(before + after - total[rows]), len(expected))
                if root == 2:
                    beta[at, rows] = np.logaddexp(beta[at, rows], after)
            expected[0] += np.exp(weights[0] + beta[0] - total).sum()
            expected[-1] += n
        return total

    def words(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Natural-log spelling probability of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        out = np.empty(len(words))
        bounds = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(words)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            size = int(sizes[order[a]]) if b > a else 0
            if not size:
                out[order[a:b]] = self.pieces.weights[0] + self.pieces.weights[-1]
                continue
            step = max(1, (1 << 21) // size)  # bounds the arrays where words are long
            for c in range(a, b, step):
                own = order[c : min(c + step, b)]
                letters = np.frombuffer(b"".join([words[k] for k in own]), np.uint8).reshape(len(own), size)
                out[own] = self.run(letters, expected)
        return out


def _fitted(pieces: Pieces, counts: DataFrame) -> Pieces:
    """`pieces` after one round of expectation-maximisation over the distinct words of `counts` (word)."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lattice, expected = Lattice(own), np.zeros(len(own.names))
        for batch in batches:
            lattice.words(utf8(batch.column(0)), expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(expected[used])], ["piece", "n"])

    rows = counts.select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(pieces.names))
    for piece, n in rows:
        total[piece] = n
    return pieces.weighted(total)


def _block_words(blocked: DataFrame) -> DataFrame:
    """(block, word, trained): the distinct words of every block and their training count there.

    A file holds whole blocks, so a pair comes once, or a few times where Spark splits a file or a task
    has gathered many words, gives them out and starts anew.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[Counter[bytes], Counter[bytes]]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, (train, rest) in seen.items():
                words = list(train.keys() | rest.keys())
                for k in range(0, len(words), _CHUNK):
                    part = words[k : k + _CHUNK]
                    columns = [pa.array([block] * len(part), pa.int64()), pa.array(part, pa.binary()), pa.array([train[w] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "word", "trained"])
            seen.clear()

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True)
            for block, held_out, text in rows:
                words = spaced_words(text)
                words.append(END)
                seen.setdefault(block, (Counter(), Counter()))[held_out].update(words)
                held += len(words)
            if held > 20_000_000:
                yield from out()
                held = 0
        yield from out()

    return blocked.select("block", "held_out", "text").mapInArrow(count, "block long, word binary, trained long")


def _bucketed(rows: DataFrame, blocks: int) -> DataFrame:
    """`rows` written once, bucketed by `block`: grouping them by it later moves no text."""
    spark = rows.sparkSession
    path = run_folder(spark, "blocks")
    name = "veilspark_" + path.rpartition("/")[2].replace("-", "_")
    buckets = max(1, min(-(-blocks // BLOCKS_PER_BUCKET), MAX_BUCKETS))
    writer = rows.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block")
    writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def score_documents(docs: DataFrame, held_out: Column, scored: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    blocked = _bucketed(rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "*"), blocks)
    pairs = staged(_block_words(blocked), "pairs", compression="zstd")
    counts = staged(pairs.groupBy("word").agg(F.sum("trained").alias("c")), "counts", compression="zstd")
    known = counts.where("c > 0")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (known.where(F.length("word") == 0).select("c").first() or [0])[0]

    pieces = Pieces.from_vocabulary(scored)
    for _ in range(ROUNDS if distinct > bool(ends) else 0):
        pieces = _fitted(pieces, known.where(F.length("word") > 0))
    types = distinct - bool(ends)
    mass = total if types else total + 1.0  # what no word was seen for is half end, half spelling
    spelled = math.log((DISCOUNT * types if types else 0.5) / mass)
    end = math.log10((ends if types else ends + 0.5) / mass)
    shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            words = utf8(batch.column(0))
            c = batch.column(1).to_numpy().astype(float)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - DISCOUNT, 0.0) / mass)
            model = np.logaddexp(whole, spelled + lattice.words(words)) / math.log(10)
            model[np.fromiter((w == END for w in words), bool, len(words))] = end
            base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
            columns = [batch.column(0), pa.array(c > 0), pa.array(base), pa.array(model)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "known", "base", "model"])

    values = counts.mapInArrow(score_words, "word binary, known boolean, base double, model double")
    back = pairs.select("block", "word").join(values, "word")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score_block(texts: pa.Table, found: pa.Table) -> pa.Table:
        place = {w: k for k, w in enumerate(found.column("word").to_pylist())}
        known_, base_, model_ = (found.column(c).to_numpy().astype(float) for c in ("known", "base", "model"))
        sums = np.zeros((4, texts.num_rows))
        for k, text in enumerate(t for chunk in texts.column("text").chunks for t in utf8(chunk)):
            words = spaced_words(text)
            words.append(END)
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            sums[:, k] = len(at), known_[at].sum(), base_[at].sum(), model_[at].sum()
        n = [pa.array(s.astype(np.int64)) for s in sums[:2]]
        fixed = pa.array(np.full(texts.num_rows, total, np.int64))
        return pa.Table.from_arrays([texts.column("doc_id"), texts.column("held_out"), *n, fixed, *map(pa.array, sums[2:])], names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score_block, schema)

