"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors.

Training counts in how many toxic and clean labelled texts each word and each word beginning of three to
eight letters occurs; equal texts count once. The log-odds of a token between the two classes have an
informative Dirichlet prior, the token's share of both classes together, and a variance; tokens whose
z-score passes `Z_MIN` carry their log-odds. A word scores its own log-odds if it is such a token, nothing if it
is well known and is not, and else the best of its beginnings. Every other word scores `DRIFT`, below
zero. One linear scan finds every maximal segment (no part or extension of it scores more).
Scores of chance segments follow an extreme-value law, whose scale solves sum(p * exp(scale * score)) = 1 over
clean words; it turns a segment's score into the expected number of chance segments, and segments
below `E_MAX` are the toxic passages. What a text holds of them, and how densely its words score, is
calibrated to the label by logistic regression.

The classifier is fitted on at most `SAMPLE` labelled rows (those with the smallest id hash), everything
else covers all texts. A document labelled several times is toxic if one label says so. Null texts
are empty; a text without words has no evidence, and the score of one. Rows without an id carry no
label. Without training rows, or with one class only, the score is 0 (1 if all are toxic).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import packed, plain_words, staged, unpacked, utf8

SAMPLE = 20_000
#: Tokens that a model holds at most, the most significant first: the bound of its broadcast.
MAX_TOKENS = 100_000
#: Strength of the prior, as a share of the labelled texts.
PRIOR = 1 / 30
Z_MIN = 3.0
#: A word of at least so many texts is well known.
KNOWN = 5
DRIFT = -0.25
E_MAX = 0.05
CHANCE = 0.1  # the extreme-value law's constant factor
_BEGINNINGS = range(3, 9)
_CACHED = 100_000


def tokens_of(word: bytes) -> list[str]:
    """A word, marked by a space, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [f"{text} ", *(text[:n] for n in _BEGINNINGS if n <= len(text))]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    scale: float
    logistic: tuple[float, ...]

    def segments(self, words: list[bytes], cache: _Cache) -> list[tuple[int, int, float]]:
        """(first word, end, score) of every maximal segment."""
        scored = cache.scored(words)
        if not scored:
            return []
        places = [k for k, word in enumerate(words) if word in scored]
        return maximal_segments(places, [scored[words[k]] for k in places], DRIFT)

    def expected(self, score: float, n: int) -> float:
        """Expected number of chance segments of at least `score` in a clean text of `n` words."""
        return CHANCE * n * math.exp(-self.scale * score)


class _Cache:
    """The words seen, so that each is taken apart once, and the scores of those that have one; emptied when large."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.seen: set[bytes] = set()
        self.values: dict[bytes, float] = {}

    def scored(self, words: list[bytes]) -> dict[bytes, float]:
        """The words of a text whose score is not zero; most have none, and these are found as sets."""
        own = set(words)
        if len(self.seen) >= _CACHED:
            self.seen.clear()
            self.values.clear()
        for word in own - self.seen:
            if value := self._score(word):
                self.values[word] = value
        self.seen |= own
        return {word: self.values[word] for word in own & self.values.keys()}

    def _score(self, word: bytes) -> float:
        text = word.decode("utf-8", "replace")
        value = self.scores.get(f"{text} ")
        if value is None:
            found = [self.scores[t] for n in _BEGINNINGS if n <= len(text) and (t := text[:n]) in self.scores]
            value = max(found, default=0.0)
        return value


def maximal_segments(places: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence that holds `values` at `places` and `drift` elsewhere.

    Candidates stay on a list with the running total before and after each; a new one is joined to
    the last whose total before lies lower, if the total after lies lower too, else it is kept apart.
    """
    found: list[tuple[int, int, float, float]] = []
    total, after = 0.0, 0
    for place, value in zip(places, values, strict=True):
        low = total + drift * (place - after)
        total, after = low + value, place + 1
        start, before, end = place, low, total
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= end:
                break
            start, before = found[k][0], found[k][2]
            del found[k:]
            k -= 1
        found.append((start, place + 1, before, end))
    return [(a, b, high - low) for a, b, low, high in found]


def _counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many of the texts `(text, toxic)` every token occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            counts = list(seen.values())
            columns = [pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in (1, 0))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["token", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for token in {t for word in set(plain_words(text)) for t in tokens_of(word)}:
                    seen.setdefault(token, [0, 0])[toxic] += 1
                if len(seen) >= _CACHED:
                    yield out()
        yield out()

    counted = sample.select("text", "toxic").mapInArrow(count, "token string, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, float, int]]:
    """(token, log-odds, clean count) of the significant tokens; well-known other words whose beginning is one have 0."""
    strength = PRIOR * (n_toxic + n_clean)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))

    def odds(label: str, n: int) -> Column:
        return F.log((F.col(label) + prior) / (F.lit(n + strength) - F.col(label) - prior))

    delta = odds("toxic", n_toxic) - odds("clean", n_clean)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = counts.where("toxic > 1").select("token", delta.alias("score"), z.alias("z"), "clean")
    rows = scored.where(F.col("z") >= Z_MIN).orderBy(F.desc("z"), "token").limit(MAX_TOKENS).collect()
    found = [(r["token"], r["score"], r["clean"]) for r in rows]
    beginnings = [(t,) for t, _, _ in found if not t.endswith(" ")]
    if beginnings:
        known = counts.where(F.col("token").endswith(" ") & (F.col("toxic") + F.col("clean") >= KNOWN))
        word = F.rtrim("token")
        cut = F.transform(F.sequence(F.lit(min(_BEGINNINGS)), F.lit(max(_BEGINNINGS))), lambda n: F.substring(word, F.lit(1), n))
        parts = known.select("token", F.explode(F.array_distinct(cut)).alias("beginning"))
        marked = counts.sparkSession.createDataFrame(beginnings, "beginning string")
        plain = parts.join(marked, "beginning", "left_semi").select("token").distinct().orderBy("token").limit(MAX_TOKENS).collect()
        scores = {t for t, _, _ in found}
        found += [(r["token"], 0.0, 0) for r in plain if r["token"] not in scores]
    return found


def _scale(tokens: list[tuple[str, float, int]], n_words: int) -> float:
    """The positive solution of sum(p * exp(scale * score)) = 1, with p smoothed by half an occurrence.

    A word has several tokens and scores by one, so the shares of all tokens overstate chance a little.
    """
    score = np.array([s for _, s, _ in tokens if s])
    if not len(score) or not n_words:
        return 1.0
    p = np.array([c + 0.5 for _, s, c in tokens if s]) / (n_words + 0.5 * len(score))
    rest = max(0.0, 1.0 - p.sum())
    low, high = 0.0, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        if (p * np.exp(np.minimum(middle * score, 700))).sum() + rest * math.exp(middle * DRIFT) < 1:
            low = middle
        else:
            high = middle
    return max(low, 0.01)


def _evidence(rows: DataFrame, model: Model, others: str) -> DataFrame:
    """(others, strongest, passages, weight, density): what a text holds, as calibration sees it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most MAX_TOKENS tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = _Cache(own.scores)
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for k, text in enumerate(utf8(batch.column("text"))):
                words = plain_words(text)
                found = own.segments(words, cache)
                expected = sorted(own.expected(s, len(words)) for _, _, s in found)
                toxic = [e for e in expected if e <= E_MAX]
                if expected:
                    out[0, k] = min(max(0.0, -math.log10(max(expected[0], 1e-12))), 12.0)
                out[1, k] = math.log1p(len(toxic))
                out[2, k] = math.log1p(-sum(math.log10(max(e, 1e-300)) for e in toxic))
                out[3, k] = 10 * sum(s for _, _, s in found) / (len(words) + 20)
            yield pa.RecordBatch.from_arrays([batch.column(others), *map(pa.array, out)], [others, *_EVIDENCE])

    kind = rows.schema[others].dataType.simpleString()
    return rows.select(others, "text").mapInArrow(scan, f"`{others}` {kind}, " + ", ".join(f"{c} double" for c in _EVIDENCE))


_EVIDENCE = ("strongest", "passages", "weight", "density")


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Intercept and weights by Newton's method, each step halved until the penalised likelihood does not fall."""
    if not len(y) or y.min() == y.max():
        return (60.0 if len(y) and y[0] else -60.0, *([0.0] * x.shape[1]))
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, (1 - 2 * y) * (x @ w)).sum() + ridge * (w @ w) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic 0 or 1; null is unlabelled)."""
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # two numbers a row
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = staged(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    n = sample.agg(*(F.count_if(F.col("toxic") == k).alias(f"n{k}") for k in (0, 1))).first()
    counts = staged(_counts(sample), "tokens")
    tokens = _log_odds(counts, n["n1"], n["n0"]) if n["n0"] and n["n1"] else []
    words = counts.where(F.col("token").endswith(" ")).agg(F.coalesce(F.sum("clean"), F.lit(0))).first()[0]
    model = Model({t: s for t, s, _ in tokens}, _scale(tokens, words), ())
    rows = _evidence(sample, model, "toxic").toArrow()  # at most sample_rows rows of five numbers, but for repeated ids
    x = np.column_stack([rows.column(c).to_numpy() for c in _EVIDENCE])
    return Model(model.scores, model.scale, _fit_logistic(x, rows.column("toxic").to_numpy()))


def score_texts(rows: DataFrame, model: Model, others: str) -> DataFrame:
    """(others, score, predicted, passages) of rows `(others, text)`."""
    found = _evidence(rows, model, others)
    linear = sum((F.col(c) * w for c, w in zip(_EVIDENCE, model.logistic[1:], strict=True)), F.lit(model.logistic[0]))
    score = 1 / (1 + F.exp(-linear))
    passages = F.round(F.expm1("passages")).cast("int").alias("passages")
    return found.select(others, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), passages)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, as they are."""
    return unpacked(score_texts(packed(docs, text="text"), model, "doc").where("predicted = 0"), docs.columns)
