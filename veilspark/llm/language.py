"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit, a binary n-gram classifier tells the languages with
a 1 from those with a 0: its weight for a (hashed) byte n-gram of one to four bytes is the log ratio of the n-gram's
smoothed shares in the two groups, and its margin is the mean weight over a text's n-grams. Bits count
by how reliable their classifier is on the training texts. Decoding sums, for each codeword, the weighted logistic
losses of the margins, and the codeword with the smallest loss wins; its softmax share is the score. A
text whose runner-up is nearly as close is flagged as ambiguous.

Counts come from all training texts, and what leaves a task is one row per language and n-gram bucket.
Languages are few by nature and are listed on the driver; more than `MAX_LANGUAGES` is an error. A
text that is null or has no letter is `und` with score 0; so is every text if nothing was learned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import utf8

BUCKETS = 1 << 14
MAX_LANGUAGES = 1_000
SMOOTHING = 0.5
#: A score share below this is ambiguous.
CLEAR = 0.75
#: Sharpness of the loss: a margin is a mean log ratio, mostly between -1 and 1.
SHARPNESS = 6.0

#: Letters of the ASCII range in lower case, bytes above it as they are, all else a space.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of every n-gram of one to four bytes of the words of `text`."""
    text = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams, out = x, [x]
    for n in range(2, 5):
        grams = (grams[:-1] << np.uint32(8)) | x[n - 1 :]
        hashed = (grams + np.uint32(n)) * np.uint32(2654435761)
        out.append(hashed >> np.uint32(18))
    return np.concatenate(out)


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1, the widest apart of many random ones; no two bits alike, no bit constant."""
    if n < 2:
        return np.ones((n, 1))
    bits = min(max(7, math.ceil(10 * math.log2(n))), 60)
    if n <= 4:  # all ways to split so few languages in two
        masks = range(1, 1 << (n - 1))
        return np.array([[1.0 if m >> k & 1 else -1.0 for m in masks] for k in range(n)])
    rng, best, width = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > width and (np.abs(code.sum(axis=0)) < n).all():
            best, width = code, apart.min()
    if best is None:
        raise ValueError("no codebook found")
    return best


def language_counts(train: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts of all training texts `(lang, text)`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                counts = np.bincount(ngram_buckets(text), minlength=BUCKETS)
                total[lang] = total[lang] + counts if lang in total else counts
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = train.select(F.col("lang").cast("string"), "text").mapInArrow(count, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Codewords (languages x bits), n-gram weights (buckets x bits) and bit reliabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codebook(len(languages))
        shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True) if len(languages) else counts
        weights = []
        for bit in self.code.T if len(languages) > 1 else []:
            one, zero = shares[bit > 0].mean(axis=0), shares[bit < 0].mean(axis=0)
            weights.append(np.log(one / zero))
        self.weights = np.array(weights, np.float32).T
        self.reliability = np.ones(self.code.shape[1])

    def margins(self, text: bytes) -> np.ndarray:
        buckets = ngram_buckets(text)
        if len(buckets) < 4096:
            return self.weights[buckets].mean(axis=0)
        return np.bincount(buckets, minlength=BUCKETS).astype(np.float32) @ self.weights / len(buckets)

    def decode(self, text: bytes | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        agreement = self.code * self.margins(text) * SHARPNESS
        loss = (np.logaddexp(0, -agreement) * self.reliability).sum(axis=1)
        share = np.exp(loss.min() - loss)
        score = float(1 / share.sum())
        return self.languages[int(loss.argmin())], score, score < CLEAR


def fit(train: DataFrame) -> Model:
    """A model from all rows of `train` (lang, text); rows without a language are left out."""
    train = train.where("lang IS NOT NULL")
    counted = language_counts(train).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    rows = counted.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()  # BUCKETS numbers a language
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(rows), BUCKETS))
    for k, row in enumerate(rows):
        for bucket, n in row["counts"]:
            counts[k, bucket] = n
    model = Model([r["lang"] for r in rows], counts)
    if len(rows) > 1:
        _weigh_bits(model, train)
    return model


def _weigh_bits(model: Model, train: DataFrame) -> None:
    """Set each bit's reliability: the log odds of its classifier being right on the training texts."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rank = {lang: k for k, lang in enumerate(own.languages)}
        wrong, n = np.zeros(own.code.shape[1], np.int64), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if has_letter(text):
                    wrong += own.margins(text) * own.code[rank[lang]] <= 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wrong)), pa.int32()), pa.array(wrong), pa.array([n] * len(wrong), pa.int64())], ["bit", "wrong", "n"])

    rows = train.select(F.col("lang").cast("string"), "text").mapInArrow(errors, "bit int, wrong long, n long")
    for bit, wrong, n in rows.groupBy("bit").agg(F.sum("wrong"), F.sum("n")).collect():
        rate = (wrong + 0.5) / (n + 1)
        model.reliability[bit] = max(0.1, math.log((1 - rate) / rate))


def predict(rows: DataFrame, model: Model, others: str) -> DataFrame:
    """(others, lang_pred, score, ambiguous) of rows `(others, text)`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a bit

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.decode(t) for t in utf8(batch.column("text"))]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(others), *columns], [others, "lang_pred", "score", "ambiguous"])

    kind = rows.schema[others].dataType.simpleString()
    return rows.select(others, "text").mapInArrow(decode, f"`{others}` {kind}, lang_pred string, score double, ambiguous boolean")
