"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import near_text

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Of rows (doc_id, text), the smallest id of each group of texts with a similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values())


@pytest.mark.parametrize(("repeated", "piece"), [(10, 500), (3, 500), (10, 2)])
def test_stage_against_all_pairs(spark, monkeypatch, repeated, piece):
    monkeypatch.setattr(near_text, "REPEATED", repeated)
    monkeypatch.setattr(near_text, "PIECE", piece)
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(500)]
    rows, passage = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")], " ".join(rng.choice(words, 12))
    for base in range(12):  # chains of copies, each some words away from the one before
        text = rng.choice(words, 60 + 20 * base)
        for _ in range(8):
            rows.append((len(rows), " ".join(text) + (f" {passage}" if base % 3 == 0 else "")))
            text = text.copy()
            for k in rng.choice(len(text), rng.integers(1, 4), replace=False):
                text[k] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert 20 < len(want) < 90 and kept.columns == docs.columns


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_long_texts_and_other_columns(spark):
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    rows = [(1, long, "a", 1), (2, f"{long} and a few words more", "b", 2), (3, "short text", "c", 3), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, size int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(tuple(r)[0] for r in kept.collect()) == [1, 3, 4]


def test_ids_that_are_null_or_repeated(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "other")], "doc_id long, text string")
    rows = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(5, "a b c d e f"), (None, "other")], key=repr)


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Near copies that SimHash finds are linked by it: with no other candidates they still form a group."""
    rng = np.random.default_rng(5)
    text = [str(w) for w in rng.choice([f"w{k}" for k in range(3000)], 900)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "tail"])), (3, " ".join(rng.permutation(text)))]
    monkeypatch.setattr(near_text, "_repeated_entries", lambda signed: spark.createDataFrame([], "h long, node long, size long, at long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1, 3]


def test_marks_bound_the_difference():
    rng = np.random.default_rng(6)

    def bits(a, b):
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        return int(np.bitwise_count(a ^ b).sum())

    for n in (0, 1, 5, 256, 257, 1000, 1024, 1025, 3000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        near = np.union1d(a[n // 10 :], b[: n // 20])
        large, small = sorted((near_text._marks(a), near_text._marks(near)), key=len, reverse=True)
        assert bits(large, small) <= len(np.setxor1d(a, near))
        if n >= 1000:  # unlike texts of any length go before their shingles are fetched
            assert bits(near_text._marks(a), near_text._marks(b)) * 9 > 2 * n
