"""Ranked search against scoring every document, with shards and blocks of several sizes."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import ranked_search
from veilspark.llm.queries import table

SCHEMA = "doc_id long, text string, terms string, n int, score string"
TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    of_item = defaultdict(set)
    for item_id, text in items:
        of_item[item_id] |= set(terms(text))
    out = []
    for item_id, query in of_item.items():
        scored = []
        for doc_id, c in docs:
            m = 50 + 50 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in query & c.keys())
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=50, **options):
    docs = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    items = spark.createDataFrame([(*i, "rank") for i in items], "item_id long, text string, rank string")
    result = ranked_search.ranked(docs, items, k, **options)
    assert [f"{n} {t}" for n, t in result.dtypes] == ["item_id bigint", "rank int", "doc_id bigint", "score bigint"]
    return sorted(map(tuple, result.collect()), key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)] + ["Ünï", "日本", "X9"])
    zipf = 1 / np.arange(1, len(words) + 1)
    topics = [rng.permutation(zipf) / zipf.sum() for _ in range(6)]
    docs = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=topics[i % 6])) + "." * (i % 3)) for i in range(n)]
    return docs + [(int(n + i), docs[5][1]) for i in range(80)]  # copies: ties


ODD = [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 W2-w3"), (9001, None), (9002, ""), (9003, " \t.,"), (9004, "w3 " * 50_000 + "w390")]


@pytest.mark.parametrize(("shard_postings", "block"), [(200, 16), (3_000, 20), (400_000, 64), (400_000, 256)])
def test_equals_scoring_all(spark, shard_postings, block):
    docs = corpus(1, 700) + ODD
    items = [(i, docs[i * 31][1]) for i in range(20)] + [(100, "w1 w2 w2 W3"), (101, "unheard of"), (102, None), (3, "w8 x9"), (None, "日本"), (None, "w390")]
    assert found(spark, docs, items, 10, shard_postings=shard_postings, block=block) == brute(docs, items, 10)


def test_items_in_several_passes(spark):
    docs, items = corpus(2, 200), [(i, f"w{i} w{i + 1} w{3 * i}") for i in range(12)]
    assert found(spark, docs, items, 7, block_terms=8) == brute(docs, items, 7)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "w1")]) == [] and found(spark, [(1, "w1")], []) == [] and found(spark, ODD[3:6], [(1, "w1")]) == []


def test_terms_that_all_documents_hold(spark):
    docs = [(i, "common " + "rare " * (i % 7 == 0)) for i in range(600)]
    assert found(spark, docs, [(1, "common"), (2, "rare common")]) == brute(docs, [(1, "common"), (2, "rare common")], 50)


def test_given_tables_and_skipping(spark):
    """All documents and items of the smallest tables; and blocks are skipped, without which the bounds would be idle."""
    sf = "/root/testdata/sf0.001"
    docs, items = (table(spark, sf, t) for t in ("documents", "benchmark"))
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert sorted(map(tuple, ranked_search.ranked(docs, items).collect()), key=repr) == expected

    rng = np.random.default_rng(4)
    size, n = 300, 3_000
    topic = rng.integers(0, 40, n)
    lists = [np.unique(np.concatenate((rng.integers(t * 7, t * 7 + 7, 5), rng.integers(280, 300, 3)))) for t in topic]
    starts = np.concatenate(([0], np.cumsum(list(map(len, lists)))))
    weights = np.concatenate((np.full(280, 4_000), np.full(20, 500)))
    factors = rng.integers(300_000, 600_000, starts[-1])
    shard = ranked_search.build_shard(np.arange(n), starts, np.concatenate(lists), factors, weights, 64)
    query = np.array([14, 15, 16, 17, *range(285, 295)])
    best = ranked_search._Best(20)
    blocks, scored = ranked_search.search_shard(shard, query, weights, best)
    exact = np.array([sum(weights[t] * f for t, f in zip(lists[d], factors[starts[d] : starts[d + 1]], strict=True) if t in query) for d in range(n)])
    order = np.lexsort((np.arange(n), -exact))[:20]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == exact[order].tolist()
    assert scored < blocks / 2
