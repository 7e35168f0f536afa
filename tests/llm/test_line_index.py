"""Line dedup against a brute-force version: one insert, several, deletions, and cuckoo filters on their own."""

from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import line_index
from veilspark.llm.line_index import CuckooFilter, LineIndex

SCHEMA = "doc_id long, text string, key string, n int, keys string"
SPACE = " \t\n\v\f\r"


def key_of(line):
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return key if len(key) >= 10 else None


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def brute(inserted, docs):
    """(doc_id, n_lines, n_dropped, kept) of `docs` by an index that holds `inserted`."""
    holders = defaultdict(set)
    for doc_id, text in inserted:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(order(doc_id))
    holders.pop(None, None)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(holders[key_of(x)] if key_of(x) in holders else ()) > 1 and order(doc_id) > min(holders[key_of(x)]))]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)


def kept(spark, index, docs, **options):
    found = index.kept(frame(spark, docs), **options).select("doc.doc_id", "n_lines", "n_dropped", "kept")
    return sorted(map(tuple, found.collect()), key=repr)


def documents(seed, n, start=0):
    rng = np.random.default_rng(seed)
    pool = [f"This is a common line no {i}" for i in range(15)] + ["short", "", "  THIS IS a common line no 3\t", "ünïcödé äöü", "éééééééé"]
    return [
        (int(start + i), "\n".join([pool[int(k)] for k in rng.integers(0, len(pool), 6)] + [f"own line of document {seed} {i}"] * 2))
        for i in rng.permutation(n)
    ]


ODD = [(None, "This is a common line no 1\nnobody else has this"), (None, "nobody else has this"), (3, None), (4, ""), (5, "\n\n"), (3, "a repeated id here\n"), (3, "a repeated id here\nx")]
ODD += [(9, "one very long line " * 20_000 + "\r\n" + "many lines here\n" * 5_000), (10, "ONE very long line " * 20_000)]


@pytest.mark.parametrize("filter_bytes", [0, 64 << 20])
def test_insert_equals_brute_force(spark, tmp_path, filter_bytes):
    docs = documents(1, 150, 20) + ODD
    index = LineIndex.create(spark, f"{tmp_path}/index")
    index.insert(frame(spark, docs))
    assert kept(spark, index, docs, filter_bytes=filter_bytes) == brute(docs, docs)


def test_insertions_and_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_index, "SHARD_KEYS", 300)
    first, second, third = documents(1, 120, 300) + ODD, documents(2, 150, 100), documents(3, 20, 900)
    index = LineIndex.create(spark, f"{tmp_path}/index")
    index.delete(frame(spark, first))  # nothing to delete yet
    for batch in (first, second, third):
        index.insert(frame(spark, batch))
    docs = first[:-9] + second + third
    both = first + second + third
    built = index.built
    assert kept(spark, index, docs) == brute(both, docs) and built == 2 and index.version == 3  # the small batch changed the filters in place
    gone = {d for d, _ in second[:80] + first[:30]} | {3}
    index.delete(spark.createDataFrame([(d,) for d in gone] + [(77_777,)], "doc_id long"))
    left = [d for d in both if d[0] not in gone]
    index = LineIndex(spark, f"{tmp_path}/index")
    assert kept(spark, index, docs) == brute(left, docs)
    counts = {bytes(r["key"]): r["n"] for r in index.counts().collect()}
    exact = defaultdict(set)
    for doc_id, text in left:
        for k in filter(None, line_index.line_keys((text or "").encode())):
            exact[k].add(doc_id)
    assert counts == {k: len(v) for k, v in exact.items()}
    again = [d for d in both if d[0] in gone]
    index.insert(frame(spark, again))
    assert index.built == built and kept(spark, index, docs) == brute(both, docs)
    with pytest.raises(ValueError):
        index.insert(frame(spark, again[:1]))
    for row in index.filters().collect():
        assert not CuckooFilter.load(row["present"]).find(np.array([], np.uint64)).size
    # The filters hold exactly as many fingerprints as there are keys, and keys of several documents.
    used = [sum(np.count_nonzero(np.frombuffer(r[c], np.uint16)) for r in index.filters().collect()) for c in ("present", "repeated")]
    assert used == [index.counts().count(), index.counts().where("n > 1").count()]


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    docs = documents(4, 30)
    index = LineIndex.create(spark, f"{tmp_path}/index")
    index.insert(frame(spark, docs))
    more = frame(spark, documents(5, 30, 50))
    index._write(line_index._keys_of(more), "postings", 2)  # a job died after its first write
    index = LineIndex(spark, f"{tmp_path}/index")
    assert index.version == 1 and kept(spark, index, docs) == brute(docs, docs)
    index.insert(more)
    both = docs + documents(5, 30, 50)
    assert kept(spark, index, both) == brute(both, both)


def test_a_hot_line(spark, tmp_path):
    docs = [(i, f"a line in every document\nthe line of document {i}") for i in range(6_000)]
    index = LineIndex.create(spark, f"{tmp_path}/index")
    index.insert(frame(spark, docs))
    assert index._at_keys(line_index._keys_of(frame(spark, docs)), index.counts().where("n > 1")).count() == 6_000
    assert kept(spark, index, docs) == brute(docs, docs)
    index.delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert kept(spark, index, docs[1:]) == brute(docs[1:], docs[1:])


def test_empty(spark, tmp_path):
    index = LineIndex.create(spark, f"{tmp_path}/index")
    assert kept(spark, index, ODD[:3]) == brute([], ODD[:3])
    index.insert(frame(spark, []))
    assert kept(spark, index, []) == [] and kept(spark, index, ODD[:3]) == brute([], ODD[:3])


@pytest.mark.parametrize("n", [0, 1, 50, 5_000, 200_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(rng.integers(0, 2**64, n, np.uint64))
    some, more = hashes[: n // 2], hashes[n // 2 :]
    filter_ = CuckooFilter.for_keys(n)
    assert filter_.add(some) and filter_.find(some).all()
    filter_ = CuckooFilter.load(filter_.dump())
    assert filter_.add(more) and filter_.find(hashes).all()
    assert np.count_nonzero(filter_.table) == len(hashes)
    assert filter_.find(rng.integers(0, 2**64, 10_000, np.uint64)).mean() < 0.01
    gone = some[:5_000]
    filter_.remove(gone)
    assert filter_.find(np.setdiff1d(hashes, gone)).all() and np.count_nonzero(filter_.table) == len(hashes) - len(gone)


def test_a_full_filter_says_so():
    hashes = np.random.default_rng(0).integers(0, 2**64, 500, np.uint64)
    assert not CuckooFilter(64).add(hashes)
