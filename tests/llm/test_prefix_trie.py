"""The prefix trie against a brute-force version, with shards cut at every size."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string, ends string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv_id].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: tuple(turns.get(c - int(math.fmod(c, 20)), [])[: h[c]] + ts[h[c] :]) for c, ts in turns.items()}


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[c] for c in children[path])
    return sorted(
        (
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(c for c in cs if convs[c] == path))).encode()).hexdigest(),
        )
        for path, cs in members.items()
    )


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    paths = prefix_trie.with_shared_heads(prefix_trie.conversation_paths(df))
    nodes = prefix_trie.prefix_nodes(paths, **options)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, nodes.collect()))


def conversations(seed, n, hot=0.4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        if rng.random() < hot:
            texts = ["hello there", "how are you", "fine"]
        else:
            texts = [f"w{rng.integers(3)} " * int(rng.integers(4)) for _ in range(rng.integers(1, 7))]
        rows += [(c * 3 - 20, t, "user" if t % 2 else None, text) for t, text in enumerate(texts)]
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 100_000])
def test_equals_brute_force(spark, shard_turns):
    rows = conversations(1, 150)
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, None, "a", "first"), (1, 5, None, None), (1, 5, "b", "tie"), (1, 5, "b", "tie"), (None, 1, "u", "nobody's")]
    rows += [(2, 1, "u", "long " * 50_000), (22, 1, "u", "long " * 50_000), (40, 1, "", ""), (41, 1, "", ""), (41, 2, None, " \t ")]
    rows += [(60, t, "u", "same") for t in range(300)] + [(61, t, "u", "same") for t in range(299)]
    assert found(spark, rows, shard_turns=50) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 1, "u", "x") for c in (21, 22, 23, 24, 25, 26)]  # conversation 20 is absent
    nodes = found(spark, rows)
    assert nodes == brute(rows) and nodes[0][1] == 0
    some = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4]
    assert found(spark, some) == brute(some) and len(found(spark, some)) == 1


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 10)
    rows = conversations(2, 120, hot=0.8)
    assert found(spark, rows, shard_turns=40) == brute(rows)


def test_double_array_finds_what_was_added():
    rng = np.random.default_rng(3)
    trie, states, edges = prefix_trie.DoubleArray(), np.array([0]), {}
    for _ in range(5):
        pairs = sorted({(int(s), int(x)) for s in states for x in rng.integers(0, 500, int(rng.integers(1, 30)))})
        pairs = pairs[:3000]
        parents, symbols = map(np.array, zip(*pairs, strict=True))
        trie.add(parents, symbols)
        children = trie.step(parents, symbols)
        assert (children > 0).all() and len(set(children.tolist())) == len(children)
        edges |= dict(zip(pairs, children.tolist(), strict=True))
        states = children[rng.permutation(len(children))[:200]]
        states.sort()
    parents, symbols = map(np.array, zip(*edges, strict=True))
    assert trie.step(parents, symbols).tolist() == list(edges.values())
    absent = [(s, x) for s in range(0, 200) for x in range(0, 500, 7) if (s, x) not in edges]
    assert (trie.step(*map(np.array, zip(*absent, strict=True))) == -1).all()
