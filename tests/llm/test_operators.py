"""Each operator against a brute-force version, and on nulls, empty and very long texts, repeats and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from veilspark.llm import decontaminate, imatch, language, lattice, license_scan, mixing, page_text, simhash, token_files, toxicity
from veilspark.llm.queries import PIECES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, size string"
TEXTS = [
    None,
    "",
    " \t ",
    "Uno",
    "the cat sat on the mat by the door of the old house",
    "The Cat sat on the mat by the door of the old house",
    "the cat sat on the mat by the door of the old house today",
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "tab\tand  double spaces\n\nand é ü 日本",
    "long " * 20_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", None, "b"][i % 3], len(t or ""), "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", None, "a", 10, "x", 1, "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path = public_tokenizers.path(TOKENIZER)
    model = Tokenizer.from_file(path)
    token_files.write_tokens(docs, f"{tmp_path}/a", path, 2, parts=3)
    rows = token_files.read_tokens(spark, f"{tmp_path}/a").orderBy("start").collect()
    start = 0
    for r in rows:
        text = "no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert list(r["ids"]) == [*model.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        start += len(r["ids"])
    assert [r["doc_id"] for r in rows] == [None, *sorted([*range(len(TEXTS)), 4])]
    sums = token_files.with_crc32(token_files.read_tokens(spark, f"{tmp_path}/a")).orderBy("start").collect()
    assert [r["ids_crc32"] for r in sums] == [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows]
    assert token_files.read_documents(spark, f"{tmp_path}/a", 3, 5).count() == 4
    token_files.write_tokens(empty, f"{tmp_path}/b", path, 2, parts=2)
    assert token_files.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_metadata_reads_leave_the_ids(spark, docs, tmp_path):
    token_files.write_tokens(docs, f"{tmp_path}/a", public_tokenizers.path(TOKENIZER), 2, parts=2)
    plan = token_files.read_tokens(spark, f"{tmp_path}/a").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.findall(r"ReadSchema: (.*)", plan)[0]


def spellings(word, pieces):
    """Probability of a word summed over its segmentations, by listing them."""
    p = np.exp(pieces.weights)
    start = {n: p[k] for k, n in enumerate(pieces.names[: pieces.n_start])}
    other = {n: p[pieces.n_start + k] for k, n in enumerate(pieces.names[pieces.n_start : -1])}

    def rest(tail):
        return (p[-1] if not tail else 0) + sum(other[tail[:n]] * rest(tail[n:]) for n in range(1, len(tail) + 1) if tail[:n] in other)

    return sum(start[word[:n]] * rest(word[n:]) for n in range(len(word) + 1) if word[:n] in start)


def test_lattice_sums_all_spellings_and_expected_counts():
    pieces = lattice.Pieces.from_vocabulary([("▁a", 0), ("▁ab", 1), ("b", 2), ("bc", 3), ("c", 4)])
    own = lattice.Lattice(pieces)
    words = [b"abc", b"a", b"zq", "é".encode(), b"abcbc"]
    expected = np.zeros(len(pieces.names))
    assert np.allclose(np.exp(own.words(words, expected)), [spellings(w, pieces) for w in words])
    assert math.isclose(expected[-1], len(words))
    assert np.isclose(np.exp(pieces.weights[: pieces.n_start]).sum(), 1)


def test_lattice_scores(docs, empty):
    held_out = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 == 0
    vocabulary = lattice.vocabulary(public_tokenizers.path(PIECES))
    rows = lattice.score_documents(docs, held_out, vocabulary).collect()
    train = Counter()
    texts = [*((i, t) for i, t in enumerate(TEXTS)), (4, TEXTS[4]), (None, "no id here")]
    for i, t in texts:
        if (i or 0) % 10:
            train.update([*spaced(t), ""])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in texts:
        words = [*spaced(t), ""]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[(i, len(words), sum(train[w] > 0 for w in words), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lattice.score_documents(empty, held_out, vocabulary).count() == 0


def test_license_scan(spark, docs, empty):
    found = by_id(license_scan.scan_licenses(docs))
    assert found[7]["labels"] == "mit" and (found[7]["n_base"], found[7]["first_word"], found[7]["last_word"]) == (1, 3, 3)
    assert found[8]["labels"] == "gpl" and found[8]["first_word"] == 7
    assert (found[0]["n_words"], found[0]["first_word"], found[0]["labels"], found[0]["score"]) == (0, None, "", 0.0)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_filters_lose_no_match():
    counts = Counter(w for _, t in license_scan.NOTICES for w in license_scan.plain_words(t.encode()))
    index = license_scan.NoticeIndex(license_scan.NOTICES, counts, 0.8)
    rng = np.random.default_rng(1)
    words = sorted(counts)
    for _ in range(300):
        block = set(rng.choice(words, size=rng.integers(1, 60)).tolist())
        want = sorted((label, len(block & set(ws)) / len(ws)) for label, ws, _ in index.notices if len(block & set(ws)) >= 0.8 * len(ws) - 1e-9)
        assert sorted((label, c) for label, c, _ in index.matches(block)) == want


def test_mixing(spark, docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs, mixing.word_count(F.col("text"))).select("doc.source", "doc_size", "source_size", "target", "taken").collect()]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["doc_size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weight[s] * share
            left -= target[s]
        open_ -= full or open_
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert math.isclose(own[0]["target"], target[s])
        assert sum(r["taken"] for r in own) == math.floor(target[s] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["doc_size"] for r in own)
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)


def brute_fingerprint(text):
    words = [w.encode() for w in spaced(text)]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    texts = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id here")]
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    group = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), g in zip(prints, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{p:016x}", least.get(g)) for (i, p), g in zip(prints, group, strict=True))
    assert Counter(tuple(r) for r in rows) == want
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0


def test_near_links_connect_what_is_near(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    chains = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in seeds for k in (0, 1, 1, 2, 3)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in chains})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), tile_size=2)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    number = {v: k for k, v in enumerate(values)}
    group = list(range(len(values)))
    for _ in range(6):
        for v in values:
            for w in values:
                if ((v ^ w) & (1 << 64) - 1).bit_count() <= 2:
                    low = min(group[number[v]], group[number[w]])
                    group[number[v]] = group[number[w]] = low
    assert {v: root.get(v, v) for v in values} == {v: values[group[number[v]]] for v in values}


@pytest.mark.parametrize("slice_windows", [1_000_000, 3])
def test_decontamination(spark, docs, empty, slice_windows):
    items = [(7, "Sat on the mat, by the door; of the old house"), (8, "no id"), (9, None), (None, "uno"), (11, "dos uno")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.scanned(docs, bench, slice_windows=slice_windows).select("doc.doc_id", "n_words", "n_hit", "items_sha256").collect()

    def plain(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))

    grams = {}
    for item, text in items:
        words = plain(text)
        if item is not None and words:
            for k in range(max(1, len(words) - 9)):
                grams.setdefault(tuple(words[k : k + 10]), set()).add(str(item))
    want = Counter()
    for i, text in [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id here")]:
        words, hit, names = plain(text), set(), set()
        for gram, ids in grams.items():
            for k in range(len(words) - len(gram) + 1):
                if tuple(words[k : k + len(gram)]) == gram:
                    hit.update(range(k, k + len(gram)))
                    names |= ids
        want[(i, len(words), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert decontaminate.clean_documents(docs, bench, slice_windows=slice_windows).columns == docs.columns
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.clean_documents(empty, bench).count() == 0


PAGE = """<html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Title &amp;  more</h1><p><b>One<br>two</p><aside>Side</aside><div class="comments">Nice</div><p>Same text on all pages here</p></article><footer>&copy; x</footer>"""


def test_page_text(spark):
    loose = "<body><p>Welcome to our site all of you</p><p>Text number {} is this page alone {}</p></body>"
    rows = [(1, "http://a.x/1", PAGE), (2, "http://a.x/2", PAGE), (3, "http://b.x/1", loose.format(1, 7)), (4, "http://b.x/2", loose.format(2, 8)), (5, None, None), (6, "http://b.x/3", "plain words")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in page_text.extract(pages).collect()}
    assert found[1]["text"] == found[2]["text"] == "Title & more\n\nOne two\n\nSame text on all pages here"
    assert found[3]["text"] == "Text number 1 is this page alone 7" and found[3]["n_boilerplate"] == 1
    assert (found[5]["text"], found[5]["n_chars"]) == ("", 0)
    assert found[6]["text"] == "plain words"
    assert page_text.extract(pages.limit(0)).count() == 0


def test_repeated_runs_against_all_windows():
    rng = np.random.default_rng(5)
    streams = [[str(t) for t in rng.integers(0, 3, rng.integers(0, 30))] for _ in range(12)]
    streams.append(streams[0])
    for stream, got in zip(streams, page_text.repeated_runs(streams), strict=True):
        want = np.zeros(len(stream), bool)
        for k in range(len(stream) - 3):
            run = stream[k : k + 4]
            if any(o != stream and run in [o[j : j + 4] for j in range(len(o) - 3)] for o in streams):
                want[k : k + 4] = True
        assert (want == got).all()


def test_maximal_segments_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(100):
        scores = np.where(rng.random(25) < 0.4, rng.integers(1, 5, 25), -1.0)
        places = np.flatnonzero(scores > 0).tolist()
        got = toxicity.maximal_segments(places, scores[scores > 0].tolist(), -1.0)
        left, want = [(0, 25)], []
        while left:  # the best segment first, then the same on both sides
            a, b = left.pop()
            best = max(((scores[i:j].sum(), j - i, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                shortest = min((n, -i) for s, n, i in ((scores[i:j].sum(), j - i, -i) for i in range(a, b) for j in range(i + 1, b + 1)) if s == best[0])
                i, n = shortest[1], shortest[0]
                want.append((i, i + n, best[0]))
                left += [(a, i), (i + n, b)]
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))


def test_toxicity(spark, empty):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        text = rng.choice(words, 60).tolist()
        if i % 5 == 0:
            for k in rng.choice(60, 3, replace=False):
                text[k] = str(rng.choice(["nasty", "vile", "foul"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 4] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = by_id(toxicity.score_texts(docs, model, "doc_id"))
    wrong = [i for i, _, x in rows if found[i]["predicted"] != x]
    assert len(wrong) <= 8
    assert found[None]["predicted"] == found[1000]["predicted"] == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    none = toxicity.fit(empty, labels)
    assert all(r["score"] < 0.01 for r in toxicity.score_texts(docs, none, "doc_id").collect())


def test_imatch(spark, docs, empty):
    found = imatch.fingerprint_documents(docs).collect()
    rows = {r["doc_id"]: r for r in found}
    texts = [*sorted([(i, t or "") for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]], reverse=True), (None, "no id here")]
    want = Counter()
    for (i, t), (_, after) in zip(texts, [*texts[1:], texts[0]], strict=True):
        half = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == rows[2]["fingerprint"]
    assert rows[1]["near_next"] == 1.0 and rows[4]["fingerprint"] == rows[5]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows.values())
    assert imatch.fingerprint_documents(empty).count() == 0


def test_imatch_runs_no_python(docs):
    plan = imatch.fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark, docs, empty):
    samples = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune fuchs und der hund", "fr": "le renard brun et le chien paresseux", "es": "el zorro rápido y el perro perezoso", "it": "la volpe veloce e il cane pigro"}
    train = spark.createDataFrame([(k, v) for k, v in samples.items()] * 3 + [(None, "x")], "lang string, text string")
    model = language.fit(train)
    rows = spark.createDataFrame([(k, v) for k, v in samples.items()] + [("und", None), ("und", "12 34"), ("und", "")], "want string, text string")
    assert all(r["want"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in language.predict(rows, model, "want").collect())
    nothing = language.fit(empty.select("lang", "text"))
    assert {r["lang_pred"] for r in language.predict(docs.select("doc_id", "text"), nothing, "doc_id").collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 20])
def test_codewords_differ(n):
    code = language.codebook(n)
    assert len({tuple(row) for row in code}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_scored_words_are_found_as_sets(monkeypatch):
    """Every word's score as defined, word by word, and each distinct word of a text taken apart once."""
    scores = {"bad ": 2.0, "awf": 1.5, "awful": 3.0, "awfully ": 0.0}
    words = [w.encode() for w in ("bad", "badge", "awful", "awfully", "awfulness", "aw", "é", "good")] * 50
    calls = []
    own = toxicity._Cache(scores)
    score = own._score
    monkeypatch.setattr(own, "_score", lambda word: calls.append(word) or score(word))

    def plain(word):
        whole, *beginnings = toxicity.tokens_of(word)
        return scores.get(whole, max((scores[t] for t in beginnings if t in scores), default=0.0))

    want = {w: plain(w) for w in words if plain(w)}
    assert own.scored(words) == own.scored(words) == want and len(calls) == 8
    places = [k for k, w in enumerate(words) if w in want]
    model = toxicity.Model(scores, 1.0, ())
    assert model.segments(words, own) == toxicity.maximal_segments(places, [want[words[k]] for k in places], toxicity.DRIFT)
    assert model.segments([b"good"], own) == [] == model.segments([], own)


@pytest.mark.parametrize("size", [1, 2000, 8000])
def test_page_groups_change_no_text(spark, monkeypatch, size):
    """What two pages of a host share is found whatever the groups of the host, and copies of a page share nothing."""
    rows = []
    for k in range(40):
        promo = f"<div>Offer {k // 2} of the month ends on day {k // 2}</div>"
        own = " ".join(f"word{k}x{n}" for n in range(30))
        rows.append((k, "http://a.example/x", f"<body><div>Home News Sport Weather Contact</div>{promo}<div>{own}</div></body>"))
    rows += [(40, "http://a.example/x", rows[7][2]), (41, None, rows[0][2]), (42, "http://a.example/x", None)]
    rows += [(50 + k, "http://b.example/x", "<body><div>only copies of this page are there</div></body>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, page_text.extract(pages).collect()))
    monkeypatch.setattr(page_text, "GROUP_BYTES", size)
    assert sorted(map(tuple, page_text.extract(pages).collect())) == whole
    text = {r[0]: r[2] for r in whole}
    assert all(text[k] == " ".join(f"word{k}x{n}" for n in range(30)) for k in range(40))
    assert text[41].startswith("Home") and text[50] == "only copies of this page are there"
