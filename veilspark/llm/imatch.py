"""I-Match document fingerprints, in DataFrame operations only.

A text's terms are its distinct words within a band of document frequency: at least `RARE` and at most
`FREQUENT` of all documents. Each of `LEXICONS` randomised lexicon subsets keeps a hashed share of all terms, from a
16th down to a 1024th; the sorted terms of a text that are in a subset are hashed to four hex
digits, and the fingerprint is these digits in order, `----` where the subset holds none of the
terms. A text with words but no term in any subset has the digits of its folded text in every place. The
likeness of two fingerprints is the share of equal digits among the subsets that hold a term of
either text; small subsets survive an edit that large ones notice, so it falls with the size of an edit.

Words of the band number at most (mean distinct words of a document) / RARE, however many documents there
are, because each takes up that share of them. The lexicon is counted, and the broadcast is asked for
only up to `MAX_BROADCAST_TERMS`; Spark joins a larger one as it sees fit.

Neighbours are found in ranges of ids, cut at quantiles; a range reads the last document of the range before it
from a table of one row a range. An id that fills several ranges is spread over them by text hash. Null ids
are the smallest, equal ids are ordered by text hash. Equal texts have equal fingerprints, and equal
fingerprints have likeness 1. Null texts are empty; without words all places are `----`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import staged

RARE, FREQUENT = 0.002, 0.2
#: For each subset, its share of the lexicon as one term in two to the power of so many.
SHARE_BITS = (4,) * 4 + (6,) * 20 + (8,) * 24 + (10,) * 16
LEXICONS = len(SHARE_BITS)
NONE = "----"
MAX_BROADCAST_TERMS = 1_000_000
RANGE_ROWS, MAX_RANGES = 10_000, 10_000


def terms(folded: Column) -> Column:
    """Distinct words of a folded text."""
    return F.array_remove(F.array_distinct(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")


def fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mask(term: Column) -> Column:
    """A long whose bit k says whether subset k holds the term: each subset reads bits of its own."""
    held, used, place = [], 0, 64
    for k, bits in enumerate(SHARE_BITS):
        if place + bits > 64:
            used, place = used + 1, 0
        hashed = F.shiftrightunsigned(F.xxhash64(term, F.lit(used)), place).bitwiseAND(F.lit((1 << bits) - 1))
        held.append(F.when(hashed == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        place += bits
    total = F.lit(0).cast("long")
    for k, bit in enumerate(held):
        total = total.bitwiseOR(F.shiftleft(bit, k))
    return total


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, mask) of the words within the document-frequency band of `docs` (text) that a subset holds."""
    n = docs.count()
    counted = docs.select(F.explode(terms(fold(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where(F.col("df").between(max(2.0, RARE * n), max(2.0, FREQUENT * n)))
    # Masks are compared after the table is written: before, the filter would move below the counting, to every word.
    return staged(band.select("term", _mask(F.col("term")).alias("mask")), "lexicon").where("mask <> 0")


def _hex4(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.shiftrightunsigned(value, 48)), 4, "0"))


def _digits(found: Column, whole: Column) -> Column:
    """The fingerprint from sorted (term, mask) structs; `whole` is the hash of the text, null without words."""

    def subset(k: int) -> Column:
        bit = F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
        return F.xxhash64(F.filter(found, lambda t: t["mask"].bitwiseAND(bit) != 0))

    # Each subset is hashed once and then read; the hash of an empty list is xxhash64's seed, 42.
    hashes = F.array(*map(subset, range(LEXICONS)))
    empty = F.lit(42)
    digits = F.array_join(F.transform(hashes, lambda h: F.when(h == empty, F.lit(NONE)).otherwise(_hex4(h))), "")
    plain = F.repeat(F.coalesce(_hex4(whole), F.lit(NONE)), LEXICONS)
    return F.when(F.size(found) > 0, digits).otherwise(plain)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal digit groups among those that hold a term in either fingerprint; 1 if all are equal."""
    pairs = F.arrays_zip(F.regexp_extract_all(a, F.lit("(.{4})")).alias("x"), F.regexp_extract_all(b, F.lit("(.{4})")).alias("y"))
    used = F.filter(pairs, lambda p: (p["x"] != NONE) | (p["y"] != NONE))
    equal = F.filter(used, lambda p: p["x"] == p["y"])
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(equal) / F.greatest(F.size(used), F.lit(1)))


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (doc_id, h, ...) with `range`, a number that ascends with (doc_id, h)."""
    side = math.isqrt(max(1, min(-(-n // RANGE_ROWS), MAX_RANGES)) - 1) + 1
    wanted = [(i + 1) / (side * side) for i in range(side * side - 1)]
    cuts = rows.agg(F.percentile_approx("doc_id", wanted, 100 * side * side)).first()[0] if wanted else None
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    every, coarse = F.lit(cuts), F.lit(cuts[side - 1 :: side])

    def below(test) -> Column:
        """How many cuts pass `test`, found among every `side`-th cut first."""
        skip = F.size(F.filter(coarse, test)) * side
        return skip + F.size(F.filter(F.slice(every, skip + 1, side), test))

    less = below(lambda cut: cut < F.col("doc_id"))
    equal = below(lambda cut: cut <= F.col("doc_id")) - less
    # The upper half of h, moved up so that it ascends with h from 0.
    place = (F.shiftright("h", 32) + F.lit(1 << 31)) / float(1 << 32)
    return rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(less + F.floor(place * equal).cast("int")))


def _last_of_previous(last: DataFrame) -> DataFrame:
    """`last` (range, ...) shifted: every range with the row of the range before it; the first has the last's."""
    order = Window.orderBy("range")
    value = F.struct(*(c for c in last.columns if c != "range"))
    ahead = F.coalesce(F.lag(value).over(order), F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return last.select("range", ahead.alias("ahead"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of `docs` (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending order of ids.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(texts)
    if words.count() <= MAX_BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = _ranged(texts.withColumn("h", F.xxhash64("text")), texts.count())

    keys = rows.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("last"))
    edges = _last_of_previous(keys.select("range", "last.doc_id", "last.h"))
    edge_texts = texts.withColumn("h", F.xxhash64("text")).join(
        F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("ahead.doc_id")) & (F.col("h") == F.col("ahead.h"))
    )  # at most MAX_RANGES rows of two numbers are broadcast
    edge_texts = edge_texts.groupBy("range").agg(F.max("text").alias("edge"))

    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    placed = rows.withColumns({"row": F.row_number().over(order), "before": F.lag("text").over(order)}).join(edge_texts, "range")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    following = F.coalesce("before", "edge")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(following, F.lit(1), half))
    both = placed.select("range", "row", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), fold(F.col("text")).alias("own"), fold(edited).alias("edited"))
    versions = F.array(*(F.struct(F.lit(k).alias("version"), F.col(c).alias("text")) for k, c in enumerate(("own", "edited"))))
    split = both.select("range", "row", F.struct("doc_id", "n_chars", "edited_sha256").alias("doc"), F.inline(versions))
    split = split.select("range", "row", "doc", "version", F.xxhash64("text").alias("whole"), terms(F.col("text")).alias("terms"))
    single = split.select("range", "row", "version", F.when(F.size("terms") > 0, F.col("whole")).alias("whole"), "doc", F.posexplode_outer("terms").alias("place", "term"))
    # One row of a text carries what it has once; a text's other rows are small.
    head = F.coalesce("place", F.lit(0)) == 0
    single = single.select("range", "row", "version", "term", head.alias("head"), F.when(head, F.col("whole")).alias("whole"), F.when(head, F.col("doc")).alias("doc"))
    found = single.join(words, "term", "left").where("mask IS NOT NULL OR head")

    def gathered(version: int) -> tuple[Column, Column]:
        mine = F.col("version") == version
        lists = F.collect_list(F.when(mine & F.col("mask").isNotNull(), F.struct("term", "mask")))
        return F.sort_array(lists), F.max(F.when(mine, F.col("whole")))

    (own, own_whole), (other, other_whole) = gathered(0), gathered(1)
    first = F.max(F.when(F.col("version") == 0, F.col("doc"))).alias("doc")
    grouped = found.groupBy("range", "row").agg(first, own.alias("a"), own_whole.alias("aw"), other.alias("b"), other_whole.alias("bw"))
    marked = grouped.select("range", "row", "doc.*", _digits(F.col("a"), F.col("aw")).alias("fingerprint"), _digits(F.col("b"), F.col("bw")).alias("edited_fingerprint"))
    marked = staged(marked, "fingerprints", compression="zstd")

    last = marked.groupBy("range").agg(F.max_by("fingerprint", "row").alias("fp"))
    by_row = Window.partitionBy("range").orderBy("row")
    near = marked.withColumn("before", F.lag("fingerprint").over(by_row)).join(_last_of_previous(last), "range")
    near_edited = likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    near_next = likeness(F.col("fingerprint"), F.coalesce("before", "ahead.fp"))
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))
