"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut per source.

Every source gets a budget of words. Within a source, documents are ordered by a hash of their id,
dealt into ranges of that hash and sorted there; sums per range, then within a range, give each
document the number of words before it. The budget holds whole epochs of the source and a rest, and
the rest ends at an exact word: one document of a source may be taken in part.

Null sources are one source, ranked last. Null ids hash as empty text; equal ids are ordered by size and
by a hash of the text, so that reruns agree. Empty texts have size 0 and take nothing. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import packed

#: Rows that one range of the hash holds on average: the unit of sorting.
ROWS_PER_RANGE = 5_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, rank, n_rows, source_size, target) from `(source, source_size, n_rows)`, one row per source.

    A target is weight times a common level, at most `most` times the source. Taking sources by the
    level at which they are full, the level that the others reach with what is left rises up to
    the last full source and falls after it, so the common level is the largest of them.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_source) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    full = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumns({"weight": weight, "full": full, "all": F.sum("source_size").over(everything)})
    by_full = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("full").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("all") * F.lit(float(share)) - before) / left
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("full"), F.col("weight") * F.col("level"))
    return levelled.select("source", "rank", "n_rows", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    tie: Column | None = None,
) -> DataFrame:
    """(doc struct, doc_size, source_size, target, taken) of every row of `docs` (doc_id, source, ...)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = packed(docs, source="source", doc_size=size, key=key, tie=tie if tie is not None else F.lit(0))
    sizes = rows.groupBy("source").agg(F.sum("doc_size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes, weights, share, most)
    ranges = F.ceil(F.col("n_rows") / ROWS_PER_RANGE)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    same = rows["source"].eqNullSafe(targets["source"])
    placed = rows.join(targets, same).select(
        "doc", "doc_size", "key", "tie", "rank", "source_size", "target",
        F.floor(place * ranges).alias("range"),
    )
    budget = F.floor(F.col("target") + 0.5)
    totals = placed.groupBy("rank", "range").agg(F.sum("doc_size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rank", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("doc_size"), rest - F.col("ahead")))
    return (
        placed.withColumn("inner", F.coalesce(F.sum("doc_size").over(within), F.lit(0)))
        .join(offsets, ["rank", "range"])
        .withColumns({"ahead": F.col("offset") + F.col("inner"), "budget": budget})
        .withColumn("epochs", epochs)
        .select("doc", "doc_size", "source_size", "target", (F.col("epochs") * F.col("doc_size") + cut).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document once per epoch that takes it.

    Where the budget ends inside a document, that copy keeps the words up to the cut, joined by single
    spaces; `n_chars`, if there is such a column, is set anew for it.
    """
    size = word_count(F.col("text"))
    taken = mix(docs, size, tie=F.xxhash64("text"), **options).where(F.col("taken") > 0)
    whole = F.floor(F.col("taken") / F.col("doc_size")).cast("int")
    rest = (F.col("taken") % F.col("doc_size")).cast("int")
    copies = F.filter(F.concat(F.array_repeat(F.lit(-1), whole), F.array(rest)), lambda words: words != 0)
    out = taken.withColumn("words", F.explode(copies))
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    head = F.array_join(F.slice(words, 1, F.greatest("words", F.lit(0))), " ")
    text = F.when(F.col("words") < 0, F.col("doc.text")).otherwise(head)
    out = out.select("doc", "words", text.alias("head"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("head").alias(name)
        if name == "n_chars":
            return F.when(F.col("words") < 0, F.col("doc.n_chars")).otherwise(F.length("head").cast(docs.schema[name].dataType)).alias(name)
        return F.col(f"doc.`{name}`").alias(name)

    return out.select(*map(column, docs.columns))
