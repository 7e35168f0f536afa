"""Samples and key pages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.numbering import number_rows
from veilspark.operators.tokenize import mock_tokens
from veilspark.sources.store import RunStore
from veilspark.spec import DEFAULT_BATCH_SIZE, PiiSpec

# Up to here ORDER BY + LIMIT/OFFSET is one top-n; a page further in is taken by row number.
TOP_N = 100_000


def table_sample(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def row_dicts(df: DataFrame, max_rows: int = 100) -> list[dict[str, Any]]:
    """Rows as dicts; the cap is applied by Spark, not after fetching everything."""
    return [r.asDict() for r in df.limit(max_rows).collect()]


def key_page(df: DataFrame, key: str, offset: int, size: int, store: RunStore | None = None) -> DataFrame:
    """The keys at positions offset+1..offset+size in key order."""
    keys = df.select(key)
    if offset + size <= TOP_N:
        return keys.orderBy(key).offset(offset).limit(size)
    store = store or RunStore(df.sparkSession)
    numbered = number_rows(keys, [key], store, "key_page")
    return numbered.filter(F.col("rn").between(offset + 1, offset + size)).select(key)


def write_page_index(df: DataFrame, key: str, table: str, rows_per_file: int = 1_000_000) -> None:
    """Write `df` in key order to `table`, a file for each range of keys, and the place of each range to `<table>__ranges`.

    The ranges are found by sampling keys, so files hold about, not exactly, `rows_per_file` rows; other columns break ties, so that one
    repeated key fills no file. Built once, it serves pages at any offset.
    """
    parts = max(1, -(-df.count() // rows_per_file))
    ties = [c for c in df.columns if c != key]
    placed = df.repartitionByRange(parts, key, *ties).sortWithinPartitions(key, *ties)
    placed.withColumn("__range", F.spark_partition_id()).write.format("parquet").partitionBy("__range").saveAsTable(table)
    ranges = df.sparkSession.table(table).groupBy("__range").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    ranges = ranges.withColumn("start", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    ranges.coalesce(1).write.format("parquet").saveAsTable(f"{table}__ranges")


def indexed_page(spark: SparkSession, table: str, key: str, offset: int, size: int) -> DataFrame:
    """The rows at positions offset+1..offset+size in key order of a table of `write_page_index`: reads the files of these positions alone."""
    ranges = spark.table(f"{table}__ranges")
    held = ranges.filter((F.col("start") < offset + size) & (F.col("start") + F.col("n_rows") > offset)).orderBy("start").collect()
    rows = spark.table(table).filter(F.col("__range").isin([r["__range"] for r in held])).drop("__range")
    first = held[0]["start"] if held else 0
    ties = [c for c in rows.columns if c != key]
    return rows.orderBy(key, *ties).offset(offset - first).limit(size)


def mock_update_page(df: DataFrame, spec: PiiSpec, page: DataFrame, seed: int = 0) -> DataFrame:
    """The whole table, with mock tokens assigned in the rows whose key is in `page`."""
    (key,) = spec.key
    marked = page.select(key).distinct().withColumn("__hit", F.lit(True))
    joined = df.join(marked, key, "left")
    return mock_tokens(joined, spec, seed, where=F.col("__hit").isNotNull()).drop("__hit")


def paged_update(
    df: DataFrame, spec: PiiSpec, store: RunStore, page_size: int = DEFAULT_BATCH_SIZE, seed: int = 0
) -> DataFrame:
    """Every page at once: the table with mock tokens and the number of the page that set them."""
    numbered = number_rows(df, list(spec.key), store, "paged_update")
    page = F.floor((F.col("rn") - 1) / page_size).cast("bigint")
    return mock_tokens(numbered.withColumn("page_no", page).drop("rn"), spec, seed)
