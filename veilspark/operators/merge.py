"""Upsert by key, for tables that have no MERGE."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.store import RunStore

PART = "__part"


def upsert(target: DataFrame, source: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`target` with `columns` set from `source` rows of the same key, and unmatched source rows added.

    Keys are unique on both sides. A matched row takes the source's cells even where they are NULL,
    columns not listed keep the target's, and an added row has NULL there.
    """
    on, columns = list(on), list(columns)
    incoming = source.select(
        *on, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__matched")
    )
    joined = target.join(incoming, on, "full")

    def pick(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        return F.when(F.col("__matched"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def _part(on: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int").alias(PART)


def write_parts(df: DataFrame, table: str, on: Sequence[str], parts: int) -> None:
    """Write `df` as a table that `merge_parts` can change: in `parts` partitions by a hash of its key."""
    df.withColumn(PART, _part(on, parts)).repartition(PART).write.format("parquet").partitionBy(PART).saveAsTable(table)


@contextmanager
def _replacing_partitions(spark: SparkSession) -> Iterator[None]:
    """Within, an overwrite replaces the partitions it has rows for and leaves the others."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merge_parts(table: str, source: DataFrame, on: Sequence[str], columns: Sequence[str], parts: int) -> list[int]:
    """`upsert` into a table of `write_parts`, rewriting only the parts that hold a key of `source`; returns their numbers.

    Files of all other parts stay as they are and are not read. The new content of the touched parts is written next to
    the table first; then these parts are replaced. Run again after a failure between the two, it gives the same table.
    """
    spark = source.sparkSession
    incoming = source.withColumn(PART, _part(on, parts))
    with RunStore(spark) as store:
        staged = store.write(incoming, "incoming")
        touched = sorted(r[0] for r in staged.select(PART).distinct().collect())  # at most `parts` numbers
        if not touched:
            return []
        target = spark.table(table).filter(F.col(PART).isin(touched))
        merged = upsert(target, staged, [*on, PART], columns)
        merged = store.write(merged.repartition(PART), "merged")
        with _replacing_partitions(spark):
            merged.write.mode("overwrite").insertInto(table)
    return touched
