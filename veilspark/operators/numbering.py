"""Global row numbers and per-column batch numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.cells import text, tokenizable
from veilspark.sources.store import RunStore
from veilspark.spec import DEFAULT_BATCH_SIZE, PiiSpec

# monotonically_increasing_id: partition number above bit 33, position in the partition below.
_POSITION_BITS = 33
# Rows per window group of a running count: 2^20.
_CHUNK_BITS = 20


def _part(pos: str) -> Column:
    return F.shiftright(pos, _POSITION_BITS)


def sorted_positions(df: DataFrame, keys: Sequence[str], store: RunStore, name: str) -> DataFrame:
    """`df` written in key order with `__pos`, whose order is the global sort order.

    The sort is a range exchange plus local sorts. Columns outside `keys` break ties, so equal keys
    neither make the order ambiguous nor force one range. Writing pins the partition numbers: a lost
    executor cannot renumber rows that were already counted.
    """
    ties = [c for c in df.columns if c not in keys]
    placed = df.orderBy(*keys, *ties).withColumn("__pos", F.monotonically_increasing_id())
    return store.write(placed, name)


def _offsets(counts: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of `columns`. Only for tables with one row per sorted partition."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        F.col(order), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}__before") for c in columns]
    )


def _position() -> Column:
    """The row's place in its partition, from 0."""
    return F.col("__pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def number_rows(
    df: DataFrame, keys: Sequence[str], store: RunStore, name: str = "numbered", rn: str = "rn"
) -> DataFrame:
    """Row numbers 1..n over `keys`, as ROW_NUMBER() OVER (ORDER BY keys) gives them.

    The offsets have one row per sorted partition (at most spark.sql.shuffle.partitions), which is
    what bounds the broadcast and the one unpartitioned window.
    """
    placed = sorted_positions(df, keys, store, name)
    counts = placed.groupBy(_part("__pos").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = F.broadcast(_offsets(counts, "__part", ["__n"]))
    joined = placed.join(offsets, _part("__pos") == F.col("__part"))
    return joined.select((F.col("__n__before") + _position() + 1).cast("bigint").alias(rn), *df.columns)


def batch_plan(
    df: DataFrame,
    spec: PiiSpec,
    keys: Sequence[str],
    store: RunStore,
    batch_size: int = DEFAULT_BATCH_SIZE,
    name: str = "batch_plan",
) -> DataFrame:
    """`(column_name, rn, value, batch_no)`: consecutive slices of the non-blank cells of a column.

    `keys` should identify a row, so that `rn` is the number `number_rows` gives it.
    Per column, a cell's sequence number is the count in earlier partitions, plus that in earlier
    chunks of its partition, plus the running count in its chunk. A chunk has at most 2^20 rows, so
    no window group grows with the table or with a hot value.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    columns = list(spec.columns)
    flags = [f"__f{i}" for i in range(len(columns))]
    placed = sorted_positions(df.select(*keys, *[c for c in columns if c not in keys]), keys, store, name)
    filled = {f: F.coalesce(tokenizable(text(c)), F.lit(False)).cast("bigint") for f, c in zip(flags, columns)}
    marked = placed.select(
        "__pos",
        F.shiftright("__pos", _CHUNK_BITS).alias("__chunk"),
        *[text(c).alias(c) for c in columns],
        *[flag.alias(f) for f, flag in filled.items()],
    )
    in_chunk = Window.partitionBy("__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.withColumns({f"{f}__run": F.sum(f).over(in_chunk) for f in flags})

    # One row per chunk, read twice below: per partition, and along the chunks of a partition.
    per_chunk = marked.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f).alias(f) for f in flags])
    per_chunk = per_chunk.withColumn("__part", F.shiftright("__chunk", _POSITION_BITS - _CHUNK_BITS))
    per_chunk = store.write(per_chunk, f"{name}__chunks")
    per_part = per_chunk.groupBy("__part").agg(*[F.sum(c).alias(c) for c in ("__n", *flags)])
    part_before = F.broadcast(_offsets(per_part, "__part", ["__n", *flags]))
    in_part = Window.partitionBy("__part").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_before = per_chunk.withColumns({f"{f}__chunk": F.coalesce(F.sum(f).over(in_part), F.lit(0)) for f in flags})
    offsets = chunk_before.join(part_before, "__part").select(
        "__chunk",
        "__n__before",
        *[(F.col(f"{f}__chunk") + F.col(f"{f}__before")).alias(f"{f}__off") for f in flags],
    )

    cells = [
        F.struct(
            F.col(c).alias("value"),
            F.col(f).alias("take"),
            F.floor((F.col(f"{f}__run") + F.col(f"{f}__off") - 1) / batch_size).cast("bigint").alias("batch_no"),
        ).alias(c)
        for f, c in zip(flags, columns)
    ]
    rn = (F.col("__n__before") + _position() + 1).cast("bigint")
    wide = running.join(offsets, "__chunk").select(rn.alias("rn"), *cells)
    long = wide.unpivot(["rn"], columns, "column_name", "cell")
    return long.filter(F.col("cell.take") == 1).select("column_name", "rn", "cell.value", "cell.batch_no")
