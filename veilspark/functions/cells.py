"""Cell predicates and the long (one row per cell) form of a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.spec import PiiSpec

# What counts as white space when a cell is read: every space character of the basic plane.
READ_BLANKS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def text(column: str) -> Column:
    """The cell as the string that is tokenized."""
    return F.col(column).cast("string")


def tokenizable(cell: Column) -> Column:
    """Not null and not blank. Only spaces count as blank at write; NULL gives NULL."""
    return F.trim(cell) != ""


def readable(cell: Column) -> Column:
    """Not blank at read, where every white-space character counts.

    A first byte in the printable ASCII range settles it with two comparisons; only other cells
    are searched for white space.
    """
    printable = (cell >= "!") & (cell < "\x7f")
    return F.when(printable, F.lit(True)).otherwise(F.btrim(cell, F.lit(READ_BLANKS)) != "")


def has_pii(spec: PiiSpec) -> Column:
    """True if any protected cell of the row is not null."""
    return F.coalesce(*[text(c) for c in spec.columns]).isNotNull()


def needs_token(cell: Column, token: Column) -> Column:
    """True if the cell holds a value and no token was assigned yet."""
    return cell.isNotNull() & token.isNull()


def rows_with_pii(df: DataFrame, spec: PiiSpec) -> DataFrame:
    return df.filter(has_pii(spec))


def long_cells(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """`(keep..., column_name, value)`, one row per protected cell, blank ones included."""
    columns, keep = list(columns), list(keep)
    narrow = df.select(*keep, *[text(c).alias(c) for c in columns])
    return narrow.unpivot(keep, columns, "column_name", "value")


def tokenizable_cells(df: DataFrame, spec: PiiSpec, keep: Iterable[str] = ()) -> DataFrame:
    return long_cells(df, spec.columns, keep).filter(tokenizable(F.col("value")))
