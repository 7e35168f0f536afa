"""Which tokens fill a large share of a table's cells: a summary per column that merges across tables and publishes.

The summary is Spark's frequent-items sketch. A task keeps at most `tracked` tokens per column, and one row per
task and column is shuffled, so a pass over the table costs no shuffle of its cells. Summaries of several tables combine into one
of the same size. A token that holds more than about 3.5 / `tracked` of the cells is always in it, and its estimate is
off by at most that share. Estimates only choose the physical form of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import text, tokenizable
from veilspark.spec import PiiSpec

#: Tokens a sketch keeps: enough for all that hold more than one part in a thousand.
TRACKED = 4096


def summarize(tokenized: DataFrame, spec: PiiSpec, tracked: int = TRACKED) -> DataFrame:
    """`(column_name, n_cells, sketch)` of the non-blank protected cells of a table, whether or not a vault knows them."""

    def one(c: str) -> list:
        cell = F.when(tokenizable(text(c)), text(c))
        sketch = F.call_function("approx_top_k_accumulate", cell, F.lit(tracked))
        return [F.count(cell).alias(f"{c}__n"), sketch.alias(f"{c}__sketch")]

    sums = tokenized.agg(*[column for c in spec.columns for column in one(c)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_cells"), F.col(f"{c}__sketch").alias("sketch")) for c in spec.columns]
    return sums.select(F.inline(F.array(*entries)))


def merge(summaries: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One summary per column of the rows `(column_name, n_cells, sketch)`."""
    combined = F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(tracked))
    return summaries.groupBy("column_name").agg(F.sum("n_cells").alias("n_cells"), combined.alias("sketch"))


def hot_tokens(summary: DataFrame, share: float, least: int, most: int = TRACKED) -> DataFrame:
    """`(column_name, token, n_cells)` of tokens with more than `share` of their column's cells and at least `least` of them.

    So a column has fewer than 1 / `share` of them, and never more than `most`.
    """
    items = F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(most))
    found = summary.select("column_name", F.col("n_cells").alias("total"), F.inline(items).alias("token", "n_cells"))
    enough = F.col("token").isNotNull() & (F.col("n_cells") >= least) & (F.col("n_cells") > F.col("total") * F.lit(float(share)))
    return found.filter(enough).select("column_name", "token", "n_cells")
