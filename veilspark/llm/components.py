"""Connected components of a table of links, without ever holding the links in one place.

Rounds of large-star and small-star: every node links its larger neighbours, then its smaller ones, to the
smallest node it knows. The links become stars around the smallest node of each component, in a number
of rounds that grows with the logarithm of the longest path. Every round reads and writes a table in
the shared folder; only its row count and a checksum reach the driver. Nodes are of any type that sorts; of `links` only the two named
columns are read, links of a node to itself and repeated links change nothing, and without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import staged


def _least(links: DataFrame) -> DataFrame:
    """Links (u, v) with `m`, the smallest of u and all v of u."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (node, root) but the smallest of its component."""
    state = staged(links.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        turned = state.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _least(state.union(turned)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Now every link leads from the larger to the smaller node.
        small = _least(large.where("u <> v").distinct())
        ends = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        state = staged(ends.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        now = state.select(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == last:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
