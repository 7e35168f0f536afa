"""Attach a vault column to a table by key: the join behind tokenize-by-vault and detokenize.

Three physical forms, chosen from measured sizes:

* a slice within the broadcast limit is broadcast;
* a larger one is shuffled, and the keys known to hold a large share of the cells (a bounded list)
  are answered by a broadcast of just those rows; a vault that is stored in buckets of its tokens' hashes is not
  shuffled, only the rows that look something up;
* rows that need no shuffled match (hot, NULL or blank cells, and tokens that a filter of the vault's tokens
  rules out) get a key that matches nothing and differs per row, so they spread over all partitions and never pile up in one.

The looked-up side is grouped by its key, unless the caller has checked that keys are unique. So a
duplicate in the vault cannot multiply rows, and the optimizer knows the key is unique, which lets it
drop the join when the result is not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import tokenizable

# Java object and hash-table overhead per row, in bytes, on top of the strings themselves.
ROW_OVERHEAD = 64
# If the hot rows are too wide to broadcast, the threshold is raised by this factor, up to this share.
_RAISE, _TOP_SHARE = 4, 0.3


@dataclass(frozen=True)
class LookupLimits:
    """`broadcast_bytes` None means the session's spark.sql.autoBroadcastJoinThreshold.

    A key is hot if it holds at least `hot_cells` cells and more cells than an average shuffle
    partition. So there are never more hot keys than shuffle partitions.
    """

    broadcast_bytes: int | None = None
    hot_cells: int = 1_000_000

    def bytes_for(self, spark: SparkSession) -> int:
        if self.broadcast_bytes is not None:
            return self.broadcast_bytes
        return _size(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def _size(text: str) -> int:
    """Bytes of a Spark size setting such as 10485760, 10485760b, 10m or 1g."""
    text = text.strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    if text and text[-1] in units:
        return int(text[:-1]) << units[text[-1]]
    return int(text)


@dataclass(frozen=True)
class Slice:
    """Measured size of one column's vault rows, from which cell count on a key is hot, and the bits of its token filter (0: none)."""

    rows: int = 0
    bytes: int = 0
    cells: int = 0
    broadcast: bool = True
    hot_from: int | None = None
    known_bits: int = 0


def measure(frame: DataFrame, limits: LookupLimits = LookupLimits()) -> Mapping[str, Slice]:
    """Sizes per `column_name` of a vault; one row per protected column reaches the driver."""
    limit = limits.bytes_for(frame.sparkSession)
    counted = "n_cells" in frame.columns
    width = (F.octet_length("token") + F.octet_length("value") + ROW_OVERHEAD).cast("bigint")
    sized = frame.select(
        "column_name", width.alias("width"), (F.col("n_cells") if counted else F.lit(0)).alias("n_cells")
    )
    totals = sized.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("width").alias("bytes"), F.sum("n_cells").alias("cells")
    )
    found = {
        r["column_name"]: Slice(r["rows"], r["bytes"], r["cells"], r["bytes"] <= limit) for r in totals.collect()
    }
    large = {c: s for c, s in found.items() if not s.broadcast and s.cells}
    if not large:
        return found

    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [min(1 / partitions, _TOP_SHARE)]
    while shares[-1] * _RAISE <= _TOP_SHARE:
        shares.append(shares[-1] * _RAISE)

    def floor(s: Slice, share: float) -> int:
        return max(limits.hot_cells, int(s.cells * share) + 1)

    checks = [
        F.sum(F.when((F.col("column_name") == c) & (F.col("n_cells") >= floor(s, share)), F.col("width"))).alias(
            f"{i}_{j}"
        )
        for i, (c, s) in enumerate(large.items())
        for j, share in enumerate(shares)
    ]
    hot_bytes = sized.agg(*checks).first().asDict()
    hot_limit = max(limit, 1 << 20)
    for i, (c, s) in enumerate(large.items()):
        fits = [share for j, share in enumerate(shares) if 0 < (hot_bytes[f"{i}_{j}"] or 0) <= hot_limit]
        if fits:
            found[c] = Slice(s.rows, s.bytes, s.cells, False, floor(s, fits[0]))
    return found


def _has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap of `bitmap_construct_agg` holds a position, by way of one of its hex digits."""
    byte = F.substr(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))
    low = position.bitwiseAND(F.lit(7))
    digit = F.ascii(F.substr(F.hex(byte), F.when(low < 4, 2).otherwise(1), F.lit(1)))
    value = digit - F.when(digit > 57, 55).otherwise(48)
    return F.coalesce(F.getbit(value, low.bitwiseAND(F.lit(3)).cast("int")) == 1, F.lit(False))


def token_place(token: Column, bits: int) -> Column:
    """The bit of a token in a filter of so many bits."""
    return F.pmod(F.xxhash64(token), F.lit(bits).cast("bigint"))


def _hot_rows(side: DataFrame, hot: DataFrame, key: str, value: str) -> DataFrame:
    """`(__hot_key, __hot)` of the tokens `hot`. Asked by token, those that `side` lacks are kept with NULL: they need no shuffle either."""
    tokens = F.broadcast(hot.select(F.col("token").alias("__token")))
    rows = side.join(tokens, F.col("token") == F.col("__token"), "left_semi").select(F.col(key).alias("__hot_key"), F.col(value).alias("__hot"))
    if key == "token":
        rows = hot.select(F.col("token").alias("__hot_key"), F.lit(None).cast("string").alias("__hot")).unionByName(rows)
    return rows.groupBy("__hot_key").agg(F.max("__hot").alias("__hot"))


def lookup(
    df: DataFrame,
    column: str,
    out: str,
    side: DataFrame,
    key: str,
    value: str,
    size: Slice,
    spread_by: Sequence[str],
    unique: bool = False,
    hot: DataFrame | None = None,
    known: DataFrame | None = None,
    bucketed: bool = False,
) -> DataFrame:
    """`df` plus `out`: the `value` of the `side` row whose `key` equals `column`, else NULL.

    `unique` promises that no `key` occurs twice. A shuffled side is then joined as it is, which
    saves its aggregation and leaves the join open to every adaptive rewrite. `hot` lists tokens that fill many cells
    (else `n_cells` tells), `known` is the filter `(bucket, bits)` of the side's tokens, and `bucketed` says that the side is stored
    in buckets of `token_hash`; the last two serve lookups by token.
    """
    cell = F.col(column).cast("string")
    if size.broadcast:
        small = side.groupBy(F.col(key).alias("__key")).agg(F.max(value).alias(out))
        return df.join(F.broadcast(small), cell == F.col("__key"), "left").drop("__key")

    columns = [*df.columns]
    no_match = ~F.coalesce(tokenizable(cell), F.lit(False))
    result = F.col("__cold")
    hot_rows = None
    if hot is not None:
        hot_rows = _hot_rows(side, hot, key, value)
    elif size.hot_from is not None:
        hot_rows = side.filter(F.col("n_cells") >= size.hot_from).groupBy(F.col(key).alias("__hot_key")).agg(F.max(value).alias("__hot"))
    if hot_rows is not None:
        df = df.join(F.broadcast(hot_rows), cell == F.col("__hot_key"), "left")
        no_match = no_match | F.col("__hot_key").isNotNull()
        result = F.coalesce(F.col("__hot"), result)
    if known is not None and size.known_bits and key == "token":
        place = token_place(cell, size.known_bits)
        bitmaps = known.groupBy(F.col("bucket").alias("__bucket")).agg(F.any_value("bits").alias("__bits"))
        df = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(place) == F.col("__bucket"), "left")
        no_match = no_match | ~_has_bit(F.col("__bits"), F.bitmap_bit_position(place))
    # Joined on (hash, key): hashes sort and compare as numbers, where tokens share long prefixes.
    df = df.withColumns(
        {
            "__probe": F.when(no_match, F.xxhash64(*spread_by)).otherwise(F.xxhash64(cell)),
            "__probe_key": F.when(~no_match, cell),
        }
    )
    if bucketed and key == "token":
        cold = side.select(F.col("token_hash").alias("__hash"), F.col(key).alias("__key"), F.col(value).alias("__cold"))
        if not unique:
            cold = cold.groupBy("__hash", "__key").agg(F.max("__cold").alias("__cold"))
        # Only the hash is a join key, so that the buckets are the partitions of the join.
        match = (F.col("__probe") == F.col("__hash")) & F.coalesce(F.col("__probe_key") == F.col("__key"), F.lit(False))
        return df.join(cold.hint("merge"), match, "left").select(*columns, result.alias(out))
    cold = side.select(F.xxhash64(key).alias("__hash"), F.col(key).alias("__key"), F.col(value).alias("__cold"))
    if not unique:
        # Shuffled as it is: few keys repeat, so a map-side aggregate would only sort for nothing.
        cold = cold.repartition("__hash", "__key").groupBy("__hash", "__key").agg(F.max("__cold").alias("__cold"))
    match = (F.col("__probe") == F.col("__hash")) & (F.col("__probe_key") == F.col("__key"))
    joined = df.join(cold, match, "left")
    return joined.select(*columns, result.alias(out))


def lookup_few(df: DataFrame, column: str, out: str, side: DataFrame, key: str, value: str) -> DataFrame:
    """`lookup` for a stored table of few rows: its keys are broadcast to the scan of `side`, which is
    filtered in place and never shuffled."""
    cell = F.col(column).cast("string")
    wanted = F.broadcast(df.select(cell.alias("__wanted")).distinct())
    found = side.join(wanted, F.col(key) == F.col("__wanted"), "left_semi")
    found = found.groupBy(F.col(key).alias("__key")).agg(F.max(value).alias(out))
    return df.join(F.broadcast(found), cell == F.col("__key"), "left").drop("__key")
