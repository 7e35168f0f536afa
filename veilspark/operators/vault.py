"""The vault table `(column_name, token, value, n_cells)`: build, refresh, look up, check."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import long_cells, text, tokenizable, tokenizable_cells
from veilspark.functions.tokens import TokenKey, value_token
from veilspark.operators.heavy import hot_tokens, merge, summarize
from veilspark.operators.lookup import LookupLimits, Slice, lookup, lookup_few, measure, token_place
from veilspark.spec import PiiSpec

VALUE_SUFFIX = "__value"
SLICES_PROPERTY = "veilspark.slices"

# Write options of a stored vault: a filter on single tokens skips row groups without them.
VAULT_OPTIONS = {
    "parquet.bloom.filter.enabled#token": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def _hash(item: str) -> Column:
    """Leads the keys of joins on `(column_name, item)`: a number sorts fast, while column names are
    few and tokens share a prefix."""
    return F.xxhash64("column_name", item).alias("__hash")


def _counted(cells: DataFrame, item: str) -> DataFrame:
    """`(__hash, column_name, item, n_cells)`. Counts are combined map-side, so a hot value is one row
    per task, and a join on these keys needs no further shuffle of this side."""
    return cells.groupBy(_hash(item), "column_name", item).agg(F.count(F.lit(1)).alias("n_cells"))


def _missing(cells: DataFrame, vault: DataFrame, item: str) -> DataFrame:
    """Distinct cells whose `item` the vault lacks. Both sides hold a key once."""
    known = vault.select(_hash(item), "column_name", item)
    return _counted(cells, item).join(known, ["__hash", "column_name", item], "left_anti").drop("__hash")


def distinct_cells(df: DataFrame, spec: PiiSpec) -> DataFrame:
    """`(column_name, value, n_cells)`. Partial counts run map-side, so a hot value is one row per task."""
    cells = tokenizable_cells(df, spec)
    return cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_cells"))


def missing_cells(df: DataFrame, spec: PiiSpec, vault: DataFrame) -> DataFrame:
    """`distinct_cells` whose value the vault lacks."""
    return _missing(tokenizable_cells(df, spec), vault, "value")


def known_tokens(tokenized: DataFrame, spec: PiiSpec, vault: DataFrame) -> DataFrame:
    """`(column_name, token, n_cells, value)` per distinct cell, blank ones included; `value` is NULL
    where the vault has none."""
    cells = _counted(long_cells(tokenized, spec.columns).withColumnRenamed("value", "token"), "token")
    known = vault.groupBy(_hash("token"), "column_name", "token").agg(F.max("value").alias("value"))
    return cells.join(known, ["__hash", "column_name", "token"], "left").drop("__hash")


def build_vault(df: DataFrame, spec: PiiSpec, key: TokenKey) -> DataFrame:
    """The vault of an untokenized table; one HMAC per distinct value, not per cell."""
    return _with_token(distinct_cells(df, spec), key)


def _with_token(cells: DataFrame, key: TokenKey) -> DataFrame:
    token = value_token(key, F.col("column_name"), F.col("value"))
    return cells.select("column_name", token.alias("token"), "value", "n_cells")


def vault_additions(df: DataFrame, spec: PiiSpec, key: TokenKey, vault: DataFrame) -> DataFrame:
    """Vault rows for values the vault lacks."""
    return _with_token(missing_cells(df, spec, vault), key)


def refresh_vault(df: DataFrame, spec: PiiSpec, key: TokenKey, vault: DataFrame) -> DataFrame:
    return vault.unionByName(vault_additions(df, spec, key, vault))


def vault_duplicates(vault: DataFrame) -> DataFrame:
    """`(column_name, kind, item, n)`: tokens with several values, and values with several tokens."""

    def repeated(kind: str, item: str) -> DataFrame:
        # Vault rows are distinct triples, so a repeated item is an integrity error by itself.
        counts = vault.groupBy("column_name", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
        return counts.filter("n > 1").select("column_name", F.lit(kind).alias("kind"), "item", "n")

    return repeated("token", "token").unionByName(repeated("value", "value"))


def addition_conflicts(additions: DataFrame, vault: DataFrame | None) -> DataFrame:
    """`vault_duplicates` that appending `additions` would bring: among themselves, or with a token or value of `vault`."""
    found = vault_duplicates(additions)
    if vault is None:
        return found
    for kind in ("token", "value"):
        known = vault.select("column_name", kind)
        again = additions.join(known, ["column_name", kind], "left_semi")
        found = found.unionByName(again.select("column_name", F.lit(kind).alias("kind"), F.col(kind).alias("item"), F.lit(2).cast("long").alias("n")))
    return found


def shared_tokens(vault: DataFrame) -> DataFrame:
    """Tokens that stand for several values, whatever their columns: a lookup by token alone cannot tell them apart."""
    return vault.groupBy("token").agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low <> high").select("token")


def count_uses(vault: DataFrame, tokenized: DataFrame, spec: PiiSpec) -> DataFrame:
    """The vault with `n_cells` counted anew from a tokenized table (0 where unused)."""
    uses = long_cells(tokenized, spec.columns).filter(tokenizable(F.col("value")))
    uses = uses.groupBy("column_name", F.col("value").alias("token")).agg(F.count(F.lit(1)).alias("n_cells"))
    joined = vault.drop("n_cells").join(uses, ["column_name", "token"], "left")
    return joined.select("column_name", "token", "value", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


#: Bits of a filter for a stored token, and of the largest filter: 8 MB, which is what a read broadcasts for a column at most.
BITS_PER_TOKEN, MOST_BITS = 16, 1 << 26
_BITMAP_BITS = 32768


def with_filter_bits(slices: Mapping[str, Slice]) -> dict[str, Slice]:
    """Sizes with the bits of a token filter for each slice that is too large to broadcast."""

    def bits(s: Slice) -> int:
        return 0 if s.broadcast else min(MOST_BITS, max(_BITMAP_BITS, 1 << (BITS_PER_TOKEN * s.rows - 1).bit_length()))

    return {c: replace(s, known_bits=bits(s)) for c, s in slices.items()}


def known_tokens_filter(vault: DataFrame, slices: Mapping[str, Slice]) -> DataFrame:
    """`(column_name, n_bits, bucket, bits)`: a bitmap of the hashes of every large slice's tokens.

    A token whose bit is missing is not in the vault. In a vault of more tokens than the largest filter has bits nearly every bit is
    set, and the filter rules out little, but never a token that is there.
    """
    sized = {c: s.known_bits for c, s in slices.items() if s.known_bits}
    if not sized:
        return vault.sparkSession.createDataFrame([], "column_name string, n_bits bigint, bucket bigint, bits binary")
    n_bits = F.create_map(*[F.lit(x) for c, bits in sized.items() for x in (c, bits)])[F.col("column_name")].cast("bigint")
    place = F.pmod(F.xxhash64("token"), F.col("n_bits"))
    places = vault.select("column_name", n_bits.alias("n_bits"), "token").filter("n_bits IS NOT NULL")
    places = places.select("column_name", "n_bits", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    return places.groupBy("column_name", "n_bits", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))


@dataclass(frozen=True)
class Vault:
    """A stored vault and its measured slice sizes. `unique` says `vault_duplicates` found none.

    `hot` is `(column_name, token)`, a short list of tokens that fill many cells; `known` is `known_tokens_filter`; `bucketed`
    says that the table is stored in buckets of `token_hash`.
    """

    frame: DataFrame
    slices: Mapping[str, Slice]
    unique: bool = False
    hot: DataFrame | None = None
    known: DataFrame | None = None
    bucketed: bool = False

    @classmethod
    def open(cls, frame: DataFrame, limits: LookupLimits = LookupLimits(), unique: bool = False) -> Vault:
        """`frame` should be a stored table: it is scanned here and again by every lookup.

        Open it anew after it has grown, as the sizes decide what is broadcast.
        """
        return cls(frame, measure(frame, limits), unique)

    @classmethod
    def stored(cls, spark: SparkSession, table: str, limits: LookupLimits = LookupLimits()) -> Vault:
        """A vault table that `save_slices` was called for, without a scan of it, with what publishing keeps next to it."""
        found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        if SLICES_PROPERTY not in found:
            raise ValueError(f"{table} was not published as a vault; use Vault.open")
        slices = {c: Slice(**sizes) for c, sizes in json.loads(found[SLICES_PROPERTY]).items()}
        frame = spark.table(table)
        known, hot = None, None
        if spark.catalog.tableExists(known_table(table)):
            known = spark.table(known_table(table))
            known = known.filter(F.col("publish_no") == known.agg(F.max("publish_no")).scalar())
        if spark.catalog.tableExists(heavy_table(table)):
            hot = _stored_hot(spark, table, frame, limits)
        return cls(frame, slices, found.get(UNIQUE_PROPERTY, "true") == "true", hot, known, "token_hash" in frame.columns)

    def slice(self, column: str) -> DataFrame:
        return self.frame.filter(F.col("column_name") == column)

    def size(self, column: str) -> Slice:
        """A column that was not measured has an unknown size, and is not broadcast."""
        return self.slices.get(column, Slice(broadcast=False))

    def find(self, df: DataFrame, column: str, out: str, key: str, value: str, spread_by: Sequence[str], unique: bool) -> DataFrame:
        """`lookup` of the cells of `column` in its slice, with all that is known of it."""
        return self.find_in(df, column, column, out, key, value, spread_by, unique)

    def find_in(self, df: DataFrame, name: str, column: str, out: str, key: str, value: str, spread_by: Sequence[str], unique: bool) -> DataFrame:
        """`find` for cells of `name` that are in the column `column` of `df`."""
        hot = self.hot.filter(F.col("column_name") == name) if self.hot is not None else None
        known = self.known.filter(F.col("column_name") == name) if self.known is not None else None
        return lookup(df, column, out, self.slice(name), key, value, self.size(name), spread_by, unique, hot, known, self.bucketed)


UNIQUE_PROPERTY = "veilspark.unique"


def is_unique(spark: SparkSession, table: str) -> bool:
    """Whether it was checked that the vault table holds no token or value twice."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found.get(UNIQUE_PROPERTY, "true") == "true"


def heavy_table(table: str) -> str:
    """Where the summaries of tables tokenized with a vault are kept: `(publish_no, table_name, column_name, n_cells, sketch)`."""
    return f"{table}__heavy"


def known_table(table: str) -> str:
    return f"{table}__known"


def _next_publish(spark: SparkSession, table: str) -> int:
    if not spark.catalog.tableExists(table):
        return 1
    return (spark.table(table).agg(F.max("publish_no")).first()[0] or 0) + 1


def save_summary(spark: SparkSession, vault_table: str, name: str, tokenized: DataFrame, spec: PiiSpec) -> None:
    """Keep which tokens fill many cells of the table `name`, in place of what was kept of it before."""
    target = heavy_table(vault_table)
    rows = summarize(tokenized, spec).select(
        F.lit(_next_publish(spark, target)).cast("bigint").alias("publish_no"), F.lit(name).alias("table_name"), "column_name", "n_cells", "sketch"
    )
    rows.coalesce(1).write.mode("append").format("parquet").saveAsTable(target)


def save_known(spark: SparkSession, vault_table: str, vault: DataFrame, added: DataFrame | None, slices: Mapping[str, Slice]) -> None:
    """Keep the token filter of a vault. If its size stays, the filter of the rows `added` is merged into the last one; else it is built anew."""
    target = known_table(vault_table)
    if not spark.catalog.tableExists(target) and not any(s.known_bits for s in slices.values()):
        return
    number, made = _next_publish(spark, target), None
    if number > 1 and added is not None:
        old = spark.table(target).filter(F.col("publish_no") == number - 1)
        sizes = {r["column_name"]: r["n_bits"] for r in old.select("column_name", "n_bits").distinct().collect()}
        if sizes == {c: s.known_bits for c, s in slices.items() if s.known_bits}:
            both = old.drop("publish_no").unionByName(known_tokens_filter(added, slices))
            made = both.groupBy("column_name", "n_bits", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    made = known_tokens_filter(vault, slices) if made is None else made
    made.withColumn("publish_no", F.lit(number).cast("bigint")).write.mode("append").format("parquet").saveAsTable(target)


def _stored_hot(spark: SparkSession, table: str, vault: DataFrame, limits: LookupLimits) -> DataFrame:
    """`(column_name, token)` by the merged summaries of all tables: per column fewer than there are shuffle partitions, and what fits a broadcast."""
    heavy = spark.table(heavy_table(table))
    last = heavy.groupBy("table_name").agg(F.max("publish_no").alias("publish_no"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = hot_tokens(merge(heavy.join(F.broadcast(last), ["table_name", "publish_no"])), 1 / partitions, limits.hot_cells)
    width = F.coalesce(F.octet_length("value"), F.lit(0)) + F.octet_length(found["token"])
    sized = found.join(vault.select("column_name", "token", "value"), ["column_name", "token"], "left")
    rows = sized.select("column_name", "token", "n_cells", width.alias("width")).orderBy(F.desc("n_cells"), "token").collect()
    kept, room = [], max(limits.bytes_for(spark), 1 << 20)
    for row in rows:
        room -= row["width"]
        if room < 0:
            break
        kept.append((row["column_name"], row["token"]))
    return spark.createDataFrame(kept, "column_name string, token string")


def save_slices(spark: SparkSession, table: str, slices: Mapping[str, Slice], unique: bool = True) -> None:
    """Keep the sizes of a vault table with it, and whether it was checked that nothing is in it twice. To be repeated whenever it has grown."""
    text = json.dumps({c: asdict(s) for c, s in slices.items()}).replace("\\", "\\\\").replace("'", "\\'")
    flag = "true" if unique else "false"
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{SLICES_PROPERTY}' = '{text}', '{UNIQUE_PROPERTY}' = '{flag}')")


def _shuffled_first(columns: Sequence[str], vault: Vault) -> list[str]:
    """Columns that need a shuffle first, so that no value a broadcast can add later is shuffled."""
    return sorted(columns, key=lambda c: vault.size(c).broadcast)


def resolve(
    df: DataFrame,
    columns: Sequence[str],
    vault: Vault,
    spread_by: Sequence[str],
    render: Callable[[str, Column, Column], dict[str, Column]] | None = None,
    prunable: bool = False,
    few: bool = False,
) -> DataFrame:
    """`df` plus `<column>__value`, the vault value of each token, NULL if there is none.

    `render(column, token, value)` names what to keep instead. It is applied right after each
    lookup, so the next shuffle carries only what the reader will see. `prunable` keeps the plan in
    a form whose joins the optimizer drops when their values are not read. `few` says that `df` is a
    stored table small enough to broadcast.
    """
    unique = vault.unique and not prunable
    large = [c for c in columns if not vault.size(c).broadcast]
    together = large if vault.bucketed and len(large) > 1 and not prunable and not few else []
    if together:
        df = _resolve_together(df, together, vault, spread_by, unique)
    for c in _shuffled_first(columns, vault):
        found = c + VALUE_SUFFIX
        if few and c in large:
            df = lookup_few(df, c, found, vault.slice(c), "token", "value")
        elif c not in together:
            df = vault.find(df, c, found, "token", "value", spread_by, unique)
        if render:
            df = df.withColumns(render(c, F.col(c), F.col(found))).drop(found)
    return df


def _resolve_together(df: DataFrame, columns: Sequence[str], vault: Vault, key: Sequence[str], unique: bool) -> DataFrame:
    """`df` plus the values of several large columns, for one shuffle of its rows.

    Only `(key, token)` of each column is shuffled to the buckets of the vault. What is found comes back as one map
    per key, from which every row takes its cells, so a key that is not unique gives no wrong cell.
    """
    names = [f"__k{i}" for i in range(len(key))]
    keys = [F.col(k).alias(name) for k, name in zip(key, names, strict=True)]

    def cell(column: str) -> Column:
        return F.concat(F.lit(f"{column}|"), text(column))

    found: DataFrame | None = None
    for c in columns:
        cells = df.select(*keys, text(c).alias("__token")).filter(tokenizable(F.col("__token")))
        hits = vault.find_in(cells, c, "__token", "__value", "token", "value", names, unique).filter("__value IS NOT NULL")
        part = hits.select(*names, F.struct(F.concat(F.lit(f"{c}|"), "__token").alias("token"), F.col("__value").alias("value")).alias("cell"))
        found = part if found is None else found.unionByName(part)
    values = found.groupBy(*names).agg(F.map_from_entries(F.collect_set("cell")).alias("__values"))
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(key, names, strict=True)]
    joined = df.join(values, same, "left")
    return joined.withColumns({c + VALUE_SUFFIX: F.try_element_at("__values", cell(c)) for c in columns}).drop(*names, "__values")


def find_tokens(df: DataFrame, columns: Sequence[str], vault: Vault, spread_by: Sequence[str]) -> DataFrame:
    """`df` plus `<column>_token`, the vault token of each value, NULL if there is none."""
    for c in _shuffled_first(columns, vault):
        df = vault.find(df, c, f"{c}_token", "value", "token", spread_by, vault.unique)
    return df


def unresolved(tokenized: DataFrame, spec: PiiSpec, vault: DataFrame) -> DataFrame:
    """`(column_name, token, n_cells)` of non-blank cells the vault does not know.

    Cells are reduced to distinct ones first, so a hot token is compared once.
    """
    cells = tokenizable_cells(tokenized, spec).withColumnRenamed("value", "token")
    return _missing(cells, vault, "token")
