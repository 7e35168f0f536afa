"""Tokenize a table and publish it: write a version, check it, then move the view."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import text, tokenizable
from veilspark.functions.tokens import TokenKey
from veilspark.operators.assign import CallLimits
from veilspark.operators.ledger import RequestLedger, Sent
from veilspark.operators.lookup import LookupLimits, measure
from veilspark.operators.tokenize import merge_tokens, tokenize
from veilspark.operators.vault import (
    VAULT_OPTIONS,
    Vault,
    addition_conflicts,
    build_vault,
    distinct_cells,
    find_tokens,
    is_unique,
    missing_cells,
    save_known,
    save_slices,
    save_summary,
    unresolved,
    vault_additions,
    vault_duplicates,
    with_filter_bits,
)
from veilspark.sources.client import ClientFactory
from veilspark.sources.store import RunStore
from veilspark.spec import DEFAULT_BATCH_SIZE, PiiSpec


class PublishError(RuntimeError):
    """A check failed. The published view still points at the version it pointed at before."""


@dataclass(frozen=True)
class PublishReport:
    version: str
    n_rows: int
    n_tokens: int
    n_calls: int

    def __str__(self) -> str:
        return f"{self.n_tokens} tokens in {self.n_calls} batches ({self.n_rows} total rows)"


def versions(spark: SparkSession, table: str) -> list[str]:
    """The stored versions of `table`, oldest first."""
    database, _, name = table.rpartition(".")
    listed = spark.catalog.listTables(database or None, pattern=f"{name}__v*")
    found = [(int(m[1]), t.name) for t in listed if (m := re.fullmatch(rf"{re.escape(name)}__v(\d+)", t.name))]
    return [f"{database}.{n}" if database else n for _, n in sorted(found)]


def write_version(df: DataFrame, table: str) -> str:
    """Write `df` as the next version. A number whose folder holds files, of a run that died or is still
    writing, is passed over; of two runs that register one number, one fails."""
    last = versions(df.sparkSession, table)
    number = int(last[-1].rpartition("__v")[2]) + 1 if last else 1
    while True:
        version = f"{table}__v{number}"
        try:
            df.write.mode("errorifexists").format("parquet").saveAsTable(version)
            return version
        except PySparkException as error:
            if error.getCondition() != "LOCATION_ALREADY_EXISTS":
                raise
            number += 1


def point_view(spark: SparkSession, table: str, version: str) -> None:
    """The swap: one catalog update. Running readers keep the files of the old version."""
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {version}")


def drop_version(spark: SparkSession, version: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {version}")


def _cell_counts(df: DataFrame, spec: PiiSpec) -> dict[str, int]:
    """In one scan: rows, per protected column the cells that are non-blank and not null, and per other column a sum of hashes.

    A hash covers the cell and the row's key, so cells that change places change the sums.
    """
    counts = [F.count(F.lit(1)).alias("n_rows")]
    for c in spec.columns:
        counts.append(F.count_if(tokenizable(text(c))).alias(f"{c}__filled"))
        counts.append(F.count(c).alias(f"{c}__present"))
    kinds = dict(df.dtypes)
    for c in spec.passthrough(df):
        cell = F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c)  # maps have no hash
        counts.append(F.sum(F.xxhash64(*spec.key, cell).cast("decimal(38,0)")).alias(f"{c}__content"))
    return df.agg(*counts).first().asDict()


def check_version(source: DataFrame, version: DataFrame, spec: PiiSpec) -> dict[str, int]:
    """Fail unless the written version has the source's rows, filled cells, nulls, and the content of all columns that are not protected."""
    before, after = _cell_counts(source, spec), _cell_counts(version, spec)
    wrong = {k: (before[k], after.get(k)) for k in before if before[k] != after.get(k)}
    if wrong:
        raise PublishError(f"counts or contents differ (source, version): {wrong}")
    return after


def check_resolvable(version: DataFrame, spec: PiiSpec, vault: DataFrame) -> None:
    """Fail if a non-blank protected cell is not a token of the vault.

    That covers a cell left in plain text as well as a token nobody could read back.
    """
    lost = unresolved(version, spec, vault).groupBy("column_name").agg(F.sum("n_cells").alias("n"))
    counts = {r.column_name: r.n for r in lost.collect()}
    if counts:
        raise PublishError(f"cells that are no token of the vault: {counts}")


def publish_vault(
    source: DataFrame, spec: PiiSpec, key: TokenKey, table: str, buckets: int = 0, limits: LookupLimits = LookupLimits()
) -> DataFrame:
    """Append the values `table` lacks, checked before, and keep its measured sizes with it.

    Run again after a failure, it appends only what is missing. With `buckets`, which is fixed when the table is made, it is stored in
    buckets of its tokens' hashes, and large reads don't shuffle it; take at least as many as there are shuffle partitions.
    """
    spark = source.sparkSession
    known = spark.table(table) if spark.catalog.tableExists(table) else None
    rows = build_vault(source, spec, key) if known is None else vault_additions(source, spec, key, known)
    with RunStore(spark) as store:
        added = store.write(rows, "additions")  # the source is read once, and what is checked is what is appended
        append_to_vault(added, table, buckets, limits)
    return spark.table(table).select("column_name", "token", "value", "n_cells")


def append_to_vault(added: DataFrame, table: str, buckets: int = 0, limits: LookupLimits = LookupLimits()) -> None:
    """Append the stored vault rows `added`, after a check that nothing would be in `table` twice, and measure it anew.

    Should another run append at the same time, the rows are more than was there and was added; then the whole vault is checked, and
    the result is kept with it: large reads of a vault that is not `unique` group it by token first.
    """
    spark = added.sparkSession
    known = spark.table(table) if spark.catalog.tableExists(table) else None
    expected = added.count() + (known.count() if known is not None else 0)
    if not addition_conflicts(added, known).isEmpty():  # before the append, so that a conflict leaves the vault as it is
        raise PublishError(f"{table} would hold a token or value twice")
    checked = known is None or is_unique(spark, table)
    writer = added.write
    if buckets:
        hashed = added.withColumn("token_hash", F.xxhash64("token"))
        writer = hashed.repartition(buckets, "token_hash").write.bucketBy(buckets, "token_hash").sortBy("token_hash")
    writer = writer.mode("append").format("parquet").options(**VAULT_OPTIONS)
    writer.partitionBy("column_name").saveAsTable(table)
    vault = spark.table(table)
    slices = with_filter_bits(measure(vault, limits))
    unique = checked if sum(s.rows for s in slices.values()) == expected else vault_duplicates(vault).isEmpty()
    save_known(spark, table, vault, added, slices)
    save_slices(spark, table, slices, unique)


def tokenize_and_publish(
    source: DataFrame,
    spec: PiiSpec,
    key: TokenKey,
    table: str,
    vault_table: str,
    batch_size: int = DEFAULT_BATCH_SIZE,
    buckets: int = 0,
    limits: LookupLimits = LookupLimits(),
    retire: bool = False,
) -> PublishReport:
    """Tokenize `source`, store the vault, write and check a version of `table`, move the view.

    The vault is complete before a token becomes visible. The version is checked as it was written,
    not from task counters, which a re-run task could add to twice. A failed check drops the
    version and raises; the view is moved last. `retire` drops the earlier versions after that, the plain text with them; running
    readers of the old view then fail.
    """
    vault = publish_vault(source, spec, key, vault_table, buckets, limits)
    return _publish_version(source, tokenize(source, spec, key), spec, table, vault_table, vault, batch_size, retire)


def publish_via_client(
    source: DataFrame,
    spec: PiiSpec,
    key: TokenKey,
    client: ClientFactory,
    table: str,
    vault_table: str,
    batch_size: int = DEFAULT_BATCH_SIZE,
    connections: int = 8,
    call_limits: CallLimits = CallLimits(),
    buckets: int = 0,
    limits: LookupLimits = LookupLimits(),
    retire: bool = False,
) -> tuple[PublishReport, Sent]:
    """`tokenize_and_publish` with tokens that the vault behind `client` chooses.

    Every distinct value that the vault table lacks is sent once, by a `RequestLedger`. Started again after it died
    at any point, it sends only what has no written reply, and goes on from there.
    """
    spark = source.sparkSession
    ledger = RequestLedger(spark, vault_table)
    with RunStore(spark) as store:
        known = spark.table(vault_table) if spark.catalog.tableExists(vault_table) else None
        cells = distinct_cells(source, spec) if known is None else missing_cells(source, spec, known)
        told, sent = ledger.assign(cells, key, client, store, batch_size, connections, call_limits)
        added = store.write(told, "told")
        if added.count() != sent.needed:
            raise PublishError(f"{sent.needed} values need a token, {added.count()} have one")
        if sent.needed or known is None:
            append_to_vault(added, vault_table, buckets, limits)
    ledger.forget()
    vault = Vault.stored(spark, vault_table, limits)
    found = find_tokens(source, spec.columns, vault, spec.key)
    tokenized = merge_tokens(found, spec, {c: F.col(f"{c}_token") for c in spec.columns}).select(*source.columns)
    return _publish_version(source, tokenized, spec, table, vault_table, vault.frame, batch_size, retire), sent


def _publish_version(
    source: DataFrame,
    tokenized: DataFrame,
    spec: PiiSpec,
    table: str,
    vault_table: str,
    vault: DataFrame,
    batch_size: int,
    retire: bool,
) -> PublishReport:
    """Write `tokenized`, which was made of `source`, as a version, check it, and move the view to it."""
    spark = source.sparkSession
    earlier = versions(spark, table)
    version = write_version(tokenized, table)
    try:
        written = spark.table(version)
        counts = check_version(source, written, spec)
        check_resolvable(written, spec, vault)
    except Exception:
        drop_version(spark, version)
        raise
    save_summary(spark, vault_table, table, written, spec)
    point_view(spark, table, version)
    for old in earlier if retire else ():
        drop_version(spark, old)
    filled = [counts[f"{c}__filled"] for c in spec.columns]
    return PublishReport(version, counts["n_rows"], sum(filled), sum(-(-n // batch_size) for n in filled))
