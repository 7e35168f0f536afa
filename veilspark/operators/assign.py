"""Vaults that choose the token themselves: batched client calls from inside tasks."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as NoReply
from dataclasses import dataclass
from typing import Any, TypeVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import veilspark
from veilspark.functions.replies import token_of_record
from veilspark.functions.tokens import TokenKey, hmac_token
from veilspark.operators.lookup import LookupLimits
from veilspark.operators.tokenize import merge_tokens
from veilspark.operators.vault import Vault, distinct_cells, find_tokens, missing_cells, resolve
from veilspark.sources.client import ClientFactory
from veilspark.sources.store import RunStore
from veilspark.spec import DEFAULT_BATCH_SIZE, PLAIN_TEXT, PiiSpec, check_mode

# Task code travels with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(veilspark)

T = TypeVar("T")

ATTEMPTS = 3
BACKOFF_SECONDS = 2.0

def request_id(key: TokenKey) -> Column:
    """The id of a request for the token of `(column_name, value)`: a keyed hash, equal on every run."""
    return hmac_token(key, F.concat(F.lit("request|"), "column_name", F.lit("|"), "value"))


# Rows per Arrow batch returned to the JVM; vault calls are much smaller.
_OUT_ROWS = 10_000
_OUT_SCHEMA = "column_name string, token string, value string, n_cells bigint"


#: Cells or tokens that one task sends.
CELLS_PER_TASK = 50_000


@dataclass(frozen=True)
class CallLimits:
    """What a task allows a call: seconds until a write or a read counts as failed, and calls a second of one connection (None: no limit)."""

    write_seconds: float = 30.0
    read_seconds: float = 10.0
    calls_per_second: float | None = None


class Caller:
    """Makes the calls of one connection, each within its time and no more often than allowed.

    A call that is late fails with `TimeoutError`, an `OSError`, and its thread is left behind: what it may still return is not used.
    """

    def __init__(self, seconds: float, calls_per_second: float | None = None) -> None:
        self.seconds, self.gap, self.next = seconds, 1 / calls_per_second if calls_per_second else 0.0, 0.0
        self.pool = ThreadPoolExecutor(1)

    def __call__(self, call: Callable[[], T]) -> T:
        wait = self.next - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.next = time.monotonic() + self.gap
        try:
            return self.pool.submit(call).result(self.seconds)
        except NoReply as late:
            self.pool.shutdown(wait=False)
            self.pool = ThreadPoolExecutor(1)
            raise TimeoutError(f"no reply within {self.seconds} s") from late

    def close(self) -> None:
        self.pool.shutdown(wait=False)


class VaultReplyError(RuntimeError):
    """The vault answered, but not with one usable record per request."""


def with_retry(call: Callable[[], T], attempts: int = ATTEMPTS, backoff: float = BACKOFF_SECONDS) -> T:
    """Run `call`, waiting 2 s, 4 s, ... between attempts. A malformed reply is not retried."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except VaultReplyError:
            raise
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("attempts must be at least 1")


def paired(records: list[dict[str, Any]], sent: int, column: str) -> list[dict[str, Any]]:
    """Reply i belongs to request i. Surplus records are ignored, missing ones are an error."""
    if not isinstance(records, list) or len(records) < sent:
        got = len(records) if isinstance(records, list) else 0
        raise VaultReplyError(f"{column}: {sent} records sent, {got} received")
    return records[:sent]


def _requests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[tuple]]]:
    """A column name and up to `size` of its rows; input is sorted by its first field, the column."""
    rows = itertools.chain.from_iterable(
        zip(*(field.to_pylist() for field in batch.columns), strict=True) for batch in batches
    )
    for column, run in itertools.groupby(rows, key=lambda row: row[0]):
        while chunk := list(itertools.islice(run, size)):
            yield column, chunk


_TYPES = {"column_name": pa.string(), "token": pa.string(), "value": pa.string(), "n_cells": pa.int64()}
_STATUS_TYPES = {"column_name": pa.string(), "token": pa.string(), "value": pa.string(), "status": pa.string(), "n_cells": pa.int64()}


def _packed(rows: Iterator[tuple], types: dict[str, pa.DataType] = _TYPES) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, _OUT_ROWS)):
        fields = [pa.array(field, kind) for field, kind in zip(zip(*chunk, strict=True), types.values(), strict=True)]
        yield pa.RecordBatch.from_arrays(fields, names=list(types))


def assign_tokens(
    cells: DataFrame,
    key: TokenKey,
    client: ClientFactory,
    batch_size: int = DEFAULT_BATCH_SIZE,
    connections: int = 8,
    limits: CallLimits = CallLimits(),
    backoff: float = BACKOFF_SECONDS,
) -> DataFrame:
    """`(column_name, token, value, n_cells)` for distinct cells, tokens chosen by the vault.

    One partition is one connection. `RequestLedger` sends any number of cells in waves of such jobs. Each cell carries a request id that does not change when a task
    is retried or speculated, so the vault can recognise the repeat. Materialize the result before
    using it twice.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault, caller = client(), Caller(limits.write_seconds, limits.calls_per_second)

        def rows() -> Iterator[tuple]:
            for column, chunk in _requests(batches, batch_size):
                values, ids = [row[1] for row in chunk], [row[3] for row in chunk]
                reply = with_retry(lambda: caller(lambda: vault.insert(column, values, ids)), backoff=backoff)
                for row, record in zip(chunk, paired(reply, len(chunk), column), strict=True):
                    token = token_of_record(record, column)
                    if not token:
                        raise VaultReplyError(f"{column}: a record came back without a token")
                    yield column, token, row[1], row[2]
            caller.close()

        return _packed(rows())

    sent = (
        cells.select("column_name", "value", "n_cells", request_id(key).alias("request_id"))
        .repartition(connections, "column_name", "value")
        .sortWithinPartitions("column_name")
    )
    return sent.mapInArrow(send, _OUT_SCHEMA)


def tokenize_via_vault(
    df: DataFrame,
    spec: PiiSpec,
    key: TokenKey,
    client: ClientFactory,
    store: RunStore,
    known: DataFrame | None = None,
    batch_size: int = DEFAULT_BATCH_SIZE,
    connections: int = 8,
    limits: LookupLimits = LookupLimits(),
    name: str = "assigned",
) -> tuple[DataFrame, Vault]:
    """Tokenize with vault-assigned tokens; returns the table and the vault used for it.

    Only distinct values that `known` lacks are sent. The replies are written before they are
    joined back, so no plan ever asks the vault twice.
    """
    cells = distinct_cells(df, spec) if known is None else missing_cells(df, spec, known)
    cells = store.write(cells, f"{name}_cells")
    needed = cells.count()
    fresh = store.write(assign_tokens(cells, key, client, batch_size, tasks_for(needed, connections)), name)
    if fresh.count() != needed:
        raise VaultReplyError(f"{needed} values need a token, {fresh.count()} have one")
    vault = Vault.open(fresh if known is None else known.unionByName(fresh), limits)
    found = find_tokens(df, spec.columns, vault, spec.key)
    merged = merge_tokens(found, spec, {c: F.col(f"{c}_token") for c in spec.columns})
    return merged.select(*df.columns), vault


def tasks_for(cells: int, connections: int) -> int:
    """At least `connections` tasks, and so many that none sends more than `CELLS_PER_TASK`."""
    return max(connections, -(-cells // CELLS_PER_TASK))


FOUND, UNKNOWN, FAILED = "found", "unknown", "failed"


def read_status(
    tokens: DataFrame,
    client: ClientFactory,
    mode: str = PLAIN_TEXT,
    batch_size: int = DEFAULT_BATCH_SIZE,
    connections: int = 8,
    limits: CallLimits = CallLimits(),
    attempts: int = ATTEMPTS,
    backoff: float = BACKOFF_SECONDS,
) -> DataFrame:
    """`(column_name, token, value, status, n_cells)` for every row of distinct `(column_name, token, n_cells)`.

    The vault renders the mode. `unknown` is a token that it cannot resolve, `failed` one of a call whose transport (an `OSError`, or
    no reply in time) still fails after the retries; neither has a value. Any other error, such as a short reply or a
    refused login, fails the job.
    """
    check_mode(mode)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault, caller = client(), Caller(limits.read_seconds, limits.calls_per_second)

        def rows() -> Iterator[tuple]:
            for column, chunk in _requests(batches, batch_size):
                sent = [row[1] for row in chunk]
                try:
                    reply = with_retry(lambda: caller(lambda: vault.detokenize(sent, mode)), attempts, backoff)
                except PermissionError:
                    raise
                except OSError:
                    yield from ((column, row[1], None, FAILED, row[2]) for row in chunk)
                    continue
                for row, record in zip(chunk, paired(reply, len(chunk), "detokenize"), strict=True):
                    value = record.get("value")
                    yield column, row[1], value, UNKNOWN if value is None else FOUND, row[2]
            caller.close()

        return _packed(rows(), _STATUS_TYPES)

    asked = tokens.select("column_name", "token", "n_cells")
    asked = asked.repartition(connections, "column_name", "token").sortWithinPartitions("column_name")
    return asked.mapInArrow(ask, "column_name string, token string, value string, status string, n_cells bigint")


def read_values(tokens: DataFrame, client: ClientFactory, mode: str = PLAIN_TEXT, **options: Any) -> DataFrame:
    """`(column_name, token, value, n_cells)` of the tokens that `read_status` finds."""
    return read_status(tokens, client, mode, **options).filter(F.col("status") == FOUND).select("column_name", "token", "value", "n_cells")


def status_counts(status: DataFrame) -> DataFrame:
    """`(column_name, status, n_tokens, n_cells)` of `read_status`: what a reader was not shown, and why."""
    return status.groupBy("column_name", "status").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("n_cells").alias("n_cells"))


def detokenize_via_client(
    df: DataFrame,
    spec: PiiSpec,
    client: ClientFactory,
    store: RunStore,
    mode: str = PLAIN_TEXT,
    batch_size: int = DEFAULT_BATCH_SIZE,
    connections: int = 8,
    call_limits: CallLimits = CallLimits(),
    limits: LookupLimits = LookupLimits(),
    backoff: float = BACKOFF_SECONDS,
    name: str = "read",
) -> tuple[DataFrame, DataFrame]:
    """The table as a vault behind a client shows it under `mode`, and the written `read_status` of its distinct tokens.

    Every token is asked for once, however many cells hold it, in waves of `connections` tasks; what was told is written, and joined
    back like any vault. A token without a value is shown as it is, and counted by `status_counts`.
    """
    tokens = store.write(distinct_cells(df, spec).withColumnRenamed("value", "token"), f"{name}_tokens")
    waves = max(1, -(-tokens.count() // (connections * CELLS_PER_TASK)))
    parts = []
    for wave in range(waves):
        part = tokens.where(F.pmod(F.xxhash64("column_name", "token"), F.lit(waves)) == wave)
        told = read_status(part, client, mode, batch_size, connections, call_limits, backoff=backoff)
        parts.append(store.write(told, f"{name}_status_{wave}"))
    status = parts[0]
    for part in parts[1:]:
        status = status.unionByName(part)
    vault = Vault.open(status.filter(F.col("status") == FOUND).select("column_name", "token", "value", "n_cells"), limits, unique=True)

    def shown(c: str, token: Column, value: Column) -> dict[str, Column]:
        return {c: F.coalesce(value, token)}

    return resolve(df, spec.columns, vault, spec.key, shown).select(*df.columns), status
