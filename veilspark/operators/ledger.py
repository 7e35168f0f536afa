"""Requests to a vault that chooses tokens itself, kept so that a run that dies can be taken up where it was.

Two tables next to the vault record every request by its id, a keyed hash of column and value: an intent before it is
sent, an outcome with the token once the reply is written. A run sends only what has no outcome. So a run that was
killed after a reply sends nothing again, and one that was killed while waiting for replies sends the same ids, by which the vault knows the
repeat. Neither table holds a value.

Requests go out in waves. A wave is a job of `connections` tasks, each with one connection and a bounded number of cells, and its replies
are written before the next wave starts: however many cells there are, no more calls run at once, no task grows, and what a
killed run loses is one wave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.tokens import TokenKey
from veilspark.operators.assign import CELLS_PER_TASK, CallLimits, assign_tokens, request_id
from veilspark.sources.client import ClientFactory
from veilspark.sources.store import RunStore
from veilspark.spec import DEFAULT_BATCH_SIZE


@dataclass(frozen=True)
class Sent:
    """What a run did: cells that it needed tokens for, of these already answered, in doubt (sent before without a written reply), and sent now."""

    needed: int
    answered: int
    in_doubt: int
    sent: int
    waves: int


class RequestLedger:
    """The intents and outcomes of a vault table."""

    def __init__(self, spark: SparkSession, vault_table: str) -> None:
        self.spark = spark
        self.intents_table, self.outcomes_table = f"{vault_table}__intents", f"{vault_table}__outcomes"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.intents_table} (request_id STRING) USING parquet")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.outcomes_table} (request_id STRING, column_name STRING, token STRING) USING parquet")

    def outcomes(self) -> DataFrame:
        """`(request_id, column_name, token)`. A reply that was written twice, by two runs at once, is one row if its token is the same."""
        return self.spark.table(self.outcomes_table).distinct()

    def intents(self) -> DataFrame:
        return self.spark.table(self.intents_table).distinct()

    def _refresh(self) -> None:
        for name in (self.intents_table, self.outcomes_table):
            self.spark.catalog.refreshTable(name)

    def assign(
        self,
        cells: DataFrame,
        key: TokenKey,
        client: ClientFactory,
        store: RunStore,
        batch_size: int = DEFAULT_BATCH_SIZE,
        connections: int = 8,
        limits: CallLimits = CallLimits(),
        cells_per_task: int = CELLS_PER_TASK,
        name: str = "cells",
    ) -> tuple[DataFrame, Sent]:
        """`(column_name, token, value, n_cells)` of the distinct `cells`, asking the vault only for what no run was told yet."""
        self._refresh()
        wanted = cells.select("column_name", "value", "n_cells", request_id(key).alias("request_id"))
        wanted = store.write(wanted, f"{name}_wanted")
        pending = wanted.join(self.outcomes().select("request_id"), "request_id", "left_anti")
        # Dealt by the request id, a keyed hash: every wave and every task of it gets an even share of every column.
        pending = store.write(pending, f"{name}_pending")
        needed, open_ = wanted.count(), pending.count()
        in_doubt = pending.join(self.intents(), "request_id", "left_semi").count() if open_ else 0
        waves = -(-open_ // (connections * cells_per_task))
        for wave in range(waves):
            part = pending.where(F.pmod(F.xxhash64("request_id"), F.lit(waves)) == wave)
            part.select("request_id").coalesce(connections).write.mode("append").format("parquet").saveAsTable(self.intents_table)
            replies = assign_tokens(part, key, client, batch_size, connections, limits)
            told = replies.select(request_id(key).alias("request_id"), "column_name", "token")
            told.write.mode("append").format("parquet").saveAsTable(self.outcomes_table)
        self._refresh()
        found = wanted.join(self.outcomes(), ["request_id", "column_name"])
        return found.select("column_name", "token", "value", "n_cells"), Sent(needed, needed - open_, in_doubt, open_, waves)

    def forget(self) -> None:
        """Drop what is recorded: once the vault table holds the tokens, nothing is asked for them again."""
        self.spark.sql(f"TRUNCATE TABLE {self.intents_table}")
        self.spark.sql(f"TRUNCATE TABLE {self.outcomes_table}")
        self._refresh()
