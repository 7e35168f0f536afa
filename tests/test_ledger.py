"""Publishing and reading through a client: nothing is sent twice, late calls fail, what is not found is counted."""

import sys
import time

import pytest
from conftest import SECRET, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entry_clients import HexClient, HmacClient, PhonelessClient
from veilspark.operators import assign, ledger
from veilspark.operators import tokenize as tok
from veilspark.operators.assign import Caller, CallLimits, detokenize_via_client, status_counts
from veilspark.operators.vault import distinct_cells
from veilspark.plans import publish
from veilspark.sources.customers import CUSTOMER_PII as PII
from veilspark.sources.customers import generate_customers
from veilspark.sources.store import RunStore
from veilspark.spec import MASKED

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Logged(HmacClient):
    """Writes every request id to a folder, and dies on a column if told so."""

    def __init__(self, folder, dies_on=None):
        super().__init__(SECRET)
        self.folder, self.dies_on = folder, dies_on

    def insert(self, column, values, request_ids):
        if column == self.dies_on:
            raise PermissionError("the run is over")
        for i in request_ids:
            with open(f"{self.folder}/{i}", "a") as f:
                f.write("sent\n")
        return super().insert(column, values, request_ids)


def sent(folder):
    return {p.name: p.read_text().count("sent") for p in folder.iterdir()}


@pytest.fixture
def names(spark):
    store = RunStore(spark)
    yield store.name("customers"), store.name("vault")
    store.drop()


def run(spark, key, names, client, n=50):
    return publish.publish_via_client(generate_customers(spark, n), PII, key, client, *names)


def test_publish_via_client(spark, key, names, tmp_path):
    report, done = run(spark, key, names, lambda: Logged(tmp_path))
    assert str(report) == "300 tokens in 12 batches (50 total rows)"
    assert (done.needed, done.answered, done.in_doubt, done.sent) == (42, 0, 0, 42) and set(sent(tmp_path).values()) == {1}
    assert rows(spark.table(names[0])) == rows(tok.tokenize(generate_customers(spark, 50), PII, key))
    _, again = run(spark, key, names, lambda: Logged(tmp_path), 60)
    # Ten more customers bring no new name, phone, address, birth date or e-mail address.
    assert (again.needed, again.sent) == (0, 0) and spark.table(names[0]).count() == 60


def test_a_run_killed_after_the_replies_sends_nothing_twice(spark, key, names, tmp_path, monkeypatch):
    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(publish, "append_to_vault", die)
        with pytest.raises(RuntimeError, match="killed"):
            run(spark, key, names, lambda: Logged(tmp_path))
    assert len(sent(tmp_path)) == 42 and not spark.catalog.tableExists(names[1])
    with monkeypatch.context() as patch:
        patch.setattr(publish, "_publish_version", die)  # the vault is complete, the table is not
        with pytest.raises(RuntimeError, match="killed"):
            run(spark, key, names, lambda: Logged(tmp_path))
    report, done = run(spark, key, names, lambda: Logged(tmp_path))
    assert report.n_tokens == 300 and done.sent == 0 and set(sent(tmp_path).values()) == {1}
    assert spark.table(f"{names[1]}__outcomes").count() == 0


def test_a_run_killed_in_the_middle_asks_for_the_rest(spark, key, names, tmp_path):
    store = RunStore(spark)
    cells, book = distinct_cells(generate_customers(spark, 50), PII), ledger.RequestLedger(spark, names[1])
    few = {"batch_size": 3, "connections": 1, "cells_per_task": 15}
    with pytest.raises(Exception, match="the run is over"):
        # Three waves of about fourteen requests; some wave meets an address and dies, with its intents written.
        book.assign(cells, key, lambda: Logged(tmp_path, "address"), store, name="one", **few)
    told = book.outcomes().count()
    found, done = book.assign(cells, key, lambda: Logged(tmp_path), store, name="two", **few)
    assert rows(found) == rows(assign.assign_tokens(cells, key, lambda: HmacClient(SECRET)))
    assert (done.needed, done.answered, done.sent) == (42, told, 42 - told) and done.in_doubt > 0
    recorded = {r.request_id for r in book.outcomes().collect()}
    assert set(sent(tmp_path)) == recorded and max(sent(tmp_path).values()) <= 2
    store.drop()


def test_the_ledger_holds_no_value(spark, key, names):
    store = RunStore(spark)
    book = ledger.RequestLedger(spark, names[1])
    book.assign(distinct_cells(generate_customers(spark, 50), PII), key, lambda: HmacClient(SECRET), store)
    assert book.outcomes().columns == ["request_id", "column_name", "token"] and book.intents().columns == ["request_id"]
    store.drop()


def test_a_late_call_fails_and_the_next_one_works():
    caller = Caller(0.05)
    with pytest.raises(OSError, match="no reply"):
        caller(lambda: time.sleep(1))
    assert caller(lambda: 7) == 7
    paced, start = Caller(5, calls_per_second=50), time.monotonic()
    assert [paced(lambda k=k: k) for k in range(6)] == list(range(6)) and time.monotonic() - start >= 0.1


class Slow(HexClient):
    def detokenize(self, tokens, redaction):
        time.sleep(3)
        return super().detokenize(tokens, redaction)


def test_reads_join_back_and_count_what_is_missing(spark, key, store):
    source = generate_customers(spark, 50)
    lost = F.col("customer_id") < "CUST00011"
    token = {c: F.concat(F.when(lost, "lost_").otherwise("hex_"), F.lower(F.hex(F.encode(c, "utf-8")))) for c in PII.columns}
    table = source.withColumns(token | {"address": F.when(lost, F.lit("  "))})
    shown, status = detokenize_via_client(table, PII, PhonelessClient, store, MASKED, backoff=0.01)
    assert shown.columns == table.columns
    first = {r.customer_id: r for r in shown.collect()}
    assert first["CUST00050"].first_name == "J***ca" and first["CUST00050"].email == "j***@example.com"
    assert first["CUST00001"].first_name == "lost_" + b"Jonathan".hex() and first["CUST00001"].address == "  "
    assert first["CUST00050"].phone_number.startswith("hex_") and first["CUST00050"].address is None
    counts = {(r.column_name, r.status): (r.n_tokens, r.n_cells) for r in status_counts(status).collect()}
    assert counts == {
        ("first_name", "found"): (4, 40), ("first_name", "unknown"): (4, 10), ("last_name", "found"): (4, 40), ("last_name", "unknown"): (4, 10),
        ("email", "found"): (4, 40), ("email", "unknown"): (4, 10), ("phone_number", "failed"): (20, 50),
        ("date_of_birth", "found"): (10, 40), ("date_of_birth", "unknown"): (10, 10),
    }


def test_calls_that_are_late_are_counted_as_failed(spark, store):
    table = generate_customers(spark, 3).withColumns({c: F.concat(F.lit("hex_"), F.lower(F.hex(F.encode(c, "utf-8")))) for c in PII.columns})
    limits = CallLimits(read_seconds=0.1)
    tokens = distinct_cells(table, PII).withColumnRenamed("value", "token")
    status = assign.read_status(tokens, Slow, limits=limits, attempts=1)
    assert {r.status for r in status.collect()} == {"failed"}


def test_empty(spark, key, store, names):
    nobody = generate_customers(spark, 5).limit(0)
    report, done = publish.publish_via_client(nobody, PII, key, lambda: HmacClient(SECRET), *names)
    assert (report.n_rows, done.needed, done.waves) == (0, 0, 0)
    shown, status = detokenize_via_client(nobody, PII, HexClient, store, name="none")
    assert shown.count() == 0 and status_counts(status).count() == 0
