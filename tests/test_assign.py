import json
import sys

import pytest
from conftest import SECRET, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entry_clients import HexClient, HmacClient
from veilspark.functions.replies import token_in_reply, token_of_record
from veilspark.operators import assign
from veilspark.operators import tokenize as tok
from veilspark.operators.vault import distinct_cells
from veilspark.sources.customers import CUSTOMER_PII, generate_customers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CASES = [
    ({"tokens": {"email": "T"}, "token": "other"}, "T"),
    ({"tokens": {"phone": "x"}, "fields": {"email": "T"}}, "T"),
    ({"fields": {}, "token": "T", "email": "other"}, "T"),
    ({"email": "T"}, "T"),
    ({"tokens": {"email": ""}, "token": "T"}, None),
    ({"tokens": {"email": None}, "token": "T"}, None),
    ({"phone": "T"}, None),
    ({}, None),
]


def test_reply_shapes(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)], "i int, reply string")
    got = {r.i: r.t for r in df.select("i", token_in_reply(F.col("reply"), "email").alias("t")).collect()}
    for i, (record, token) in enumerate(CASES):
        assert got[i] == token_of_record(record, "email") == token, record


@pytest.fixture(scope="module")
def source(spark):
    return generate_customers(spark, 50)


class Failing(HmacClient):
    """Variants of bad replies, by name."""

    def __init__(self, how):
        super().__init__(SECRET)
        self.how, self.calls = how, 0

    def insert(self, column, values, request_ids):
        self.calls += 1
        records = super().insert(column, values, request_ids)
        if self.how == "short":
            return records[:-1]
        if self.how == "long":
            return [*records, {"token": "surplus"}]
        if self.how == "none":
            return None
        if self.how == "empty":
            return [{"token": ""} for _ in records]
        if self.how == "flaky" and self.calls == 1:
            raise OSError("connection reset")
        if self.how == "down":
            raise OSError("connection refused")
        return records


def assigned(source, key, how, **options):
    cells = distinct_cells(source, CUSTOMER_PII)
    return assign.assign_tokens(cells, key, lambda: Failing(how), backoff=0.01, **options)


@pytest.mark.parametrize("how", ["ok", "long", "flaky"])
def test_good_replies(source, key, how):
    out = assigned(source, key, how).collect()
    assert len(out) == 42 and all(r.token.startswith("tok_") for r in out)


@pytest.mark.parametrize(
    "how, message", [("short", "received"), ("none", "0 received"), ("empty", "without a token"), ("down", "refused")]
)
def test_bad_replies_fail_the_job(source, key, how, message):
    with pytest.raises(Exception, match=message):
        assigned(source, key, how).collect()


def test_batches_are_full_and_of_one_column(source, key):
    class Counting(HmacClient):
        def __init__(self):
            super().__init__(SECRET)

        def insert(self, column, values, request_ids):
            assert len(values) <= 4 and len(set(request_ids)) == len(values)
            return [{"token": f"{column}:{len(values)}:{v}"} for v in values]

    cells = distinct_cells(source, CUSTOMER_PII)
    out = assign.assign_tokens(cells, key, Counting, batch_size=4, connections=1).collect()
    sizes = {}
    for r in out:
        column, size, _ = r.token.split(":", 2)
        assert column == r.column_name
        sizes.setdefault(column, []).append(int(size))
    assert sorted(sizes["email"]) == [4] * 4
    assert sorted(sizes["address"]) == [2, 2] + [4] * 8


def test_vault_assigned_equals_keyed_tokens(source, key, store):
    table, vault = assign.tokenize_via_vault(source, CUSTOMER_PII, key, lambda: HmacClient(SECRET), store)
    assert table.columns == source.columns
    assert rows(table) == rows(tok.tokenize(source, CUSTOMER_PII, key))
    assert vault.frame.count() == 42


def test_known_values_are_not_sent_again(source, key, store):
    _, first = assign.tokenize_via_vault(source.limit(1), CUSTOMER_PII, key, lambda: HmacClient(SECRET), store, name="a")

    class Strict(HmacClient):
        def __init__(self):
            super().__init__(SECRET)

        def insert(self, column, values, request_ids):
            assert "Jonathan" not in values
            return super().insert(column, values, request_ids)

    table, vault = assign.tokenize_via_vault(source, CUSTOMER_PII, key, Strict, store, known=first.frame, name="b")
    assert rows(table) == rows(tok.tokenize(source, CUSTOMER_PII, key))
    assert vault.frame.count() == 42


def test_values_are_read_back_in_batches(source, key, store):
    cells = distinct_cells(source, CUSTOMER_PII)
    sent = store.write(assign.assign_tokens(cells, key, HexClient), "sent")
    assert rows(assign.read_values(sent, HexClient)) == rows(sent)


def test_failed_reads_leave_no_value(source, key, store):
    class Down(HexClient):
        def detokenize(self, tokens, redaction):
            raise OSError("timeout")

    cells = distinct_cells(source, CUSTOMER_PII)
    sent = store.write(assign.assign_tokens(cells, key, HexClient), "sent")
    assert assign.read_values(sent, Down, backoff=0.01).count() == 0
    assert assign.read_values(sent.withColumn("token", F.lit("odd")), HexClient).count() == 0


def test_errors_other_than_transport_fail_a_read(source, key, store):
    class Denied(HexClient):
        def detokenize(self, tokens, redaction):
            raise PermissionError("denied")

    class Short(HexClient):
        def detokenize(self, tokens, redaction):
            return super().detokenize(tokens, redaction)[:-1]

    cells = distinct_cells(source, CUSTOMER_PII)
    sent = store.write(assign.assign_tokens(cells, key, HexClient), "sent")
    for client, message in ((Denied, "denied"), (Short, "received")):
        with pytest.raises(Exception, match=message):
            assign.read_values(sent, client, backoff=0.01).collect()
