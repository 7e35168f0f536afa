import hashlib
import hmac
import io
from contextlib import redirect_stdout

import pytest
from conftest import SECRET, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.cells import READ_BLANKS, has_pii, readable
from veilspark.functions.tokens import TokenKey, padded_key
from veilspark.operators import tokenize as tok
from veilspark.operators.govern import detokenize, register_functions
from veilspark.operators.merge import upsert
from veilspark.operators.vault import (
    Vault,
    addition_conflicts,
    build_vault,
    count_uses,
    refresh_vault,
    shared_tokens,
    unresolved,
    vault_additions,
    vault_duplicates,
)
from veilspark.spec import PiiSpec, Policy

SPEC = PiiSpec(("name", "note"), ("id",))
SCHEMA = "id bigint, name string, note string, other double"
DATA = [
    (1, "Jonathan", "a", 1.0),
    (2, None, "", 2.0),
    (3, "Jonathan", "  ", 3.0),
    (4, "\t", "São Paulo", 4.0),
    (5, "a", "Jonathan", 5.0),
    (6, None, None, 6.0),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def plan_of(df, mode="formatted"):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def python_token(column, value):
    return "tok_" + hmac.new(SECRET, f"{column}|{value}".encode(), hashlib.sha256).hexdigest()


def expected(column, value):
    return value if value is None or value.strip(" ") == "" else python_token(column, value)


def test_tokens_equal_python_hmac(people, key):
    got = {r.id: r for r in tok.tokenize(people, SPEC, key).collect()}
    for id_, name, note, other in DATA:
        assert (got[id_].name, got[id_].note, got[id_].other) == (expected("name", name), expected("note", note), other)


def test_long_secret_is_hashed_first(spark, people):
    secret = b"x" * 100
    key = TokenKey.from_secret(spark, secret)
    got = tok.tokenize(people, SPEC, key).filter("id = 1").first().name
    assert got == "tok_" + hmac.new(secret, b"name|Jonathan", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        TokenKey.from_secret(spark, b"")


def test_tokenize_keeps_column_order_and_has_no_shuffle(people, key):
    df = tok.tokenize(people, SPEC, key)
    assert df.columns == people.columns
    assert "Exchange" not in plan_of(df)


def test_key_is_in_no_plan(people, key):
    df = tok.tokenize(people, SPEC, key)
    before = plan_of(df, "extended")
    df.collect()
    after = df._jdf.queryExecution().toString()
    for text in (before, after):
        for block in padded_key(SECRET):
            assert block.hex() not in text.lower() and str(list(block))[1:20] not in text
        assert SECRET.decode() not in text


def test_tab_cell_is_tokenized_and_read_back(spark, people, key, store):
    vault = Vault.open(store.write(build_vault(people, SPEC, key), "vault"))
    back = detokenize(tok.tokenize(people, SPEC, key), SPEC, vault)
    assert rows(back) == rows(people)


def test_read_blanks_follow_python_strip(spark):
    cells = [c * 2 for c in READ_BLANKS] + ["", " x", "　y", "é", "~", "\x7f"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for cell, seen in df.select("c", readable(F.col("c"))).collect():
        assert seen == (cell.strip() != ""), repr(cell)


def test_has_pii(people):
    assert [r.id for r in people.filter(has_pii(SPEC)).orderBy("id").collect()] == [1, 2, 3, 4, 5]


def test_non_string_columns_are_tokenized_as_text(spark, key):
    df = spark.createDataFrame([(1, 42, 1.5), (2, None, None)], "id int, user bigint, score double")
    got = tok.tokenize(df, PiiSpec(("user", "score"), ("id",)), key).orderBy("id").collect()
    assert got[0].user == python_token("user", "42") and got[0].score == python_token("score", "1.5")
    assert got[1].user is None and got[1].score is None


def test_staging_merge_equals_direct_tokenizing(people, key):
    staging = tok.token_staging(people, SPEC, key, rn="id")
    assert staging.columns == ["id", "name_token", "note_token"]
    merged = tok.merge_staging(people, SPEC, staging, "id")
    assert merged.columns == people.columns
    assert rows(merged) == rows(tok.tokenize(people, SPEC, key))


def test_mock_tokens_are_kept_on_a_second_run(people):
    once = tok.mock_tokens(people, SPEC)
    again = tok.mock_tokens(once, SPEC, seed=9)
    assert rows(again) == rows(once)
    first = once.filter("id = 1").first()
    digest = hashlib.md5(b"Jonathan|1|0").hexdigest()[:16]
    assert first.name_token == f"TOKEN_{digest}"
    assert once.filter("id = 6").first().name_token is None
    assert rows(tok.mock_tokens(people, SPEC, seed=1), "name_token") != rows(once, "name_token")


def test_refresh_twice_adds_nothing(people, key):
    first = build_vault(people.filter("id < 3"), SPEC, key)
    full = refresh_vault(people, SPEC, key, first)
    assert vault_additions(people, SPEC, key, full).count() == 0
    assert rows(full, "column_name", "token", "value") == rows(
        build_vault(people, SPEC, key), "column_name", "token", "value"
    )


def test_conflicts_are_found_before_an_append(spark, people, key):
    vault = build_vault(people, SPEC, key)
    token = vault.filter("column_name = 'name'").first()["token"]
    assert addition_conflicts(vault, None).count() == 0
    new = spark.createDataFrame([("name", token, "someone else", 1)], vault.schema)
    assert rows(addition_conflicts(new, vault)) == [("name", "token", token, 2)]
    other = spark.createDataFrame([("city", token, "elsewhere", 1)], vault.schema)
    assert addition_conflicts(other, vault).count() == 0 and rows(shared_tokens(vault.unionByName(other))) == [(token,)]
    with pytest.raises(ValueError, match="several values"):
        register_functions(spark, Vault.open(vault.unionByName(other)), Policy.for_prefix("demo"), "clash_")


def test_unmeasured_column_is_not_broadcast(people, key):
    assert not Vault(build_vault(people, SPEC, key), {}).size("name").broadcast


def test_vault_counts_and_duplicates(spark, people, key):
    vault = build_vault(people, SPEC, key)
    assert {(r.column_name, r.value): r.n_cells for r in vault.collect()}[("name", "Jonathan")] == 2
    assert vault_duplicates(vault).count() == 0
    extra = spark.createDataFrame([("name", "t1", "a", 1), ("name", "t1", "zz", 1)], vault.schema)
    assert rows(vault_duplicates(vault.unionByName(extra))) == [("name", "token", "t1", 2), ("name", "value", "a", 2)]
    tokenized = tok.tokenize(people, SPEC, key)
    assert rows(count_uses(vault, tokenized, SPEC)) == rows(vault)


def test_unresolved_tokens(people, key):
    vault = build_vault(people.filter("name IS NULL OR name != 'Jonathan'"), SPEC, key)
    lost = unresolved(tok.tokenize(people, SPEC, key), SPEC, vault)
    assert rows(lost, "column_name", "n_cells") == [("name", 2), ("note", 1)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, t string, u string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "id int, t string")
    assert rows(upsert(target, source, ["id"], ["t"])) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]


cell = st.one_of(st.none(), st.sampled_from(["", " ", "  ", "\t"]), st.text(max_size=6).filter(lambda s: "\x00" not in s))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(table=st.lists(st.tuples(cell, cell), min_size=1, max_size=30))
def test_round_trip_and_equality(spark, key, table):
    encodable = [tuple(None if c is None else c.encode("utf-8", "ignore").decode() for c in r) for r in table]
    df = spark.createDataFrame([(i, *r, 0.0) for i, r in enumerate(encodable)], SCHEMA)
    tokenized = tok.tokenize(df, SPEC, key)
    vault = Vault.open(build_vault(df, SPEC, key))
    assert rows(detokenize(tokenized, SPEC, vault)) == rows(df)
    plain = {r.id: r for r in df.collect()}
    tokens = {r.id: r for r in tokenized.collect()}
    for c in SPEC.columns:
        pairs = {(plain[i][c], tokens[i][c]) for i in plain}
        assert len(pairs) == len({p for p, _ in pairs}) == len({t for _, t in pairs})
