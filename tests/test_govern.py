import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilspark.functions.masking import mask, mask_sql
from veilspark.operators import audit, govern
from veilspark.operators import tokenize as tok
from veilspark.operators.vault import Vault, build_vault
from veilspark.sources.customers import CUSTOMER_PII, generate_customers
from veilspark.sources.store import RunStore
from veilspark.spec import MASKED, PLAIN_TEXT, REDACTED, Policy

POLICY = Policy.for_prefix("demo")


@pytest.fixture(scope="module")
def source(spark):
    return generate_customers(spark, 50)


@pytest.fixture(scope="module")
def world(spark, source, key):
    store = RunStore(spark)
    table = store.write(tok.tokenize(source, CUSTOMER_PII, key), "table")
    vault = Vault.open(store.write(build_vault(source, CUSTOMER_PII, key), "vault"))
    govern.create_governed_view("customers", table, CUSTOMER_PII, vault, POLICY)
    govern.register_functions(spark, vault, POLICY)
    return table, vault


QUERY = "SELECT first_name, email FROM customers WHERE customer_id = 'CUST00001'"


def seen_as(spark, role, query=QUERY):
    govern.set_role(spark, role)
    return tuple(spark.sql(query).first())


def test_what_each_role_sees(spark, world):
    assert seen_as(spark, "DEMO_AUDITOR") == ("Jonathan", "jonathan.anderson@example.com")
    assert seen_as(spark, "SYSADMIN") == ("Jonathan", "jonathan.anderson@example.com")
    assert seen_as(spark, "DEMO_CUSTOMER_SERVICE") == ("J***an", "j***@example.com")
    assert seen_as(spark, "DEMO_MARKETING") == ("*REDACTED*", "*REDACTED*")
    for role in ("PUBLIC", "demo_auditor", ""):
        assert all(v.startswith("tok_") for v in seen_as(spark, role))


def test_role_names_are_data_not_sql(spark, world):
    assert all(v.startswith("tok_") for v in seen_as(spark, "x' OR '1'='1"))


def test_role_is_fixed_when_the_query_is_analyzed(spark, world):
    govern.set_role(spark, "DEMO_AUDITOR")
    held = spark.sql(QUERY)
    govern.set_role(spark, "PUBLIC")
    assert held.first().first_name == "Jonathan"


def test_view_equals_dataframe_form_for_every_role(spark, world):
    table, vault = world
    for role in [*POLICY.roles, "PUBLIC"]:
        govern.set_role(spark, role)
        assert rows(spark.table("customers")) == rows(govern.govern(table, CUSTOMER_PII, vault, POLICY, role)), role


def test_dropping_the_view_leaves_the_table(spark, world):
    table, vault = world
    govern.create_governed_view("short_lived", table, CUSTOMER_PII, vault, POLICY)
    govern.drop_governed_view(spark, "short_lived")
    assert not spark.catalog.tableExists("short_lived")
    assert table.count() == 50


def test_filter_and_group_use_the_governed_value(spark, world):
    assert seen_as(spark, "DEMO_AUDITOR", "SELECT count(*) FROM customers WHERE first_name = 'Jonathan'") == (13,)
    assert seen_as(spark, "DEMO_MARKETING", "SELECT count(*) FROM customers WHERE first_name = 'Jonathan'") == (0,)
    govern.set_role(spark, "DEMO_MARKETING")
    assert spark.sql("SELECT first_name FROM customers GROUP BY first_name").count() == 1


def test_sql_functions(spark, world):
    world[0].createOrReplaceTempView("stored")
    where = "FROM stored WHERE customer_id = 'CUST00001'"
    assert seen_as(spark, "PUBLIC", f"SELECT detokenize(first_name) {where}") == ("Jonathan",)
    assert seen_as(spark, "PUBLIC", f"SELECT detokenize(first_name, 'MASKED', 'me') {where}") == ("J***an",)
    assert seen_as(spark, "PUBLIC", f"SELECT detokenize(first_name, 'REDACTED') {where}") == ("*REDACTED*",)
    for mode in (PLAIN_TEXT, MASKED, REDACTED):
        assert seen_as(spark, "PUBLIC", f"SELECT detokenize('no such token', '{mode}')") == ("no such token",)
        assert seen_as(spark, "PUBLIC", f"SELECT detokenize(NULL, '{mode}'), detokenize(' \\t', '{mode}')") == (None, " \t")
    assert seen_as(spark, "DEMO_CUSTOMER_SERVICE", f"SELECT conditional_detokenize(email) {where}") == ("j***@example.com",)
    assert seen_as(spark, "DEMO_AUDITOR", f"SELECT mask_detokenize(first_name) {where}") == ("Jonathan",)
    assert seen_as(spark, "PUBLIC", f"SELECT mask_detokenize(first_name) {where}")[0].startswith("tok_")


def test_unknown_modes_fail(spark, world):
    table, vault = world
    with pytest.raises(ValueError, match="unknown redaction mode"):
        govern.detokenize(table, CUSTOMER_PII, vault, "PLAIN")
    with pytest.raises(Exception, match="unknown redaction mode"):
        govern.detokenize(table, CUSTOMER_PII, vault, F.lit("PLAIN")).collect()
    with pytest.raises(Exception, match="unknown redaction mode"):
        spark.sql("SELECT detokenize('x', 'PLAIN')").collect()


def test_unknown_tokens(spark, world):
    table, vault = world
    lost = table.withColumn("email", F.lit("lost"))
    for mode in (PLAIN_TEXT, MASKED, REDACTED):
        seen = govern.detokenize(lost, CUSTOMER_PII, vault, mode, ["email"])
        assert {r.email for r in seen.collect()} == {"lost"}
    hidden = govern.govern(lost, CUSTOMER_PII, vault, POLICY, "DEMO_MARKETING")
    assert {r.email for r in hidden.collect()} == {"*REDACTED*"}


@pytest.mark.parametrize(
    "value, masked",
    [
        ("Jonathan", "J***an"),
        ("jonathan@example.com", "j***@example.com"),
        ("a", "*"),
        ("abc", "***"),
        ("abcd", "a***cd"),
        ("@x", "**"),
        ("a@b", "a***@b"),
        ("São Paulo", "S***lo"),
        ("", ""),
        (None, None),
    ],
)
def test_mask(spark, value, masked):
    df = spark.createDataFrame([(value,)], "v string")
    assert tuple(df.select(mask(F.col("v")), F.expr(mask_sql("v"))).first()) == (masked, masked)


def test_access_matrix_and_violations(spark, world):
    table, vault = world
    matrix = audit.access_matrix(table, CUSTOMER_PII, vault.frame, POLICY)
    by_role = {(r.role, r.column_name): r for r in matrix.collect()}
    assert len(by_role) == 5 * 6
    assert by_role["DEMO_AUDITOR", "email"].n_plain == 50
    assert by_role["DEMO_CUSTOMER_SERVICE", "email"].n_masked == 50
    assert by_role["DEMO_MARKETING", "email"].n_redacted == 50
    assert by_role["PUBLIC", "email"].n_token == 50
    assert audit.access_violations(matrix).count() == 0
    leaky = matrix.withColumn("mode", F.lit("TOKEN"))
    assert audit.access_violations(leaky).count() > 0
    lost = audit.access_matrix(table, CUSTOMER_PII, vault.frame.where("column_name <> 'email'"), POLICY)
    seen = {(r.role, r.column_name, r.n_token) for r in audit.access_violations(lost).collect()}
    assert ("DEMO_AUDITOR", "email", 50) in seen and {c for _, c, _ in seen} == {"email"}


def test_status_and_report(spark, world, source):
    table, vault = world
    assert rows(audit.tokenization_status(table, CUSTOMER_PII, vault.frame)) == [("Tokenization Complete", 50)]
    part = table.limit(49).unionByName(source.limit(1))
    assert rows(audit.tokenization_status(part, CUSTOMER_PII, vault.frame)) == [("Tokenization Incomplete", 50)]
    report = audit.table_report(spark, ["customers", "nowhere"])
    assert rows(report) == [("customers", True, 50), ("nowhere", False, 0)]
