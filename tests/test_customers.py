import pytest
from conftest import rows

from veilspark.operators.audit import tokenization_summary
from veilspark.operators.vault import distinct_cells
from veilspark.sources.customers import CUSTOMER_PII, CUSTOMER_SCHEMA, customer_profile, generate_customers, insert_typed, typed
from veilspark.spec import PLAIN_TEXT, PiiSpec, Policy


def test_first_generated_customer(spark):
    first = generate_customers(spark, 50).orderBy("customer_id").first()
    assert first.customer_id == "CUST00001"
    assert (first.first_name, first.last_name) == ("Jonathan", "Anderson")
    assert first.email == "jonathan.anderson@example.com"
    assert (first.phone_number, first.date_of_birth) == ("+1-555-0100", "1985-03-15")
    assert (str(first.signup_date), str(first.last_login)) == ("2018-01-01 00:00:00", "2023-01-01 00:00:00")
    assert (first.total_purchases, str(first.total_spent)) == (5, "50.00")
    assert first.consent_marketing and first.consent_data_sharing


def test_generated_schema_is_the_declared_one(spark):
    df = generate_customers(spark, 5)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CUSTOMER_SCHEMA]


def test_fifty_rows_need_300_tokens_in_12_batches(spark):
    df = generate_customers(spark, 50)
    assert rows(tokenization_summary(df, CUSTOMER_PII, 25)) == [(300, 12, 50)]
    assert distinct_cells(df, CUSTOMER_PII).count() == 42


def test_ids_and_money_survive_large_numbers(spark):
    df = generate_customers(spark, 2_100_000)
    assert df.select("customer_id").distinct().count() == 2_100_000
    assert str(df.agg({"total_spent": "max"}).first()[0]) == "105000000.00"


def test_typed_insert(spark):
    rows_in = generate_customers(spark, 7)
    insert_typed(rows_in, "typed_customers")
    insert_typed(rows_in, "typed_customers")
    stored = spark.table("typed_customers")
    assert stored.count() == 14
    assert [f.dataType for f in stored.schema] == [f.dataType for f in CUSTOMER_SCHEMA]
    with pytest.raises(ValueError, match="email"):
        typed(rows_in.drop("email"))


def test_policy_and_spec_reject_mistakes():
    with pytest.raises(ValueError, match="unknown redaction mode"):
        Policy({"A": "PLAIN"})
    with pytest.raises(ValueError, match="role names"):
        Policy({"x' OR 'a": PLAIN_TEXT})
    with pytest.raises(ValueError, match="cannot be protected"):
        PiiSpec(("a",), ("a",))
    assert Policy.for_prefix("demo").roles_with(PLAIN_TEXT) == ["DEMO_AUDITOR", "SYSADMIN"]


def test_long_keys_are_not_cut(spark):
    keys = [7, 99_999_999, 100_000_001, 100_000_002, 1_000_000_010, 999_999_999_999]
    customer = spark.createDataFrame([(k,) for k in keys], "c_custkey long")
    orders = spark.createDataFrame([], "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    found = {r.customer_id for r in customer_profile(customer, orders).collect()}
    assert found == {f"CUST{k:08d}" for k in keys}


def test_generated_dates_start_over(spark):
    made = generate_customers(spark, 2_000_001, partitions=4).where("customer_id IN ('CUST0000001', 'CUST2000001')")
    assert made.select("signup_date").distinct().count() == 1
