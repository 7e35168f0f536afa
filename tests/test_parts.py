"""Tables that are changed or read in part: merged parts, indexed pages, the content check of a publish, the audit of a view."""

import uuid
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilspark.functions.masking import mask
from veilspark.operators import tokenize as tok
from veilspark.operators.audit import audit_view
from veilspark.operators.govern import create_governed_view
from veilspark.operators.merge import PART, merge_parts, upsert, write_parts
from veilspark.operators.paging import indexed_page, write_page_index
from veilspark.operators.vault import Vault, build_vault
from veilspark.plans import publish
from veilspark.sources.customers import CUSTOMER_PII, generate_customers
from veilspark.spec import PiiSpec, Policy

SPEC = PiiSpec(("name", "city"), ("id",))


def files(spark, table):
    return {f"{Path(f).parent.name}/{Path(f).name}" for f in spark.table(table).inputFiles()}


def test_merge_rewrites_only_touched_parts(spark, store):
    target = spark.range(200).select("id", F.concat(F.lit("a"), "id").alias("x"), F.lit("kept").alias("y"))
    source = spark.createDataFrame([(3, "new"), (77, None), (1_000, "added")], "id long, x string")
    name = store.name("parts")
    write_parts(target, name, ["id"], 16)
    before = files(spark, name)
    touched = merge_parts(name, source, ["id"], ["x"], 16)
    after = files(spark, name)
    assert rows(spark.table(name).drop(PART), "id", "x", "y") == rows(upsert(target, source, ["id"], ["x"]))
    assert 1 <= len(touched) <= 3 and len(before & after) == len(before) - len(touched) > 8
    read = spark.table(name).filter(F.col(PART).isin(touched)).inputFiles()
    assert len(read) == len(touched)
    assert merge_parts(name, source.limit(0), ["id"], ["x"], 16) == [] and files(spark, name) == after
    assert merge_parts(name, source, ["id"], ["x"], 16) == touched
    assert rows(spark.table(name).drop(PART), "id", "x", "y") == rows(upsert(target, source, ["id"], ["x"]))


@pytest.mark.parametrize("hot", [False, True])
def test_pages_at_any_offset_read_two_files_at_most(spark, store, hot):
    key = F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")) if hot else (F.col("id") * 37) % 1000
    df = spark.range(1000).select(key.alias("k"), F.col("id").alias("other"))
    name = store.name(f"pages{hot}".lower())
    write_page_index(df, "k", name, rows_per_file=100)
    assert spark.table(f"{name}__ranges").count() >= 8
    ordered = sorted((r.k, r.other) for r in df.collect())
    for offset in (0, 1, 95, 500, 990, 2000):
        page = indexed_page(spark, name, "k", offset, 20)
        assert [tuple(r) for r in page.collect()] == ordered[offset : offset + 20]
        assert len(page.inputFiles()) <= 2


def test_page_index_of_an_empty_table(spark, store):
    name = store.name("nothing")
    write_page_index(spark.range(0).select(F.col("id").alias("k")), "k", name)
    assert indexed_page(spark, name, "k", 0, 5).count() == 0


def test_swapped_cells_of_other_columns_fail_a_publish(spark, key, store, monkeypatch):
    table, source = store.name("people"), generate_customers(spark, 50)
    real = tok.tokenize

    def swapped(df, spec, k):
        a, b = F.col("customer_id") == "CUST00007", F.col("customer_id") == "CUST00008"
        turned = F.when(F.col("preferred_language") == "English", "Spanish").otherwise("English")  # the two have different ones
        return real(df, spec, k).withColumn("preferred_language", F.when(a | b, turned).otherwise(F.col("preferred_language")))

    monkeypatch.setattr(publish, "tokenize", swapped)
    with pytest.raises(publish.PublishError, match="preferred_language__content"):
        publish.tokenize_and_publish(source, CUSTOMER_PII, key, table, store.name("vault"))
    assert publish.versions(spark, table) == []


def test_retired_versions_are_gone(spark, key, store):
    table = store.name("retired")
    plain = publish.write_version(generate_customers(spark, 20), table)
    publish.point_view(spark, table, plain)
    report = publish.tokenize_and_publish(spark.table(table), CUSTOMER_PII, key, table, store.name("retired_vault"), retire=True)
    assert publish.versions(spark, table) == [report.version] and spark.table(table).count() == 20


@pytest.fixture(scope="module")
def people(spark, key):
    from veilspark.sources.store import RunStore

    store = RunStore(spark)
    i = F.col("id")
    source = spark.range(300).select("id", F.when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("name"), i % 40)).alias("name"), F.when(i % 5 == 0, " ").otherwise(F.concat("id", F.lit("@x.org"))).alias("city"))
    return store.write(tok.tokenize(source, SPEC, key), "people"), store.write(build_vault(source, SPEC, key), "vault"), store


def opened(store, policy, change=None):
    """A view of the table in any session, by the rule `change` makes of the right one."""

    def open_view(session):
        name = f"seen_{uuid.uuid4().hex[:8]}"
        table = session.table(store.name("people"))
        create_governed_view(name, table, SPEC, Vault.open(session.table(store.name("vault"))), policy)
        view = session.table(name)
        return change(session, view) if change else view

    return open_view


def wrong(audit):
    return {(r.role, r.column_name) for r in audit.where("NOT matches").collect()}


def test_audit_of_a_right_view(spark, people):
    table, vault, store = people
    policy = Policy.for_prefix("p")
    found = audit_view(spark, opened(store, policy), table, SPEC, vault, policy)
    assert found.count() == 10 and wrong(found) == set()
    assert {r.n_cells for r in found.collect()} == {300}


def test_audit_reports_what_a_wrong_view_shows(spark, people):
    table, vault, store = people
    policy = Policy.for_prefix("p")
    masked = Policy.for_prefix("p", masked="auditor", plain="customer_service")  # the CASE has its branches swapped
    roles = {("P_AUDITOR", "name"), ("P_AUDITOR", "city"), ("P_CUSTOMER_SERVICE", "name"), ("P_CUSTOMER_SERVICE", "city")}
    assert wrong(audit_view(spark, opened(store, masked), table, SPEC, vault, policy)) == roles

    def leaks_one(session, view):
        return view.withColumn("city", F.when((F.col("id") == 3) & F.expr("access_role = 'P_MARKETING'"), "3@x.org").otherwise(F.col("city")))

    assert wrong(audit_view(spark, opened(store, policy, leaks_one), table, SPEC, vault, policy)) == {("P_MARKETING", "city")}

    def loses_rows(session, view):
        return view.where("id <> 5")

    assert len(wrong(audit_view(spark, opened(store, policy, loses_rows), table, SPEC, vault, policy))) == 10


def test_expected_mask_is_the_rule_of_the_library(spark):
    from veilspark.operators.audit import _expected

    values = [("a",), ("",), ("abc",), ("abcd",), ("Jonathan",), ("j@x.org",), ("@x.org",), ("a@b@c.d",), (None,)]
    df = spark.createDataFrame(values, "value string")
    both = df.select(mask(F.col("value")).alias("a"), _expected("MASKED", F.lit(None).cast("string"), F.col("value"), "token").alias("b"))
    assert all(r.a == r.b for r in both.collect())
