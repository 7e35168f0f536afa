"""A vault that grows: hot tokens of the last publish, buckets without a shuffle, a filter for unknown tokens."""

import re
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilspark.operators import heavy
from veilspark.operators import tokenize as tok
from veilspark.operators import vault as vaults
from veilspark.operators.govern import create_governed_view, detokenize, drop_governed_view, set_role
from veilspark.operators.lookup import LookupLimits, _has_bit, token_place
from veilspark.operators.vault import Vault, known_tokens_filter, with_filter_bits
from veilspark.plans import publish
from veilspark.sources.store import RunStore
from veilspark.spec import MASKED, PiiSpec, Policy

SPEC = PiiSpec(("name", "city"), ("id",))
LARGE = LookupLimits(broadcast_bytes=0, hot_cells=100)


def people(spark, n, hot):
    """`n` rows; nine of ten names are one value if `hot`."""
    i = F.col("id")
    name = F.when(F.lit(hot) & (i % 10 != 0), "Jonathan").otherwise(F.concat(F.lit("n"), i.cast("string")))
    city = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, " ").otherwise(F.concat(F.lit("c"), (i % 900).cast("string")))
    return spark.range(n).select("id", name.alias("name"), city.alias("city"), (i * 2).alias("other"))


@pytest.fixture(scope="module")
def grown(spark, key):
    """Published small, where the hot name is a single cell, then large."""
    store = RunStore(spark)
    table, vault = store.name("people"), store.name("vault")
    small = people(spark, 40, False).unionByName(people(spark, 10_002, True).where("id = 10001"))
    publish.tokenize_and_publish(small, SPEC, key, table, vault, buckets=4, limits=LARGE)
    publish.tokenize_and_publish(people(spark, 10_000, True), SPEC, key, table, vault, buckets=4, limits=LARGE)
    yield table, vault
    store.drop()


@pytest.fixture
def plain_joins(spark):
    """No broadcast that this package did not ask for, and plans as they were made."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield
    for name in conf:
        spark.conf.unset(name)


def sizes(df):
    return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_stale_and_the_summary_is_not(spark, grown, key):
    _, vault = grown
    hot_row = spark.table(vault).where("column_name = 'name' AND value = 'Jonathan'").first()
    stored = Vault.stored(spark, vault, LARGE)
    assert hot_row.n_cells == 1 and stored.unique and stored.bucketed
    assert [tuple(r) for r in stored.hot.collect()] == [("name", hot_row.token)]


@pytest.mark.parametrize("bucketed", [False, True])
def test_growth_reads_back_and_stays_even(spark, grown, plain_joins, bucketed):
    table, vault = grown
    stored = replace(Vault.stored(spark, vault, LARGE), bucketed=bucketed)
    df = spark.table(table)
    assert rows(detokenize(df, SPEC, stored)) == rows(people(spark, 10_000, True))
    found = sizes(detokenize(df, SPEC, stored, columns=["name"]))
    assert len(found) == 4 and found[-1] < 1.5 * found[0]
    stale = sizes(detokenize(df, SPEC, replace(stored, hot=None), columns=["name"]))
    assert stale[-1] > 0.9 * sum(stale)  # what the counts of the first publish lead to


def test_a_bucketed_vault_is_not_shuffled(spark, grown, plain_joins):
    table, vault = grown
    stored, df = Vault.stored(spark, vault, LARGE), spark.table(table)

    def shuffled(df):
        return re.findall(r"Exchange hashpartitioning\((?:coalesce\()?(\w+)#", plan(df))

    one = detokenize(df, SPEC, stored, columns=["name"])
    # The rows go to the buckets; besides, the short lists of hot tokens and of bitmaps are grouped.
    assert shuffled(one).count("__probe") == 1 and "token_hash" not in shuffled(one) and "__hash" not in shuffled(one)
    assert "Bucketed: true" in plan(one)
    both = shuffled(detokenize(df, SPEC, stored))
    # (id, token) of either column to the buckets, what is found by id and to its rows, and the rows once.
    assert [both.count(name) for name in ("__probe", "__k0", "id", "__hash", "token_hash")] == [2, 2, 1, 0, 0]
    plain = detokenize(df, SPEC, replace(stored, bucketed=False))
    assert [shuffled(plain).count(name) for name in ("__probe", "__hash")] == [2, 2] and "Bucketed: true" not in plan(plain)


def test_keys_that_are_not_unique_give_no_wrong_cell(spark, grown):
    table, vault = grown
    twice = spark.table(table).withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50))
    wanted = people(spark, 10_000, True).withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50))
    assert rows(detokenize(twice, SPEC, Vault.stored(spark, vault, LARGE))) == rows(wanted)


@pytest.mark.parametrize("role", ["P_AUDITOR", "P_CUSTOMER_SERVICE", "P_MARKETING", "NOBODY"])
def test_view_over_one_unknown_token_in_nine_of_ten_rows(spark, grown, plain_joins, role):
    table, vault = grown
    lost = F.col("id") % 10 != 0
    broken = spark.table(table).withColumn("name", F.when(lost, "lost").otherwise(F.col("name")))
    stored = Vault.stored(spark, vault, LARGE)
    create_governed_view("broken", broken, SPEC, stored, Policy.for_prefix("p"))
    create_governed_view("whole", spark.table(table), SPEC, replace(stored, known=None, hot=None, bucketed=False), Policy.for_prefix("p"))
    set_role(spark, role)
    seen = spark.table("broken")
    shown = "*REDACTED*" if role == "P_MARKETING" else "lost"
    assert rows(seen) == rows(spark.table("whole").withColumn("name", F.when(lost, shown).otherwise(F.col("name"))))
    if role in ("P_AUDITOR", "P_CUSTOMER_SERVICE"):
        found = sizes(seen.select("id", "name"))
        assert len(found) == 4 and found[-1] < 1.5 * found[0]
    drop_governed_view(spark, "broken")
    drop_governed_view(spark, "whole")


def test_filter_rules_out_no_token_of_the_vault(spark, key):
    vault = vaults.build_vault(people(spark, 5_000, False), SPEC, key)
    slices = with_filter_bits(vaults.measure(vault, LARGE))
    assert slices["name"].known_bits == 1 << 17 and with_filter_bits(vaults.measure(vault))["name"].known_bits == 0
    known = known_tokens_filter(vault, slices).where("column_name = 'name'")
    place = token_place(F.col("token"), slices["name"].known_bits)

    def passing(tokens):
        joined = tokens.join(known, F.bitmap_bucket_number(place) == F.col("bucket"), "left")
        return joined.where(_has_bit(F.col("bits"), F.bitmap_bit_position(place))).count()

    assert passing(vault.where("column_name = 'name'").select("token")) == 5_000
    assert passing(spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("token"))) < 1_200


def test_filter_grows_with_the_vault(spark, grown):
    _, vault = grown
    stored = Vault.stored(spark, vault, LARGE)
    kept = stored.known.drop("publish_no")
    assert rows(kept, "column_name", "n_bits", "bucket", "bits") == rows(known_tokens_filter(spark.table(vault), stored.slices), "column_name", "n_bits", "bucket", "bits")
    assert spark.table(vaults.known_table(vault)).select("publish_no").distinct().count() == 2


def test_summaries_of_two_tables_merge(spark):
    one = heavy.summarize(people(spark, 1_000, True), SPEC)
    two = heavy.summarize(spark.range(3_000).select("id", F.lit("x").alias("name"), F.lit("").alias("city")), SPEC)
    found = heavy.hot_tokens(heavy.merge(one.unionByName(two)), 0.1, 1)
    assert rows(found) == [("name", "Jonathan", 900), ("name", "x", 3_000)]
    assert rows(heavy.hot_tokens(one.limit(0), 0.1, 1)) == [] and rows(heavy.hot_tokens(heavy.summarize(people(spark, 0, True), SPEC), 0.1, 1)) == []


def test_two_publishers_at_once_are_noticed(spark, key, monkeypatch):
    store = RunStore(spark)
    table, other = store.name("vault"), people(spark, 30, False)
    publish.publish_vault(other, SPEC, key, table)
    more = store.write(vaults.build_vault(people(spark, 60, False).where("id >= 30"), SPEC, key), "more")
    check = publish.addition_conflicts

    def check_and_let_another_in(added, known):
        assert check(added, known).isEmpty()
        more.write.mode("append").format("parquet").partitionBy("column_name").saveAsTable(table)
        return added.limit(0)

    monkeypatch.setattr(publish, "addition_conflicts", check_and_let_another_in)
    publish.append_to_vault(more, table)
    vault = Vault.stored(spark, table)
    assert not vault.unique
    tokenized = tok.tokenize(people(spark, 60, False), SPEC, key)
    large = replace(vault, slices={c: replace(s, broadcast=False) for c, s in vault.slices.items()})
    assert rows(detokenize(tokenized, SPEC, large, MASKED)) == rows(detokenize(tokenized, SPEC, vault, MASKED))
    assert detokenize(tokenized, SPEC, large).count() == 60
    store.drop()
