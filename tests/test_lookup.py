"""The three physical forms of the vault lookup give the same rows, also under heavy skew."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilspark.operators import tokenize as tok
from veilspark.operators.govern import create_governed_view, detokenize, detokenize_few, set_role
from veilspark.operators.lookup import LookupLimits, _size, measure
from veilspark.operators.vault import Vault, build_vault, find_tokens
from veilspark.spec import PiiSpec, Policy

SPEC = PiiSpec(("name", "city"), ("id",))
ALL_SHUFFLED = LookupLimits(broadcast_bytes=0, hot_cells=100)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the names are one value, a third of the cities NULL, a sixth blank."""
    i = F.col("id")
    return spark.range(6000).select(
        "id",
        F.when(i % 3 == 0, "Jonathan").otherwise(F.concat(F.lit("n"), i.cast("string"))).alias("name"),
        F.when(i % 3 == 1, F.lit(None)).when(i % 6 == 2, "  ").otherwise(F.concat(F.lit("c"), (i % 500).cast("string"))).alias("city"),
        (i * 2).alias("other"),
    )


@pytest.fixture(scope="module")
def stored(spark, skewed, key):
    from veilspark.sources.store import RunStore

    store = RunStore(spark)
    vault = store.write(build_vault(skewed, SPEC, key), "vault", partition_by=("column_name",))
    return store.write(tok.tokenize(skewed, SPEC, key), "table"), vault


@pytest.fixture
def no_auto_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("limits", [LookupLimits(), ALL_SHUFFLED, LookupLimits(0, 10**9)])
def test_every_form_reads_back_the_table(skewed, stored, no_auto_broadcast, limits, unique):
    table, frame = stored
    back = detokenize(table, SPEC, Vault.open(frame, limits, unique))
    assert back.columns == skewed.columns
    assert rows(back) == rows(skewed)


@pytest.mark.parametrize("limits", [LookupLimits(), ALL_SHUFFLED])
def test_tokens_are_found_by_value(skewed, stored, key, no_auto_broadcast, limits):
    found = find_tokens(skewed, SPEC.columns, Vault.open(stored[1], limits), SPEC.key)
    wanted = tok.with_tokens(skewed, SPEC, key)
    assert rows(found.select(*wanted.columns)) == rows(wanted)


def test_hot_values_are_measured(stored):
    slices = measure(stored[1], ALL_SHUFFLED)
    assert slices["name"].rows == 4001 and slices["name"].cells == 6000
    assert not slices["name"].broadcast and 100 <= slices["name"].hot_from <= 2000
    assert slices["city"].hot_from is None  # no city holds 1/4 of the cells
    assert measure(stored[1])["name"].broadcast


def test_hot_null_and_blank_rows_spread_over_all_partitions(stored, no_auto_broadcast, spark):
    table, frame = stored
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for column in SPEC.columns:
            back = detokenize(table, SPEC, Vault.open(frame, ALL_SHUFFLED), columns=[column])
            sizes = [r.n for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
            assert len(sizes) == 4 and max(sizes) < 2 * min(sizes), (column, sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("limits", [LookupLimits(), ALL_SHUFFLED])
def test_vault_duplicates_do_not_multiply_rows(spark, skewed, stored, no_auto_broadcast, limits):
    table, frame = stored
    twice = frame.unionByName(frame)
    assert rows(detokenize(table, SPEC, Vault.open(twice, limits))) == rows(skewed)


@pytest.mark.parametrize("limits", [LookupLimits(), ALL_SHUFFLED])
def test_view_joins_only_what_the_role_reads(spark, stored, limits):
    table, frame = stored
    policy = Policy.for_prefix("p")
    create_governed_view("seen", table, SPEC, Vault.open(frame, limits), policy)

    def joins(query):
        plan = spark.sql(query)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join ")

    per_lookup = 1 if limits.broadcast_bytes is None else 2
    set_role(spark, "P_AUDITOR")
    assert joins("SELECT id, other FROM seen") == 0
    assert joins("SELECT id, name FROM seen") == per_lookup
    assert joins("SELECT id FROM seen WHERE name = 'n7'") >= 1
    set_role(spark, "P_MARKETING")
    assert joins("SELECT * FROM seen") == 0
    set_role(spark, "NOBODY")
    assert joins("SELECT * FROM seen") == 0


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("limits", [LookupLimits(), ALL_SHUFFLED])
def test_unknown_tokens_stay_also_if_a_third_of_the_rows_has_one(skewed, stored, no_auto_broadcast, limits, unique):
    table, frame = stored
    lost = F.col("id") % 3 == 2
    broken = table.withColumn("name", F.when(lost, "lost").otherwise(F.col("name")))
    wanted = skewed.withColumn("name", F.when(lost, "lost").otherwise(F.col("name")))
    assert rows(detokenize(broken, SPEC, Vault.open(frame, limits, unique))) == rows(wanted)


def test_adaptive_skew_join_splits_a_hot_unknown_token(spark, stored, no_auto_broadcast):
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        table, frame = stored
        broken = table.repartition(8, "id").withColumn("name", F.when(F.col("id") % 3 < 2, "lost").otherwise(F.col("name")))
        back = detokenize(broken, SPEC, Vault.open(frame, ALL_SHUFFLED, unique=True), columns=["name"])
        assert back.filter("name = 'lost'").count() == 4000
        back.collect()
        assert "skew=true" in back._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in small:
            spark.conf.unset(name)


def test_few_rows_are_read_without_a_shuffle_of_the_vault(skewed, stored, store, no_auto_broadcast):
    table, frame = stored
    vault = Vault.open(frame, ALL_SHUFFLED)
    first = table.orderBy("id").limit(50)
    few = detokenize_few(first, 50, store, SPEC, vault)
    assert rows(few) == rows(skewed.filter("id < 50"))
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    many = detokenize_few(first, 10**6, store, SPEC, vault)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert rows(many) == rows(few)


def test_sizes():
    assert [_size(t) for t in ("10485760", "10485760b", "10m", "1g", "-1")] == [10485760, 10485760, 10 << 20, 1 << 30, -1]
