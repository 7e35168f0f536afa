import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspark.operators import numbering, paging
from veilspark.sources.customers import CUSTOMER_PII, generate_customers
from veilspark.spec import PiiSpec


def test_row_numbers_equal_the_global_window(spark, store):
    df = generate_customers(spark, 3000)
    keys = ["loyalty_status", "customer_id"]
    got = numbering.number_rows(df, keys, store)
    wanted = df.withColumn("rn", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    assert rows(got.select(*wanted.columns)) == rows(wanted)


def test_equal_keys_still_number_one_to_n(spark, store):
    df = spark.range(5000).select(F.lit("same").alias("k"), (F.col("id") % 7).alias("v"))
    got = numbering.number_rows(df, ["k"], store)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 5001))
    assert got.rdd.getNumPartitions() >= 1


def test_empty_table(spark, store):
    df = generate_customers(spark, 5).limit(0)
    assert numbering.number_rows(df, ["customer_id"], store).count() == 0
    assert numbering.batch_plan(df, CUSTOMER_PII, ["customer_id"], store).count() == 0


@pytest.mark.parametrize("chunk_bits", [20, 4])
def test_batches_equal_slicing_in_python(spark, store, monkeypatch, chunk_bits):
    monkeypatch.setattr(numbering, "_CHUNK_BITS", chunk_bits)
    spec = PiiSpec(("a", "b"), ("id",))
    i = F.col("id")
    df = spark.range(1000).select(
        "id",
        F.when(i % 3 > 0, i.cast("string")).alias("a"),
        F.when(i % 2 == 0, F.lit(" ")).otherwise(F.lit("hot")).alias("b"),
    )
    got = numbering.batch_plan(df, spec, ["id"], store, batch_size=25)
    wanted = []
    for column in spec.columns:
        filled = [(r.id + 1, r[column]) for r in df.orderBy("id").collect() if r[column] and r[column].strip(" ")]
        wanted += [(column, rn, value, n // 25) for n, (rn, value) in enumerate(filled)]
    assert rows(got) == sorted(wanted, key=repr)


def test_fifty_rows_make_twelve_batches(spark, store):
    plan = numbering.batch_plan(generate_customers(spark, 50), CUSTOMER_PII, ["customer_id"], store)
    assert plan.count() == 300
    assert plan.select("column_name", "batch_no").distinct().count() == 12


def test_pages(spark, store, monkeypatch):
    df = generate_customers(spark, 60)
    shallow = rows(paging.key_page(df, "customer_id", 25, 25))
    assert shallow[0] == ("CUST00026",) and len(shallow) == 25
    monkeypatch.setattr(paging, "TOP_N", 0)
    assert rows(paging.key_page(df, "customer_id", 25, 25, store)) == shallow
    assert len(paging.row_dicts(df, 7)) == 7
    assert rows(paging.table_sample(df, "customer_id"), "customer_id")[-1] == ("CUST00005",)


def test_page_by_page_update_equals_one_pass(spark, store):
    df = generate_customers(spark, 60)
    paged = df
    for offset in (0, 25, 50):
        paged = paging.mock_update_page(paged, CUSTOMER_PII, paging.key_page(df, "customer_id", offset, 25))
    tokens = ["customer_id", *[f"{c}_token" for c in CUSTOMER_PII.columns]]
    whole = paging.paged_update(df, CUSTOMER_PII, store, 25)
    assert rows(paged, *tokens) == rows(whole, *tokens)
    assert whole.select("page_no").distinct().count() == 3
