import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilspark.operators import tokenize as tok
from veilspark.operators.govern import detokenize
from veilspark.operators.lookup import LookupLimits, Slice
from veilspark.operators.vault import Vault, build_vault, save_slices
from veilspark.plans import publish
from veilspark.session import shared_dir
from veilspark.sources.customers import CUSTOMER_PII, generate_customers
from veilspark.sources.store import RunStore, input_fingerprint
from veilspark.spec import PiiSpec
from veilspark.streaming import protect


@pytest.fixture
def database(spark, store):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{store.path(name)}'")
    return name


@pytest.fixture
def plain(spark, database):
    """A published plain-text table; returns (view, vault table, first version)."""
    table = f"{database}.customer_data"
    version = publish.write_version(generate_customers(spark, 50), table)
    publish.point_view(spark, table, version)
    return table, f"{database}.vault", version


def test_publish_moves_the_view_and_reports(spark, key, plain):
    table, vault, version = plain
    source = generate_customers(spark, 50)
    report = publish.tokenize_and_publish(spark.table(table), CUSTOMER_PII, key, table, vault)
    assert str(report) == "300 tokens in 12 batches (50 total rows)"
    assert rows(spark.table(table)) == rows(tok.tokenize(source, CUSTOMER_PII, key))
    assert spark.table(vault).count() == 42
    stored = Vault.stored(spark, vault)
    assert stored.slices == Vault.open(spark.table(vault)).slices and stored.unique
    assert rows(detokenize(spark.table(table), CUSTOMER_PII, stored)) == rows(source)
    publish.drop_version(spark, version)
    assert publish.versions(spark, table) == [report.version]
    values = {v for r in source.select(*CUSTOMER_PII.columns).collect() for v in r}
    assert not values & {v for r in spark.table(table).select(*CUSTOMER_PII.columns).collect() for v in r}


def test_second_run_adds_only_new_vault_rows(spark, key, plain):
    table, vault, _ = plain
    publish.tokenize_and_publish(generate_customers(spark, 50), CUSTOMER_PII, key, table, vault)
    more = generate_customers(spark, 50).unionByName(
        generate_customers(spark, 1).withColumns({"customer_id": F.lit("X"), "email": F.lit("new@example.com")})
    )
    publish.tokenize_and_publish(more, CUSTOMER_PII, key, table, vault)
    assert spark.table(table).count() == 51
    assert spark.table(vault).count() == 43
    assert Vault.stored(spark, vault).size("email").rows == 5


def test_empty_table_is_published(spark, key, plain):
    table, vault, _ = plain
    report = publish.tokenize_and_publish(generate_customers(spark, 5).limit(0), CUSTOMER_PII, key, table, vault)
    assert (report.n_rows, report.n_tokens, report.n_calls) == (0, 0, 0)
    assert spark.table(table).count() == 0


@pytest.mark.parametrize("fault", ["leak", "lost rows", "lost cells", "lost vault"])
def test_failed_check_leaves_the_view(spark, key, plain, monkeypatch, fault):
    table, vault, version = plain
    before = rows(spark.table(table))
    real = tok.tokenize
    if fault == "leak":
        leak = F.when(F.col("customer_id") == "CUST00007", F.lit("michael.johnson@example.com")).otherwise(F.col("email"))
        monkeypatch.setattr(publish, "tokenize", lambda df, s, k: real(df, s, k).withColumn("email", leak))
    elif fault == "lost rows":
        monkeypatch.setattr(publish, "tokenize", lambda df, s, k: real(df, s, k).limit(49))
    elif fault == "lost cells":
        monkeypatch.setattr(publish, "tokenize", lambda df, s, k: real(df, s, k).withColumn("email", F.lit(None).cast("string")))
    else:
        monkeypatch.setattr(publish, "tokenize", lambda df, s, k: real(df, s, k).withColumn("email", F.reverse("email")))
    with pytest.raises(publish.PublishError):
        publish.tokenize_and_publish(spark.table(table), CUSTOMER_PII, key, table, vault)
    assert rows(spark.table(table)) == before
    assert publish.versions(spark, table) == [version]


def test_a_version_is_never_overwritten(spark, plain, monkeypatch):
    table, _, version = plain
    monkeypatch.setattr(publish, "versions", lambda s, t: [])
    with pytest.raises(Exception, match="exists"):
        publish.write_version(generate_customers(spark, 3), table)


def test_files_of_a_dead_run_do_not_block_versions(spark):
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    (warehouse / "left_over__v1").mkdir(parents=True)
    (warehouse / "left_over__v1" / "part-0.parquet").write_bytes(b"half")
    assert publish.write_version(generate_customers(spark, 3), "left_over") == "left_over__v2"
    assert publish.write_version(generate_customers(spark, 4), "left_over") == "left_over__v3"
    assert spark.table("left_over__v2").count() == 3


def test_fingerprint_follows_the_files(spark, store):
    path = store.path("a")
    spark.range(3).write.parquet(path)
    before = input_fingerprint(spark, path)
    assert before == input_fingerprint(spark, path)
    spark.range(4).write.mode("append").parquet(path)
    assert before != input_fingerprint(spark, path)


def test_run_store_writes_once_and_removes_its_files(spark):
    with RunStore(spark) as store:
        assert store.write(spark.range(3), "a").count() == 3
        with pytest.raises(Exception, match="exists"):
            store.write(spark.range(3), "a")
        folder = Path(store.root) / "a"
        assert folder.exists()
    assert not folder.exists() and not spark.catalog.databaseExists(store.database)


@pytest.mark.parametrize("limits", [LookupLimits(), LookupLimits(broadcast_bytes=0, hot_cells=10)])
def test_stream_equals_batch(spark, key, store, limits):
    spec = PiiSpec(("user",), ("id",))
    events = spark.range(200).select("id", (F.col("id") % 9).cast("string").alias("user"))
    events.repartition(5).write.parquet(store.path("events"))
    stream = protect.read_stream(spark, store.path("events"), events.schema, files_per_trigger=2)
    tokens = protect.drain(protect.tokenize_stream(stream, spec, key), store, "tokens")
    assert rows(tokens) == rows(tok.tokenize(events, spec, key))
    vault = Vault.open(store.write(build_vault(events, spec, key), "vault"), limits)
    back = protect.read_stream(spark, store.path("tokens"), tokens.schema)
    assert rows(protect.drain(protect.detokenize_stream(back, spec, vault), store, "back")) == rows(events)


def test_run_stores_do_not_collide(spark):
    assert RunStore(spark).root != RunStore(spark).root


def test_sizes_are_kept_with_the_table(spark, store):
    store.write(spark.range(1), "vault")
    with pytest.raises(ValueError, match="Vault.open"):
        Vault.stored(spark, store.name("vault"))
    slices = {"it's \\ \"odd\"": Slice(1, 2, 3, False, 4)}
    save_slices(spark, store.name("vault"), slices)
    assert Vault.stored(spark, store.name("vault")).slices == slices


def test_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=f"app-{uuid.uuid4()}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=context)

    assert shared_dir(session("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local) != shared_dir(session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host"))
