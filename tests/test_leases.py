"""Stores of applications that died are removed by a later one, and no others."""

import time
from pathlib import Path

import pytest

from veilspark.sources import store as stores
from veilspark.sources.store import RunStore, application_folder, reap


@pytest.fixture
def forgotten(spark, monkeypatch):
    """As if this were another application: it has no folder yet."""
    monkeypatch.setattr(stores, "_folders", {})


def lease(spark, folder, until):
    spark.range(1).selectExpr(f"bigint({until}) AS until").write.parquet(f"{folder}/lease")


def test_stores_past_their_lease_go_with_their_files(spark, forgotten):
    folder = Path(application_folder(spark, lease_seconds=10))
    store = RunStore.__new__(RunStore)  # opening one would renew the lease
    store.spark, store.database, store.root = spark, "veilspark_run_dead", f"{folder}/veilspark_run_dead"
    spark.sql(f"CREATE DATABASE {store.database} LOCATION '{store.root}'")
    store.write(spark.range(3), "secrets")
    assert folder.name not in reap(spark)
    stores._folders.clear()
    kept = RunStore(spark)
    later = time.time() + 60
    assert reap(spark, later) == [folder.name] and not folder.exists() and not spark.catalog.databaseExists(store.database)
    assert kept.write(spark.range(3), "more").count() == 3
    kept.drop()


def test_opening_a_store_renews_the_lease(spark, forgotten):
    folder = Path(application_folder(spark, lease_seconds=10))
    RunStore(spark).drop()
    assert folder.name not in reap(spark, time.time() + 60)


def test_files_of_another_catalog_go_when_the_first_store_opens(spark, forgotten):
    base = Path(stores._base(spark))
    dead, alive, half = (base / f"app_{d * 32}" for d in "012")
    for folder in (dead, alive):
        spark.range(3).write.parquet(f"{folder}/veilspark_run_x/secrets")
    lease(spark, dead, 5)
    lease(spark, alive, int(time.time()) + 100)
    (half / "lease" / "_temporary").mkdir(parents=True)
    store = RunStore(spark)
    assert not dead.exists() and alive.exists() and half.exists()
    assert reap(spark, time.time() + 1_000) == [alive.name] and half.exists()
    store.drop()


def test_one_lease_for_all_stores_of_an_application(spark, forgotten):
    one, two = RunStore(spark), RunStore(spark)
    folder = Path(one.root).parent
    assert folder == Path(two.root).parent and len(list((folder / "lease").glob("*.parquet"))) == 1
    one.drop()
    assert not Path(one.root).exists() and Path(two.root).parent.exists()
    two.drop()
