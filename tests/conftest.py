import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from veilspark.functions.tokens import TokenKey  # noqa: E402
from veilspark.session import build_session  # noqa: E402
from veilspark.sources.store import RunStore  # noqa: E402

SECRET = b"test key"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="4g",
        spark_checkpoint_dir=f"{base}/shared",
        spark_sql_warehouse_dir=f"{base}/warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def key(spark):
    return TokenKey.from_secret(spark, SECRET)


@pytest.fixture
def store(spark):
    return RunStore(spark)


def rows(df, *order):
    """Rows as tuples, sorted so that NULLs compare."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
