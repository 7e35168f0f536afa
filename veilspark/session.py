"""Session settings and the shared folder that written intermediate tables live in."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "veilspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tested under; `conf` keys use _ for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot never compiles a method above 8000 bytes of bytecode. A projection over many
        # protected columns is larger than that as one method; under this limit Spark splits it.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only a local-mode session may go without it; its application then gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="veilspark-")
    return _local_dirs[application]
