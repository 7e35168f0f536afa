"""Written intermediate tables in the shared folder.

A written table cuts lineage, is read with real file sizes, and outlives any executor.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from types import TracebackType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import shared_dir

#: How long the stores of an application are kept if it neither drops them nor renews its lease.
LEASE_SECONDS = 24 * 3600
_folders: dict[tuple[str, str], tuple[str, int]] = {}


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilspark"


def application_folder(spark: SparkSession, lease_seconds: int = LEASE_SECONDS) -> str:
    """The folder of this application's stores. Its lease is renewed when a store is opened in the second half of it.

    The first store of an application also removes the folders of others whose lease has ended.
    """
    key, now = (spark.sparkContext.applicationId, _base(spark)), int(time.time())
    folder, until = _folders.get(key, ("", 0))
    if not folder:
        reap(spark)
        folder = f"{key[1]}/app_{uuid.uuid4().hex}"
    if until < now + lease_seconds // 2:
        until = now + lease_seconds
        spark.range(1).select(F.lit(until).cast("bigint").alias("until")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/lease")
        _folders[key] = folder, until
    return folder


class RunStore:
    """Tables of one run, in a database of their own whose files are in the shared folder.

    Staged tables may hold plain text. `drop` removes them with their files; a `with` block does so
    on leaving, also after an error. Drop only when no DataFrame reads them any more. What an application that died did not
    drop goes when its lease has ended (`reap`).
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.database = f"veilspark_run_{uuid.uuid4().hex}"
        self.root = f"{application_folder(spark)}/{self.database}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.root}'")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def path(self, folder: str) -> str:
        """A folder next to the tables, for files that are not a catalog table."""
        return f"{self.root}/files/{folder}"

    def write(
        self,
        df: DataFrame,
        table: str,
        partition_by: tuple[str, ...] = (),
        options: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """Write `df` once (an existing table is an error) and return it as read back."""
        writer = df.write.mode("errorifexists").format("parquet").options(**(options or {}))
        writer.partitionBy(*partition_by).saveAsTable(self.name(table))
        return self.spark.table(self.name(table)).select(*df.columns)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def __enter__(self) -> RunStore:
        return self

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        self.drop()


def reap(spark: SparkSession, now: float | None = None) -> list[str]:
    """Remove the stores of applications whose lease has ended, with their files and what this catalog knows of them; returns their folders."""
    base = _base(spark)
    try:
        leases = spark.read.schema("until bigint").option("ignoreMissingFiles", "true").parquet(f"{base}/app_*/lease")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # A lease that is being written has no row yet, so its folder is left alone.
    ended = leases.filter(F.col("until") < F.lit(int(time.time() if now is None else now)))
    found = ended.select(F.regexp_extract(F.input_file_name(), "/(app_[0-9a-f]+)/lease/", 1).alias("folder")).distinct().collect()
    folders = sorted(r["folder"] for r in found)
    if folders:
        for row in spark.sql("SHOW DATABASES LIKE 'veilspark_run_*'").collect():
            location = spark.catalog.getDatabase(row[0]).locationUri
            if any(f"/{folder}/" in location for folder in folders):
                spark.sql(f"DROP DATABASE IF EXISTS {row[0]} CASCADE")
    for folder in folders:
        # A database that is named and dropped takes the folder with it, on every file system that Spark can write to.
        spark.sql(f"CREATE DATABASE veilspark_{folder} LOCATION '{base}/{folder}'")
        spark.sql(f"DROP DATABASE veilspark_{folder} CASCADE")
    return folders


def input_fingerprint(spark: SparkSession, *paths: str) -> tuple[int, ...]:
    """Changes when a file under `paths` is added, removed or rewritten. Reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    row = files.selectExpr("path", "length", "modificationTime").selectExpr(
        "count(*)", "sum(length)", "bit_xor(xxhash64(path, length, modificationTime))"
    )
    return tuple(row.first())
