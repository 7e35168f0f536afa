"""Words, columns and written tables that several operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import veilspark
from veilspark.session import shared_dir

# Task code travels with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(veilspark)

#: A-Z to a-z; every other ASCII byte that is no digit or lower-case letter becomes a space.
_PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def spaced_words(text: bytes) -> list[bytes]:
    """Runs of `[^\\x20\\x09-\\x0D]` in UTF-8 text after A-Z became lower case."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` in UTF-8 text after A-Z became lower case."""
    return text.translate(_PLAIN).split()


def worker_state() -> dict:
    """A dict that lives as long as the Python worker. Task code is shipped by value, so module globals start anew in every task."""
    return sys.modules.setdefault("veilspark_worker_state", ModuleType("veilspark_worker_state")).__dict__


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the folder that all executors share."""
    return f"{shared_dir(spark)}/veilspark/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """All columns of `docs` in one struct `doc`, next to `columns`: no column name can clash."""
    picked = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *picked)


def unpacked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns `names` that `packed` put into `doc`."""
    return df.select(*(F.col(f"doc.`{c}`").alias(c) for c in names))
