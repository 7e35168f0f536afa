"""Extension: tokenizing and detokenizing streams. Both are stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veilspark.functions.tokens import TokenKey
from veilspark.operators.govern import detokenize
from veilspark.operators.tokenize import tokenize
from veilspark.operators.vault import Vault
from veilspark.sources.store import RunStore
from veilspark.spec import PLAIN_TEXT, PiiSpec


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files under `path`, which is a folder or a glob (a glob may also match single files)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tokenize_stream(stream: DataFrame, spec: PiiSpec, key: TokenKey) -> DataFrame:
    """The same projection as in batch; nothing is kept between micro-batches."""
    return tokenize(stream, spec, key)


def detokenize_stream(stream: DataFrame, spec: PiiSpec, vault: Vault, mode: str = PLAIN_TEXT) -> DataFrame:
    """A stream-static lookup: each micro-batch joins the vault as it is then stored."""
    return detokenize(stream, spec, vault, mode)


def drain(stream: DataFrame, store: RunStore, name: str) -> DataFrame:
    """Run the stream over all data there is into a written table, and return that table."""
    path = store.path(name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", store.path(f"{name}__checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
