"""The corpus pipeline: from raw documents to files of token ids.

Each stage works on all that the stage before kept, and its result is written and read again before the
next. Toxic documents go; one document of each near-duplicate group
(five-word shingles, a Jaccard similarity of 0.8 or more) stays; documents that hold a benchmark window
go; sources are mixed to their target weights; what is left becomes token-id files in doc_id order.
A document that the mix repeats is a row for each copy. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontaminate, mixing, near_text, token_files, toxicity
from veilspark.llm.common import run_folder, staged, table
from veilspark.llm.queries import END_ID, TOKENIZER, toxicity_model

#: No SQL: fingerprints, fitted scores and token ids are beyond it. tests/llm holds brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "corpus-tokens")
    # Workers that go on to other stages need the memory of the words they would keep.
    token_files.write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID, keep_words=False)
    return token_files.with_crc32(token_files.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
