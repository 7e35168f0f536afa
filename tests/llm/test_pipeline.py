"""The stages in order on a small table, each against what the operators' queries say about its input."""

from test_near_text import brute_kept

import corpus_pipeline
from veilspark.llm import decontaminate, mixing, toxicity
from veilspark.llm.queries import ORACLES, QUERIES, toxicity_model

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            scored = toxicity.score_texts(docs, toxicity_model(spark, docs, SF), "doc_id")
            assert ids == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert sorted(ids) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()]) and out.count() == len(ids)
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {r["doc_id"] for r in decontaminate.scanned(docs, bench).where("NOT contaminated").select("doc.doc_id").collect()}
        elif name == "source_mix":
            taken = mixing.mix(docs, mixing.word_count(docs["text"])).where("taken > 0").select("doc.doc_id")
            assert ids == {r["doc_id"] for r in taken.collect()}
        else:
            assert out.count() == docs.count()
        if name != "token_files":
            assert out.columns == columns
        docs = out


def test_empty_documents_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
