from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe
from quern.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_queries_are_complete():
    names = {q.split("_")[0] for q in QUERIES}
    assert names == {f"op{n}" for n in range(1, 11)} | {"pipeline"}


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DIR).cache()
        rows = docs.collect()
        counts.append(len(rows))
        assert {r.doc_id for r in rows} <= set(before) and len(rows) <= counts[-2]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows) or k in (0, 2)
        if k == 0:
            kept = {r.doc_id for r in rows}
            assert sum(labels.get(i) == 1 for i in before) - sum(labels.get(i) == 1 for i in kept) <= 1
            assert sum(labels.get(i) == 0 for i in kept) < 0.35 * sum(labels.get(i) == 0 for i in before)
        if k == 1:
            lines = [x.strip() for r in rows for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
    assert all(r.round_trip for r in rows)
    path, pattern = bpe.public_vocabulary()
    encoder = bpe.Encoder.load(path, pattern)
    assert encoder.count([""])[0] == 0 and docs.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).select("doc_id").collect()} == {r.doc_id for r in rows}


def test_blank_documents_without_a_match_stay(spark):
    docs = spark.createDataFrame([(1, "  ", "en", "x", 2), (2, "", "en", "x", 0), (3, None, "en", "x", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, DIR).collect()} == {1, 2, 3}
