"""The registered corpus queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from helixframe.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", ["op4_toxicity", "op6_quality"])
def test_held_out_accuracy(spark, small, name):
    column = {"op4_toxicity": "toxic", "op6_quality": "quality"}[name]
    folder = small.replace("sf0.001", "sf0.1")
    out = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right, n = out.selectExpr(f"avg(cast(predicted = {column} as int))", "count(*)").first()
    assert n > 500 and right > 0.95


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    kept = [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small).cache()
        kept.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept == sorted(kept, reverse=True) and 0.5 * before < kept[-1] < before
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
