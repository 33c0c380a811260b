"""Repeated rows, clashing columns and empty tables, for every operator and for the pipeline."""

import pytest
from helpers import documents, frame
from pyspark.sql import functions as F

import corpus_pipeline
from lattix.llm import decontaminate, language_model, licenses, packing, pii, quality, repetition, toxicity
from lattix.llm.queries import tokenizer_path

TEXTS = ["one two three four five six seven eight nine ten under the mit license", "Short text here.", "", None]


def benchmark(spark):
    return spark.createDataFrame([("b", "three four five six seven eight nine ten"), (None, "short text"), ("c", None)], "item_id string, text string")


OPERATORS = {
    "op1": lambda spark, df: decontaminate.digest(decontaminate.find_contamination(df, benchmark(spark))),
    "op3": lambda spark, df: quality.score_quality(df),
    "op6": lambda spark, df: pii.digest(df),
    "op8": lambda spark, df: licenses.scan_licenses(df).drop("spans"),
    "op9": lambda spark, df: repetition.repetition_coverage(df),
    "op10": lambda spark, df: toxicity.score_toxicity(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_each_get_their_row(spark, name):
    df = frame(spark, TEXTS)
    out = [tuple(map(str, r)) for r in OPERATORS[name](spark, df.unionAll(df).unionAll(df).repartition(2)).collect()]
    assert len(out) == 12 and all(out.count(r) == 3 for r in out)


def test_packing_beside_other_columns(spark):
    docs = documents(spark, TEXTS)
    for old, new in (("lang", "length"), ("source", "Offset"), ("n_chars", "_salt")):
        docs = docs.withColumnRenamed(old, new)
    out = packing.pack(docs, tokenizer_path()).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        packing.pack(docs.select(F.col("doc_id").alias("Length"), "text"), tokenizer_path(), doc_id="Length")


def test_language_model_beside_other_columns(spark):
    docs = documents(spark, TEXTS)
    for old, new in (("lang", "score"), ("source", "bucket"), ("n_chars", "ID")):
        docs = docs.withColumnRenamed(old, new)
    out = language_model.score_documents(docs)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {0: 15, 1: 4, 2: 1, 3: 1}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    documents(spark, ["x"]).filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
