"""The registered queries against DuckDB and plain Python on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest
from helpers import blank_words

import corpus_pipeline
from lattix.llm import queries
from lattix.llm.shared import table

TABLES = ("documents", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, testdata, name):
    d = f"{testdata}/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    got = queries.QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_each_over_all_documents(spark, testdata, n):
    d = f"{testdata}/sf0.001"
    [name] = [q for q in queries.QUERIES if q.startswith(f"op{n}_")]
    out = queries.QUERIES[name](spark, d)
    assert out.select("doc_id").distinct().count() == table(spark, d, "documents").count()


def test_pipeline(spark, testdata):
    d = f"{testdata}/sf0.001"
    docs = table(spark, d, "documents")
    by_step = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        by_step.append(stage(spark, by_step[-1], d).cache())
        assert by_step[-1].columns == docs.columns
    n = [x.count() for x in by_step]
    assert n[0] > n[1] > n[2] > n[3] == n[4] > 0.5 * n[0]
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in by_step[3:5])
    changed = [k for k in before if before[k] != after[k]]
    assert changed and all(len(blank_words(before[k])) == len(blank_words(after[k])) for k in changed)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == set(after)
