import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexarium.llm import queries

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    boiler = "This line is boilerplate."
    texts = [f"{boiler}\nunique text number {i} alpha{i} beta{i}" for i in range(12)] + [near, near + " more", near, None, "", "12345 !!!", "write to me@site.example.com please"]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert set(docs.columns) == COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == set(range(15)) | {18}
    assert all(boiler not in t for t in kept["line_dedup"].values())
    assert set(kept["near_duplicates"]) == set(range(13)) | {18}
    assert kept["pii"][18] == "write to [EMAIL] please"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(kept["pii"])


def test_pipeline_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    result = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
