"""The registered queries on the given tables, and the stages of the pipeline against their operators."""

import pytest

import corpus_pipeline
from compare import difference
from plumbline.llm import decontaminate, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.ORACLES:
        assert difference(df, duck, queries.ORACLES[name], exact=True) is None
    else:
        n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
        assert df.count() >= n


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, data), "stage")
        assert out.columns == columns and 0 < out.count() <= before
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if stage is corpus_pipeline.near_duplicates:
            assert ids == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        if stage is corpus_pipeline.decontamination:
            found = decontaminate.decontaminate(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()
            assert ids == {r["doc_id"] for r in found if not r["contaminated"]}
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_on_odd_and_empty_tables(spark, make, data):
    odd = make([(1, None), (2, ""), (3, "x " * 20000), (3, "x " * 20000), (None, "some text without an id"), (4, "copy of one text"), (5, "copy of one text")])
    for docs in (odd, odd.limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, data), "odd")
            assert docs.columns == columns and docs.filter("_digest <> 7 OR __digest <> 7 OR _gone <> 7 OR _kept_digest <> 7").isEmpty()
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, data).columns
