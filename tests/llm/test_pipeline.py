"""The five stages one after another."""

import corpus_pipeline
from holdfast.llm import language, quality, simhash
from holdfast.session import durable


def test_stages_take_effect(spark, folder, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, folder))
        seen.append((name, before, docs))
    assert [name for name, *_ in seen] == [name for name, _ in corpus_pipeline.STAGES] and len(seen) == 5
    assert all(after.columns == documents.columns for _, _, after in seen[:-1])
    ids = [{r[0] for r in after.select("doc_id").collect()} for _, _, after in seen]
    first = language.identify(documents).where("not rejected").select("row.doc_id").collect()
    assert ids[0] == {r[0] for r in first}
    trusted = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    assert ids[1] == {r.doc_id for r in quality.rate(seen[1][1], trusted).where("kept").select("row.doc_id").collect()}
    groups = simhash.near_duplicates(seen[2][1]).select("component_id").distinct()
    assert seen[2][2].count() == groups.count() == len(ids[2])
    assert ids[3] <= ids[2] and seen[3][2].groupBy("doc_id").count().where("count > 2").count() == 0
    assert seen[4][2].count() == seen[3][2].count() and seen[4][2].columns == ["doc_id", "ids", "decoded"]


def test_awkward_and_empty_tables(spark, folder, awkward, empty, documents):
    for table in (awkward, empty):
        docs = table.select(*[c for c in documents.columns if c in table.columns], "ids")
        for _, stage in corpus_pipeline.STAGES:
            docs = durable(stage(spark, docs, folder))
        assert "ids" in docs.columns
