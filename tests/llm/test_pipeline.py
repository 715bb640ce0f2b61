import pytest

import corpus_pipeline as P
from corpusloom.llm.queries import oracle_sql, queries

from .cases import documents, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    passage = words(30, 100)
    more = [(100 + i, words(80, 200 + i)) for i in range(4)] + [(200, words(80, 200)), (201, words(40, 300) + " " + passage + " " + words(40, 301))]
    rows = [(i, t, "en", "s", len(t), None, None, None, None, None) for i, t in more]
    documents(spark).unionByName(spark.createDataFrame(rows, documents(spark).schema)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert {100, 101, 102, 103, 200, 201} <= ids("quality_rules") and not {0, 1, 2, 3} & ids("quality_rules")
    assert ids("line_dedup") == ids("quality_rules")
    assert 100 in ids("near_dedup") and 200 not in ids("near_dedup") and {101, 102, 103, 201} <= ids("near_dedup")
    assert ids("decontamination") == ids("near_dedup") - {201}
    assert ids("packing") == ids("decontamination")


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    assert {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict()) and [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_query_names():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries() if k != "pipeline"} and set(oracle_sql()) <= set(queries())
