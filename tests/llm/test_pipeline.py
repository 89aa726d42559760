"""The pipeline's stages in a row, and the registered queries."""

from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import queries


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copy = docs.where("doc_id = 1")
    docs = docs.unionByName(copy.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")).unionByName(copy)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    before = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == before
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 100001 not in ids and 1 in ids
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_columns_of_any_name_pass_unchanged(spark, sf):
    names = ["gone", "d", "th", "Script", "kept", "n_words", "emptied", "a.b", "id", "c0", "text_", "bands", "component_id", "item_id"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" and r.n_chars == len(r.text) for r in rows for n in names)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_other_texts_under_a_repeated_id_stay(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "ab"]
    rows = [(1, texts[0], "en"), (1, texts[1], "de"), (1, texts[0], "de"), (2, "c d", "en")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(map(tuple, out.collect())) == [(1, texts[0], "de"), (1, texts[1], "de"), (2, "c d", "en")]


def test_ten_operators_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
