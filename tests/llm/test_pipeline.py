import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, corpus, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).drop("key", "_cuts", "line").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(rows[9][1])[:12]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    emptied = seen["quality classifier"].join(seen["line dedup"], "doc_id", "left_anti")
    assert emptied.count() > 0 and emptied.filter("text is null or trim(text) = ''").count() == 0
    assert seen["line dedup"].filter("doc_id = 2").count() == 0  # every line of it is held by document 0
    assert seen["benchmark decontamination"].filter("doc_id = 9").count() == 0
    assert seen["n-gram Jaccard join"].filter("doc_id = 9").count() == 1
    assert seen["mixing sources"].filter(F.col("copy") > 2).count() == 0


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
