import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, language, queries


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The small tables with null, empty, repeated and very long rows added."""
    path = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet(f"{small}/documents.parquet")
    odd = [(None, None, None, None, None), (10_001, "", "en", None, 0), (10_002, "12 34", None, "s", 5), (None, "and the of it is", None, "s", 16)]
    rows = spark.createDataFrame(odd, given.schema)
    long = given.limit(1).select(F.lit(10_003).cast("long").alias("doc_id"), F.repeat("text", 300).alias("text"), "lang", "source", "n_chars")
    given.unionByName(rows).unionByName(given.limit(3)).unionByName(long).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{small}/pages.parquet").write.parquet(f"{path}/pages.parquet")
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors.unionByName(vectors.limit(2).withColumn("embedding", F.lit(None))).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(f"{tmp_path}/{i}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        assert 0 < docs.count() <= before, name
        before = docs.count()
    assert sorted(r.doc_id or -1 for r in docs.collect()) == sorted(r.doc_id or -1 for r in last.collect())
    texts = [r.text for r in last.collect()]
    assert len(set(texts)) == len(texts)
    assert not any("@mail" in t.lower() for t in texts)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.benchmark_hits(last, benchmark).where(decontaminate.is_contaminated()).count() == 0
    assert not any(language.LanguageModel((), None, None, 1.0).predict(t)[0] == "" for t in texts)


def test_empty_tables_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_every_query_gives_a_row_for_every_row(spark, folder, name):
    table = {"op10_urls": "pages", "op13_whitening": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    wanted = 4 * rows.where("embedding is not null").count() if table == "embeddings" else rows.count()
    assert queries.QUERIES[name](spark, folder).count() == wanted


CLASH = ["n_entities", "lang_pred", "score", "language", "digest", "__digest", "__own", "__id", "__fp", "__i", "__worn", "__parts", "c0", "bad_id", "fp", "kind", "value"]


def test_names_of_further_columns_do_not_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {r[c] for r in out.collect() for c in CLASH} == {"mine"}, name


def test_new_columns_take_the_names_of_old_ones(spark, folder):
    from tallyfold.llm import surrogates

    docs = spark.createDataFrame([(1, "write to a.b@mail.org", "x"), (2, "nothing", "y")], "doc_id long, text string, n_entities string")
    assert sorted((r.doc_id, r.n_entities) for r in surrogates.replace_entities(docs, "k").collect()) == [(1, 1), (2, 0)]
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"))
    found = language.identify(docs.withColumnRenamed("n_entities", "lang_pred"), model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"] and found.count() == 2
