"""A corpus from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``, and their decisions take effect: rows go, or texts change. Rows may be null
in any column; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontaminate, language, simhash, surrogates
from tallyfold.llm.names import free
from tallyfold.llm.scratch import Scratch
from tallyfold.llm.shipping import ship

#: Least probability of a language that is kept.
MIN_LANGUAGE = 0.4
#: A test key; a real one comes from the caller and stays secret.
SURROGATE_KEY = "test tables only"

#: A trained model, a majority of hashes and a tokenizer have no short SQL; the tests have brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; without letters, or with no language likely, they go."""
    ship(spark)
    model = language.fit(docs.select("doc_id", "text", "lang").where(~language.held_out()))
    name, score = free("language", docs.columns), free("score", docs.columns)
    found = language.identify(docs, model, names=(name, score))
    sure = (F.col(name) != language.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE)
    return found.where(sure).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 4-word shingles, 4 differing bits at most."""
    ship(spark)
    return simhash.keep_one(docs, width=4, distance=4)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in 20 is inside a 13-word window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(docs, benchmark, window=13)
    own, digest = free("bad_id", docs.columns), free("bad_digest", docs.columns)
    bad = hits.where(decontaminate.is_contaminated()).select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    # written, so that Spark knows its size: few of them reach the documents without a shuffle of the texts
    bad = Scratch(spark).write(bad, docs.count())
    same = docs.doc_id.eqNullSafe(F.col(own)) & (F.xxhash64(docs.text) == F.col(digest))
    return docs.join(bad, same, "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    count = free("n_entities", docs.columns)
    replaced = surrogates.replace_entities(docs, SURROGATE_KEY, count=count)
    chars = F.when(F.col(count) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded): the corpus as tokens."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("lang", "source"))


STAGES = [
    ("language", identified),
    ("near duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("tokens", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
