import hashlib
import re

import pytest

from tallyfold.llm import exact


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((doc is None, doc or 0, i))
    out = []
    for digest, members in groups.items():
        first = min(members)
        keep = None if first[0] else first[1]
        for none, doc, i in members:
            out.append((None if none else doc, keep, len(members), i == first[2], digest))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


ODD = [
    (1, "one  two"), (2, "one\ttwo"), (3, "one two "), (4, None), (5, ""), (6, " "), (7, "\n\r\x0b"), (None, "one two"),
    (8, "wide space"), (9, "wide space"), (10, "long " * 200_000), (11, "long\n" * 200_000), (None, None), (None, "alone"),
]


@pytest.mark.parametrize("most", [exact.MAX_FILTER, 4096, 0])
def test_groups_equal_brute_force(docs, most):
    rows = ODD + [(100 + i, f"text {i % 700}") for i in range(1000)] + [(2000 + i, "hot  group" if i % 2 else "hot group") for i in range(700)]
    assert found(exact.exact_duplicates(docs(rows), most=most)) == brute(rows)


def test_a_filter_too_full_is_left_out():
    assert exact.filter_blocks(0) == 1
    assert exact.filter_blocks(10_000) == 5
    assert exact.filter_blocks(10_000, most=4096) == 1
    assert exact.filter_blocks(100_000, most=4096) == 0
    assert exact.filter_blocks(10**9) <= exact.MAX_FILTER * 8 // exact.BLOCK


def test_filter_loses_no_copy_and_lets_most_others_through(spark):
    from pyspark.sql import functions as F

    n = 20_000
    rows = spark.range(n).select("id", F.unhex(F.sha2(F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(F.col("id")).cast("string"), 256)).alias("digest"))
    blocks = exact.filter_blocks(n)
    by = {(r.copy, r.repeated): r["count"] for r in exact.tested(rows, exact.bloom_filter(rows, blocks), blocks).groupBy((F.col("id") < 2000).alias("copy"), "repeated").count().collect()}
    assert by[True, True] == 2000 and (True, False) not in by
    assert by[False, True] < 0.04 * n


def test_the_test_shuffles_no_row(spark, tmp_path):
    spark.range(1000).selectExpr("unhex(sha2(string(id), 256)) AS digest").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    exact.bloom_filter(facts, 1).write.parquet(str(tmp_path / "bloom"))
    plan = exact.tested(facts, spark.read.parquet(str(tmp_path / "bloom")), 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_same_id_is_kept_once_and_names_may_clash(docs):
    df = docs([(1, "a"), (1, "a"), (2, "a"), (3, "b")]).selectExpr("doc_id", "text", "row AS kept", "lang AS keep_id", "source AS digest", "row AS `__held`", "row AS size")
    out = exact.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    marked = exact.exact_duplicates(df, keep=df.columns)
    assert marked.columns == ["doc_id", "text", "digest", "__held", "size", "keep_id", "group_size", "kept", "text_sha256"]
    assert sum(r.kept for r in marked.collect()) == 2


def test_empty_table(docs):
    df = docs([(1, "a")]).where("false")
    assert exact.exact_duplicates(df).collect() == [] and exact.keep_one(df).collect() == []
