import pytest
from pyspark.sql import functions as F

import tallyfold as tf
from tallyfold.errors import InvalidDataset
from tallyfold.operators.sketches import sketch_size


def test_sketch_sizes():
    assert sketch_size(0.0133) in range(290, 310)
    assert sketch_size(0.9) == 8
    for bad in (0, 1, -1):
        with pytest.raises(ValueError, match="between"):
            sketch_size(bad)
    with pytest.raises(ValueError, match="exact"):
        sketch_size(1e-6)


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(20_000).select((F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))


def test_ranks_are_near(values):
    for by in (None, "g"):
        found = tf.column_quantiles(values, "v", (0.0, 0.25, 0.5, 0.99, 1.0), by, rank_error=0.01)
        assert found.columns == ([by] if by else []) + ["probability", "value"]
        rows = found.collect()
        assert len(rows) == 5 * (4 if by else 1)
        assert all(abs(r.value / 20_000 - r.probability) < 0.03 for r in rows)


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", None), ("a", float("nan")), (None, 9.0), ("b", None)], "g string, v double")
    rows = tf.column_quantiles(df, "v", (0.0, 1.0), "g", rank_error=0.1).collect()
    assert sorted((r.g, r.probability, r.value) for r in rows) == [("a", 0.0, 1.0), ("a", 1.0, 3.0)]
    assert tf.column_quantiles(df.where("false"), "v", (0.5,), rank_error=0.1).collect() == []


def test_merged_sketches_equal_one_sketch_in_rank(values):
    kept = tf.quantile_sketches(values.withColumn("day", F.col("v") % 30), "v", ["day", "g"], 0.01)
    merged = tf.quantiles_of_sketches(kept, (0.5, 0.9), ["g"]).collect()
    assert len(merged) == 8 and all(abs(r.value / 20_000 - r.probability) < 0.03 for r in merged)
    (whole,) = tf.quantiles_of_sketches(kept, (0.5,)).collect()
    assert abs(whole.value / 20_000 - 0.5) < 0.03


def test_trim_by_a_sketch(values):
    kept = tf.outlier_trim(values, "v", 0.9, rank_error=0.01)
    assert abs(kept.count() / 20_000 - 0.9) < 0.03
    with pytest.raises(InvalidDataset, match="nothing is left"):
        tf.outlier_trim(values.withColumn("v", F.lit(1.0)), "v", rank_error=0.1)
    with pytest.raises(InvalidDataset, match="no rows"):
        tf.outlier_trim(values.where("false"), "v", rank_error=0.1)


def test_description_in_one_pass(values):
    exact = {(r.g, r.stat): r.value for r in tf.ltv_describe(values, "g", "v").collect()}
    found = tf.ltv_describe(values, "g", "v", rank_error=0.01)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = found.collect()
    assert {(r.g, r.stat) for r in rows} == set(exact)
    for r in rows:
        near = 600 if r.stat.endswith("%") else 1e-6
        assert r.value == pytest.approx(exact[r.g, r.stat], abs=near)


def test_customers_of_any_months_and_countries(transactions):
    rows = [(f"c{i % 900}", f"2011-{1 + i % 3:02}-05", "1", "1", "xyz"[i % 2]) for i in range(3000)]
    sketches = tf.customer_sketches(transactions(rows))
    assert sketches.count() == 6
    (whole,) = tf.distinct_customers_of(sketches).collect()
    assert whole.customers == pytest.approx(900, rel=0.03)
    months = tf.distinct_customers_of(sketches.where("country = 'x'"), ["month_start"]).collect()
    assert len(months) == 3 and all(0 < r.customers < 320 for r in months)
    assert tf.distinct_customers_of(sketches.where("false")).first().customers == 0
    assert tf.customer_sketches(transactions(rows, True), by_country=False).columns == ["month_start", "sketch"]
