import json

import pytest
from pyspark.sql import functions as F

from tallyfold_checks.views import PREDICTED, WINDOWS, retail
from tallyfold import (
    InvalidDataset,
    Windows,
    customer_value,
    future_value,
    ltv_describe,
    report_json,
    segment,
    segment_counts,
    value_report,
    window_slice,
)
from tallyfold.operators.scoring import segment_of, segment_onehot
from tallyfold.operators.windows import two_window_totals
from tallyfold.plans.classification import feature_columns, ltv_features, train_predict

DATES = (WINDOWS.rfm_start, WINDOWS.rfm_end, WINDOWS.pred_start, WINDOWS.pred_end)


@pytest.mark.parametrize(
    "dates, message",
    [
        (("soon", "2011-06-01", "2011-06-02", "2011-12-01"), "rfm_start must be a date"),
        (("2011-03-01", None, "2011-06-02", "2011-12-01"), "rfm_end must be a date"),
        (("2011-06-01", "2011-06-01", "2011-06-02", "2011-12-01"), "later than rfm_start"),
        (("2011-03-01", "2011-06-01", "2011-06-01", "2011-12-01"), "later than rfm_end"),
        (("2011-03-01", "2011-06-01", "2011-06-02", "2011-06-02"), "later than pred_start"),
    ],
)
def test_windows_are_checked(dates, message):
    with pytest.raises(ValueError, match=message):
        Windows(*dates)


def test_slice_is_half_open(transactions):
    df = transactions([("a", "2011-03-01 00:00:00", "1", "1", "x"), ("b", "2011-05-31 23:59:59", "1", "1", "x"),
                       ("c", "2011-06-01 00:00:00", "1", "1", "x"), ("d", "2011-02-28 23:59:59", "1", "1", "x")])
    assert {r.customerid for r in window_slice(df, "2011-03-01", "2011-06-01").collect()} == {"a", "b"}


def test_two_windows_in_one_pass(transactions):
    df = transactions([
        ("a", "2011-03-05", "2", "1.5", "x"), ("a", "2011-07-01", "1", "10", "x"),
        ("b", "2011-04-01", "1", "4", "x"), ("c", "2011-07-01", "1", "99", "x"),
        ("b", "2011-06-01", "1", "50", "x"),
    ])
    windows = Windows("2011-03-01", "2011-06-01", "2011-06-02", "2011-12-01")
    rows = {r.customerid: (r.frequency, float(r.monetary), float(r.future_revenue)) for r in two_window_totals(df, windows).collect()}
    assert rows == {"a": (1, 3.0, 10.0), "b": (1, 4.0, 0.0)}


def test_both_windows_reach_the_scan(spark, small):
    df = two_window_totals(retail(spark, small, *PREDICTED), WINDOWS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan or "Or(And(GreaterThanOrEqual(o_orderdate" in plan


def test_known_value_clusters(spark):
    """Regression values of the sf0.01 tables."""
    df = retail(spark, "/root/testdata/sf0.01", *PREDICTED)
    users = customer_value(df, WINDOWS, starts=("quantile",)).cache()
    # 1,177 customers ordered in that window; the orders of 8 of them have no lines.
    assert users.count() == 1169
    ltv = users.filter("ltv_cluster is not null")
    spans = ltv.groupBy("ltv_cluster").agg(F.count("*"), F.min("future_revenue"), F.max("future_revenue"))
    assert [tuple(r) for r in spans.orderBy("ltv_cluster").collect()] == [
        (0, 685, 0.0, 64831.6), (1, 341, 65184.1, 192127.0), (2, 131, 192718.1, 397590.2)
    ]
    users.unpersist()


def test_one_customer_has_no_deviation(spark):
    df = spark.createDataFrame([(0, 5.0)], "ltv_cluster int, future_revenue double")
    stats = {r.stat: r.value for r in ltv_describe(df).collect()}
    assert stats == {"count": 1, "mean": 5, "std": 0, "min": 5, "25%": 5, "50%": 5, "75%": 5, "max": 5}


@pytest.mark.parametrize(
    "profile, expected", [("all_data", "LLLMMHHHHH"), ("window", "LLLMMMHHHH")]
)
def test_score_boundaries(spark, profile, expected):
    df = spark.range(10).select("id", segment_of(F.col("id"), profile).alias("s")).orderBy("id")
    assert "".join(r.s[0] for r in df.collect()) == expected


def test_recency_direction_differs_between_profiles(spark, small):
    df = retail(spark, small)
    for profile, freshest in (("all_data", 0), ("window", 3)):
        row = segment(df, profile=profile).orderBy("recency").first()
        assert row.recency_cluster == freshest


def test_segment_counts_cover_all_customers(spark, small):
    segments = segment(retail(spark, small))
    counts = segment_counts(segments).collect()
    assert [r.segment for r in counts] == ["Low-Value", "Mid-Value", "High-Value"]
    assert sum(r.customers for r in counts) == segments.count()
    assert [r.customers for r in segment_counts(segments, "atlantis").collect()] == [0, 0, 0]


def test_unknown_profile(spark, small):
    with pytest.raises(ValueError):
        segment(retail(spark, small), profile="daily")


def test_segment_needs_country(spark, small):
    with pytest.raises(InvalidDataset, match="country"):
        segment(retail(spark, small, *PREDICTED))


def test_empty_window(spark, small):
    df = retail(spark, small, *PREDICTED)
    with pytest.raises(InvalidDataset, match="no customers"):
        future_value(df, "1980-01-01", "1981-01-01", "1981-02-01", "1982-01-01")


def test_nobody_came_back(spark, small):
    df = retail(spark, small, *PREDICTED)
    with pytest.raises(InvalidDataset, match="nothing is left"):
        future_value(df, "1997-01-01", "1998-01-01", "2020-01-01", "2021-01-01")


def test_report_as_json(spark, small):
    summaries = value_report(retail(spark, small, *PREDICTED), WINDOWS).cache()
    (row,) = report_json(summaries).collect()
    report = json.loads(row.report)
    assert report["error"] is False
    for r in summaries.collect():
        cell = report["data"][r.section]
        assert (cell[r.stat][r.key] if r.stat else cell[r.key]) == r.value
    summaries.unpersist()


def test_onehot_has_all_segments(spark):
    df = spark.createDataFrame([("a", "Mid-Value")], "customerid string, segment string")
    assert segment_onehot(df).collect()[0].asDict() == {
        "customerid": "a", "segment_low_value": 0, "segment_mid_value": 1, "segment_high_value": 0
    }


@pytest.fixture(scope="module")
def ltv(spark, small):
    return future_value(retail(spark, small, *PREDICTED), *DATES)


def test_features_leave_out_the_answer(ltv):
    assert feature_columns(ltv_features(ltv)) == [
        "recency", "recency_cluster", "frequency", "frequency_cluster", "monetary", "monetary_cluster",
        "overall_score", "segment_low_value", "segment_mid_value", "segment_high_value",
    ]
    assert "id_feature" in feature_columns(ltv_features(ltv, keep_id_feature=True))


@pytest.mark.parametrize("algo", ["forest", "boosted"])
def test_predictions(ltv, algo):
    found = train_predict(ltv, algo=algo, rounds=3)
    assert found.count() == ltv.count()
    assert found.filter("prediction not in (0, 1, 2)").count() == 0
    assert {r.is_test for r in found.select("is_test").distinct().collect()} == {True, False}


def test_unknown_algorithm(ltv):
    with pytest.raises(ValueError):
        train_predict(ltv, algo="oracle")


def test_quartiles_of_the_report_are_those_of_its_customers(spark, small):
    from tallyfold.plans.forecast import customer_value, value_report, value_summaries

    df = retail(spark, small, *PREDICTED)
    users = customer_value(df, WINDOWS, k=4)
    assert sorted(map(str, value_report(df, WINDOWS, k=4).collect())) == sorted(map(str, value_summaries(users).collect()))
