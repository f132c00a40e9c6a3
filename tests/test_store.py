"""Cleaned transactions at rest: folders, files read, rows unchanged."""

import re

import pytest
from pyspark.sql import functions as F

import tallyfold as tf
from tallyfold.errors import InvalidDataset
from tallyfold.operators.windows import two_window_totals
from tallyfold_checks.views import WINDOWS, retail


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "month")
    tf.write_cleaned(retail(spark, small), path)
    return tf.read_cleaned(spark, path)


@pytest.fixture(scope="module")
def by_country(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "country")
    tf.write_cleaned(retail(spark, small), path, folders=("country",))
    return tf.read_cleaned(spark, path)


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scan of a plan without shuffles opened."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def test_a_window_reads_the_files_of_its_months(stored):
    months = {m.isoformat()[:7] for (m,) in stored.select("sale_month").distinct().collect()}
    assert len(months) > 60
    everything = len(stored.inputFiles())
    one = tf.window_slice(stored, "1997-01-01", "1997-02-01")
    assert everything > 60 and files_read(one) == 1
    assert files_read(tf.window_slice(stored, "1997-01-31", "1997-02-02")) == 2
    assert one.agg(F.min("sale_month"), F.max("sale_month")).first()[0].isoformat() == "1997-01-01"


def test_windows_hold_the_same_rows(spark, small, stored):
    flat = retail(spark, small)
    for start, end in (("1997-01-15", "1997-02-01"), ("1997-03-01", "1997-03-02"), ("1996-12-31", "1998-01-01")):
        assert sorted(map(str, tf.window_slice(stored, start, end).drop("sale_month").select(flat.columns).collect())) == sorted(
            map(str, tf.window_slice(flat, start, end).collect())
        )
    both = [sorted(map(str, two_window_totals(df, WINDOWS).collect())) for df in (flat, stored)]
    assert both[0] == both[1]
    assert re.search(r"PartitionFilters: \[[^]]*sale_month", shown(two_window_totals(stored, WINDOWS)))


def test_files_are_sorted_and_bounded(spark, transactions, tmp_path):
    rows = [("a", "2011-01-31 23:00:00", "1", "2", "x")] * 500 + [(str(i), f"2011-02-{1 + i % 28:02}", "1", "2", None) for i in range(100)]
    tf.write_cleaned(transactions(rows), str(tmp_path / "t"), file_rows=100)
    read = tf.read_cleaned(spark, str(tmp_path / "t"))
    sizes = read.groupBy(F.input_file_name()).count()
    assert read.count() == 600 and sizes.agg(F.max("count")).first()[0] <= 100
    assert {r[0].isoformat() for r in read.select("sale_month").distinct().collect()} == {"2011-01-01", "2011-02-01"}


def test_folders_keep_text(spark, transactions, tmp_path):
    tf.write_cleaned(transactions([("a", "2011-01-01", "1", "2", "007"), ("a", "2011-01-01", "1", "2", None)]), str(tmp_path / "t"), ("country", "sale_month"))
    read = tf.read_cleaned(spark, str(tmp_path / "t"))
    assert sorted(r.country or "" for r in read.collect()) == ["", "007"]
    with pytest.raises(InvalidDataset, match="already"):
        tf.write_cleaned(read, str(tmp_path / "u"))
    with pytest.raises(InvalidDataset, match="no column town"):
        tf.write_cleaned(transactions([]), str(tmp_path / "u"), ("town",))
    with pytest.raises(InvalidDataset, match="text"):
        tf.write_cleaned(transactions([]).withColumn("country", F.lit(1)), str(tmp_path / "u"), ("country",))


@pytest.mark.parametrize("metric", ["revenue", "quantity", "customers", "transactions", "revenue_growth"])
def test_a_country_is_pushed_and_months_stay(spark, small, by_country, stored, metric):
    one_pass = tf.describe(retail(spark, small), metric, "nation_3")
    wanted = sorted(map(str, one_pass.collect()))
    for df, where in ((by_country, r"PartitionFilters: \[[^]]*nation_3"), (stored, r"PushedFilters: \[[^]]*EqualTo\(country,nation_3\)")):
        found = tf.describe(df, metric, "nation_3")
        assert sorted(map(str, found.collect())) == wanted
        plan = shown(tf.describe(df, metric, "nation_3"))
        assert re.search(where, plan)
    assert re.search(r"ReadSchema: struct<>", shown(tf.describe(stored, metric, "nation_3")))  # months from the folders' names
    assert re.search(r"ReadSchema: struct<invoicedate:timestamp_ntz>", shown(tf.describe(by_country, metric, "nation_3")))


def test_a_country_that_sold_nothing(by_country):
    found = tf.describe(by_country, "customers", "atlantis")
    assert found.count() == tf.month_list(by_country).count()
    assert {r.customers for r in found.collect()} == {0}
    assert {r.revenue for r in tf.describe(by_country, "revenue", "atlantis").collect()} == {None}
