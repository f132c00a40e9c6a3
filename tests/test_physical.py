"""What Spark is asked to do: scans, pushed filters, columns read, shuffles."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import tallyfold as tf
from tallyfold_checks.views import WINDOWS, retail
from tallyfold.operators import rfm
from tallyfold.operators.windows import two_window_totals
from tallyfold.session import shared_folder


@pytest.fixture(scope="module")
def flat(spark, small, tmp_path_factory):
    """Clean transactions at rest, as the engine would meet them."""
    path = str(tmp_path_factory.mktemp("flat") / "sales.parquet")
    retail(spark, small).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    return [set(c.split(",")) for c in re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan(df)))]


def test_monthly_figures_read_their_columns_only(flat):
    assert scanned(tf.describe(flat, "transactions")) == [{"invoicedate"}]
    assert scanned(tf.describe(flat, "quantity")) == [{"invoicedate", "quantity"}]
    assert scanned(tf.describe(flat, "revenue", "nation_3", empty_means_all=True)) == [
        {"invoicedate", "quantity", "unitprice", "country"}
    ]


def test_totals_take_one_scan_and_one_shuffle(flat):
    totals = rfm.customer_totals(flat)
    assert scanned(totals) == [{"customerid", "invoicedate", "quantity", "unitprice"}]
    assert plan(totals).count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan(totals)


def test_totals_by_country_shuffle_lines_once_then_pairs(flat):
    totals = rfm.customer_country_totals(flat)
    assert len(scanned(totals)) == 1
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(totals))
    assert [len(re.findall(r"#", e)) for e in exchanges] == [1, 2]


def test_both_windows_are_pushed_into_one_scan(flat):
    totals = two_window_totals(flat, WINDOWS)
    assert len(scanned(totals)) == 1
    assert "Or(And(GreaterThanOrEqual(invoicedate,1997-01-01T00:00)" in plan(totals)
    assert "Join" not in plan(totals)


def test_slice_is_pushed(flat):
    assert "PushedFilters: [IsNotNull(invoicedate), GreaterThanOrEqual(invoicedate" in plan(
        tf.window_slice(flat, "1997-01-01", "1998-01-01")
    )


def test_labels_are_a_projection(flat):
    segments = tf.segment(flat)
    shown = plan(segments)
    assert "Join" not in shown and "hashpartitioning" not in shown
    assert len(scanned(segments)) == 2  # the written totals, and their latest date


def test_segments_do_not_go_back_to_the_transactions(flat):
    assert "sales.parquet" not in plan(tf.segment(flat)) and "sales.parquet" not in plan(
        tf.customer_value(flat, WINDOWS)
    )


def test_labels_are_renumbered_without_moving_rows(flat):
    lines = flat.withColumn("label", (F.col("quantity") % 3).cast("int"))
    shown = plan(tf.order_cluster(lines, "label", "unitprice"))
    assert "BroadcastHashJoin" in shown and "hashpartitioning" not in shown


def test_clean_is_one_narrow_stage(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_text("No,Quantity,Invoice Date,Unit Price,Customer ID\n1,2,2011-01-01,3,x\n")
    assert "Exchange" not in plan(tf.clean(tf.read_transactions(spark, str(path))))


def test_no_python_in_the_plans(flat):
    for df in (tf.describe(flat, "revenue"), tf.segment(flat), tf.value_report(flat, WINDOWS), tf.records_json(flat)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


@pytest.mark.parametrize("settings", [{}, {"spark.checkpoint.dir": "file:/tmp/x"}, {"spark.sql.warehouse.dir": "file:/tmp/x"}])
def test_cluster_session_needs_a_shared_folder(settings):
    bare = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: settings.get(name, default)),
        sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(bare)


def on_cluster(spark, settings, **others):
    """The session as one of a cluster would look, whose machines all mount the local folders."""
    parts = {
        "conf": SimpleNamespace(get=lambda name, default=None: settings.get(name, default)),
        "sparkContext": SimpleNamespace(master="spark://host:7077", applicationId="app", defaultParallelism=3),
        "range": spark.range, "read": spark.read, "_jvm": spark._jvm, "_jsc": spark._jsc,
    }
    return SimpleNamespace(**parts | others)


@pytest.mark.parametrize("name", ["spark.checkpoint.dir", "spark.sql.warehouse.dir"])
def test_mounted_folder_is_shared(spark, tmp_path, name):
    for _ in range(2):
        assert shared_folder(on_cluster(spark, {name: f"file:{tmp_path}"})) == f"file:{tmp_path}/tallyfold-app"
    assert not list((tmp_path / "tallyfold-app").iterdir())  # the trial is gone


def test_folder_that_loses_what_executors_write_is_refused(spark, tmp_path):
    lost = on_cluster(spark, {"spark.checkpoint.dir": f"file:{tmp_path}"}, range=lambda *_: spark.range(0, 1, 1, 1))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(lost)


def test_scratch_tables_lie_in_the_configured_folder(spark):
    df = tf.materialise(spark.range(5))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.agg(F.sum("id")).collect()[0][0] == 10
