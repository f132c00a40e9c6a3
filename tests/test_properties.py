"""Laws that hold for any transactions."""

from datetime import datetime
from decimal import Decimal

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tallyfold as tf
from tallyfold_checks.views import PREDICTED, retail

few = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
lines = st.lists(
    st.tuples(
        st.sampled_from("abcd"),
        st.datetimes(
            min_value=datetime(2010, 1, 1),
            max_value=datetime(2011, 12, 31),
        ),
        st.integers(-20, 20),
        st.integers(0, 10**6),
        st.sampled_from("xyz"),
    ),
    min_size=1,
    max_size=40,
)


def frame(spark, rows):
    text = [(c, str(d), str(q), str(Decimal(p) / 100), n) for c, d, q, p, n in rows]
    df = spark.createDataFrame(
        text, "customerid string, invoicedate string, quantity string, unitprice string, country string"
    )
    return df.withColumn("invoicedate", F.col("invoicedate").cast("timestamp_ntz"))


@few
@given(rows=lines)
def test_months_add_up(spark, rows):
    df = frame(spark, rows)
    revenue = tf.describe(df, "revenue").agg(F.sum("revenue")).collect()[0][0] or 0
    assert abs(revenue - float(sum(Decimal(q * p) / 100 for _, _, q, p, _ in rows))) < 1e-6
    assert tf.describe(df, "transactions").agg(F.sum("transactions")).collect()[0][0] == len(rows)


@few
@given(rows=lines)
def test_countries_partition_the_transactions(spark, rows):
    df = frame(spark, rows)
    total = 0
    for country in "xyz":
        months = tf.describe(df, "transactions", country).collect()
        assert [m.month for m in months] == [m.month for m in tf.month_list(df).collect()]
        total += sum(m.transactions for m in months)
    assert total == len(rows)


@few
@given(rows=lines)
def test_metrics_against_plain_python(spark, rows):
    found = {r.customerid: r for r in tf.rfm_metrics(frame(spark, rows)).collect()}
    latest = max(d for _, d, *_ in rows)
    for customer in {c for c, *_ in rows}:
        own = [r for r in rows if r[0] == customer]
        row = found[customer]
        assert row.frequency == len(own)
        assert row.recency == (latest - max(r[1] for r in own)).days
        assert abs(row.monetary - float(sum(Decimal(r[2] * r[3]) / 100 for r in own))) < 1e-6


@few
@given(values=st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=60), share=st.floats(0, 1))
def test_quantiles_against_numpy(spark, values, share):
    df = spark.createDataFrame([(v / 100,) for v in values], "x double")
    (row,) = tf.column_quantiles(df, "x", (share,)).collect()
    assert np.isclose(row.value, np.quantile(np.array(values) / 100, share), rtol=1e-9, atol=1e-9)


def test_slices_partition_the_history(spark, small):
    df = retail(spark, small, *PREDICTED)
    edges = [f"{year}-01-01" for year in range(1995, 2003)]
    parts = [tf.window_slice(df, a, b).count() for a, b in zip(edges, edges[1:])]
    assert sum(parts) == df.count()
