from tallyfold import rfm_by_country, rfm_metrics, segment
from tallyfold.operators.rfm import customer_country_totals


def test_sub_day_recency(transactions):
    df = transactions([("a", "2011-01-31 23:00:00", "1", "1", "x"), ("b", "2011-02-01 01:00:00", "1", "1", "x")])
    assert {r.customerid: r.recency for r in rfm_metrics(df).collect()} == {"a": 0, "b": 0}


def test_recency_across_daylight_saving(spark, transactions):
    df = transactions([("a", "2011-03-13 01:00:00", "1", "1", "x"), ("b", "2011-03-14 00:59:59", "1", "1", "x"), ("c", "2011-03-14 01:00:00", "1", "1", "x")])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = {r.customerid: r.recency for r in rfm_metrics(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == {"a": 1, "b": 0, "c": 0}


def test_customer_of_two_countries(transactions):
    df = transactions([("a", "2011-01-01", "2", "1.5", "x"), ("a", "2011-01-03", "1", "1", "y"), ("b", "2011-01-04", "1", "7", "x")])
    rows = {(r.customerid, r.country): (r.recency, r.frequency, r.monetary) for r in rfm_by_country(df).collect()}
    assert rows == {("a", "x"): (1, 2, 4.0), ("a", "y"): (1, 2, 4.0), ("b", "x"): (0, 1, 7.0)}


def test_same_money_as_exact_decimals(transactions):
    df = transactions([("a", "2011-01-01", "1", "0.1", "x")] * 3)
    assert rfm_metrics(df).collect()[0].monetary == 0.3


def test_fact_table_is_scanned_once(spark, small):
    from tallyfold_checks.views import retail

    plan = customer_country_totals(retail(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_layout_does_not_matter(spark, small):
    from tallyfold_checks.views import retail

    df = retail(spark, small)
    one = segment(df.repartition(1)).collect()
    many = segment(df.repartition(13, "invoicedate")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_hot_customer_leaves_few_rows_to_shuffle(spark):
    """A third of all lines are one customer's: partial sums go out once per map task."""
    df = spark.range(0, 90000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'guest', cast(id as string)) as customerid",
        "timestamp_ntz'2011-01-01' as invoicedate", "'1' as quantity", "'2' as unitprice",
        "cast(id % 5 as string) as country",
    )
    rows = {r.customerid: r for r in customer_country_totals(df).filter("customerid = 'guest'").collect()}
    assert (rows["guest"].frequency, float(rows["guest"].monetary)) == (30000, 60000.0)
    plan = customer_country_totals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(customerid")
