import pytest

from tallyfold import InvalidDataset, country_list, describe, month_list

ROWS = [
    ("a", "2011-01-05", "2", "10", "france"),
    ("a", "2011-01-31 23:59:59", "1", "abc", "france"),
    ("b", "2011-03-01", "-1", "4", "spain"),
    ("c", "2010-12-31", "3", "1", "france"),
    ("a", "2011-03-02", "1", "4", "spain"),
]


@pytest.fixture
def sales(transactions):
    return transactions(ROWS)


def values(df, metric):
    return [(r.month, r[metric]) for r in df.collect()]


def test_months_in_order(sales):
    assert [r.month for r in month_list(sales).collect()] == ["2010-12", "2011-1", "2011-3"]


def test_countries(sales):
    assert [tuple(r) for r in country_list(sales).collect()] == [("All", "All"), ("france", "France"), ("spain", "Spain")]


def test_revenue_is_null_where_it_is_zero(sales):
    assert values(describe(sales, "revenue"), "revenue") == [("2010-12", 3.0), ("2011-1", 20.0), ("2011-3", None)]


def test_absent_month_of_a_country(sales):
    assert values(describe(sales, "revenue", "france"), "revenue")[2] == ("2011-3", None)
    assert values(describe(sales, "quantity", "spain"), "quantity") == [("2010-12", None), ("2011-1", None), ("2011-3", None)]
    assert values(describe(sales, "customers", "spain"), "customers") == [("2010-12", 0), ("2011-1", 0), ("2011-3", 2)]
    assert values(describe(sales, "transactions", "spain"), "transactions") == [("2010-12", 0), ("2011-1", 0), ("2011-3", 2)]


def test_growth(sales):
    assert values(describe(sales, "revenue_growth"), "revenue_growth") == [
        ("2010-12", 0.0), ("2011-1", pytest.approx(1700 / 3)), ("2011-3", None)
    ]


def test_growth_from_an_empty_first_month(sales):
    growth = values(describe(sales, "revenue_growth", "spain"), "revenue_growth")
    assert growth[0] == ("2010-12", None)
    after_empty = describe(sales.filter("country = 'spain' or customerid = 'a'"), "revenue_growth")
    assert values(after_empty, "revenue_growth")[0] == ("2011-1", 0.0)


def test_first_month_empty_counts_as_one(transactions):
    df = transactions([("a", "2011-01-01", "0", "1", "x"), ("a", "2011-02-01", "5", "1", "x")])
    assert values(describe(df, "revenue_growth"), "revenue_growth") == [("2011-1", None), ("2011-2", 400.0)]


@pytest.mark.parametrize("metric", ["revenue", "quantity", "customers", "transactions", "revenue_growth"])
def test_unknown_country_can_mean_all(sales, metric):
    plain = describe(sales, metric, "atlantis")
    assert all(v in (None, 0) for _, v in values(plain, metric))
    assert values(describe(sales, metric, "atlantis", empty_means_all=True), metric) == values(describe(sales, metric), metric)
    assert values(describe(sales, metric, "spain", empty_means_all=True), metric) == values(describe(sales, metric, "spain"), metric)


def test_country_needs_its_column(transactions):
    df = transactions([r[:4] for r in ROWS], country=False)
    with pytest.raises(InvalidDataset):
        describe(df, "revenue", "france")
    assert describe(df, "revenue").count() == 3


def test_unknown_metric(sales):
    with pytest.raises(ValueError):
        describe(sales, "profit")


def test_customers_from_a_sketch(spark):
    df = spark.range(0, 60000).selectExpr(
        "cast(id % 5000 as string) as customerid", "timestamp_ntz'2011-01-01' as invoicedate"
    )
    (row,) = describe(df, "customers", approximate=True).collect()
    assert abs(row.customers - 5000) < 200
    (row,) = describe(df, "customers").collect()
    assert row.customers == 5000


def test_one_scan_per_figure(spark, small):
    from tallyfold_checks.views import retail

    df = describe(retail(spark, small), "revenue", "nation_3")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_quantity") and plan.count("Relation [l_orderkey") == 1
