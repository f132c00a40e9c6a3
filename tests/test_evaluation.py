import pytest

from tallyfold import accuracy, class_balance, classification_report, split

PAIRS = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0), (2, 1)]


def test_report(spark):
    """Class 2 is never predicted: its precision, recall and F1 are 0."""
    pairs = spark.createDataFrame(PAIRS, "label int, prediction int")
    rows = {r.row: r for r in classification_report(pairs).collect()}
    assert (rows["0"].precision, rows["0"].recall, rows["0"].f1) == (pytest.approx(3 / 6), 3 / 4, pytest.approx(0.6))
    assert tuple(rows["1"])[1:] == (pytest.approx(2 / 4), 2 / 4, pytest.approx(0.5), 4)
    assert tuple(rows["2"])[1:] == (0, 0, 0, 2)
    assert rows["accuracy"].f1 == 0.5 and rows["accuracy"].support == 10
    assert rows["macro avg"].recall == pytest.approx((0.75 + 0.5) / 3)
    assert rows["weighted avg"].precision == pytest.approx((0.5 * 4 + 0.5 * 4) / 10)


def test_class_that_only_occurs_as_a_prediction(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 7)], "label int, prediction int")
    rows = {r.row: r for r in classification_report(pairs).collect()}
    assert tuple(rows["7"])[1:] == (0, 0, 0, 0)
    assert rows["macro avg"].recall == 0.25


def test_accuracy(spark):
    pairs = spark.createDataFrame(PAIRS, "label int, prediction int")
    assert accuracy(pairs).collect()[0].accuracy == 0.5


def test_class_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (2,)], "ltv_cluster int")
    assert {r.ltv_cluster: r.share for r in class_balance(df).collect()} == {0: 0.5, 1: 0.25, 2: 0.25}


def test_split_depends_on_key_and_seed_only(spark):
    df = spark.range(1500).selectExpr("cast(id as string) as customerid")
    chosen = {r.customerid for r in split(df).filter("is_test").collect()}
    again = {r.customerid for r in split(df.repartition(7)).filter("is_test").collect()}
    other = {r.customerid for r in split(df, seed=1).filter("is_test").collect()}
    assert chosen == again != other
    assert 0.15 < len(chosen) / 1500 < 0.25
