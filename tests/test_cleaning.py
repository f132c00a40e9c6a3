import datetime

import pytest
from pyspark.sql import functions as F

from tallyfold import InvalidDataset, clean
from tallyfold.functions.dates import parse_date
from tallyfold.functions.numbers import lenient_number, strict_number
from tallyfold.functions.text import capitalise
from tallyfold.operators.cleaning import (
    drop_incomplete,
    incomplete_rows,
    lowercase_all,
    normalise_missing,
    normalise_names,
    parse_dates,
    require_columns,
)

RAW = "`Stock Code` string, Description string, Quantity string, `Invoice Date` string, " \
      "`Unit Price` string, `Customer ID` string, Country string"


def raw(spark, **changes):
    row = {
        "Stock Code": "85123A", "Description": "White Lantern", "Quantity": "6",
        "Invoice Date": "12/1/2010 8:26", "Unit Price": "2.55", "Customer ID": "17850",
        "Country": "United Kingdom",
    }
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], RAW)


def test_clean_row(spark):
    (row,) = clean(raw(spark)).collect()
    assert row.asDict() == {
        "stockcode": "85123a", "description": "white lantern", "quantity": "6",
        "invoicedate": datetime.datetime(2010, 12, 1, 8, 26), "unitprice": "2.55",
        "customerid": "17850", "country": "united kingdom",
    }


@pytest.mark.parametrize("token", ["", "NA", "N/A", "null", "NaN", "#N/A", "<NA>"])
@pytest.mark.parametrize("column", ["Customer ID", "Description"])
def test_missing_tokens_drop_the_row(spark, token, column):
    assert clean(raw(spark, **{column: token})).count() == 0


def test_token_spelling_matters(spark):
    assert clean(raw(spark, Description="Na")).count() == 1


def test_subset_keeps_rows_with_blanks_elsewhere(spark):
    kept = clean(raw(spark, Description=""), subset=["customerid"])
    assert [r.description for r in kept.collect()] == [None]


def test_name_collision(spark):
    with pytest.raises(InvalidDataset, match="unitprice"):
        normalise_names(spark.createDataFrame([("1", "2")], "`Unit Price` string, UnitPrice string"))


@pytest.mark.parametrize(
    "present, missing",
    [
        ([], "unitprice"),
        (["unitprice"], "invoicedate"),
        (["unitprice", "invoicedate"], "customerid"),
        (["customerid", "invoicedate", "unitprice"], "quantity"),
    ],
)
def test_first_missing_column_is_named(spark, present, missing):
    columns = present + ["other"]
    df = spark.createDataFrame([("x",) * len(columns)], ", ".join(f"{c} string" for c in columns))
    with pytest.raises(InvalidDataset, match=missing):
        require_columns(df)


def test_incomplete_rows_are_the_rejected_ones(spark):
    df = spark.createDataFrame(
        [("a", 1.0), (None, 2.0), ("c", float("nan")), ("d", None)], "s string, x double"
    )
    assert [r.s for r in drop_incomplete(df).collect()] == ["a"]
    assert {r.s for r in incomplete_rows(df).collect()} == {None, "c", "d"}


def test_missing_tokens_only_in_text(spark):
    df = spark.createDataFrame([("NA", 1)], "s string, n int")
    assert normalise_missing(df).collect()[0].asDict() == {"s": None, "n": 1}


def test_lowercase_all_makes_text(spark):
    df = lowercase_all(spark.createDataFrame([("AbC", True, 5)], "s string, b boolean, n int"))
    assert df.collect()[0].asDict() == {"s": "abc", "b": "true", "n": "5"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2010-12-01 08:26:00", (2010, 12, 1, 8, 26)),
        ("2010-12-01t08:26:00", (2010, 12, 1, 8, 26)),
        ("2010-12-01", (2010, 12, 1)),
        ("12/1/2010 8:26", (2010, 12, 1, 8, 26)),
        ("12/1/2010", (2010, 12, 1)),
        ("12/1/10 8:26", (2010, 12, 1, 8, 26)),
        ("13/1/2010 8:26", (2010, 1, 13, 8, 26)),
        ("12/1/2010 8:26:05 pm", (2010, 12, 1, 20, 26, 5)),
        ("1-dec-10", (2010, 12, 1)),
        ("01 dec 2010 08:26", (2010, 12, 1, 8, 26)),
        ("december 1, 2010", (2010, 12, 1)),
        ("20101201", (2010, 12, 1)),
        ("2010/12/1 8:26", (2010, 12, 1, 8, 26)),
        # Skipped or repeated by daylight saving in some zones, not on a wall clock.
        ("3/13/2011 2:30", (2011, 3, 13, 2, 30)),
        ("11/6/2011 1:30", (2011, 11, 6, 1, 30)),
        ("31/31/2011", None),
        ("some day", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(text,)], "s string")
        (row,) = df.select(parse_date(df.s).alias("d")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.d == (datetime.datetime(*expected) if expected else None)


def test_bad_date_fails_in_strict_mode(spark):
    with pytest.raises(Exception, match="31/31/2011"):
        clean(raw(spark, **{"Invoice Date": "31/31/2011"})).collect()


def test_typed_dates_are_only_cast(spark):
    df = spark.sql("select timestamp_ntz'2010-12-01 08:26:00' as invoicedate")
    assert parse_dates(df).collect()[0].invoicedate == datetime.datetime(2010, 12, 1, 8, 26)


@pytest.mark.parametrize(
    "text, lenient", [("abc", 0), ("nan", 0), ("infinity", 0), ("1d", 0), (" 5 ", 5), ("1e3", 1000), ("-2.5", -2.5)]
)
def test_lenient_numbers(spark, text, lenient):
    df = spark.createDataFrame([(text,)], "q string")
    assert float(df.select(lenient_number(df, "q")).collect()[0][0]) == lenient


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("text", ["abc", "nan", "infinity"])
def test_strict_numbers_fail(spark, text, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(text,)], "q string")
        with pytest.raises(Exception, match="no number"):
            df.select(strict_number(df, "q")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_capitalise_first_letter_only(spark):
    df = spark.createDataFrame([("united kingdom",), ("x",), ("",)], "s string")
    assert [r[0] for r in df.select(capitalise(df.s)).collect()] == ["United kingdom", "X", ""]


ROWS = [("1", "2", "2011-01-01", "x"), (None, "NA", "2011-01-01", "y"), ("", "null", None, "z"), ("2", "3", "2011-01-02", "")]


def _raw(spark):
    return spark.createDataFrame(ROWS, "`Unit Price` string, Quantity string, InvoiceDate string, CustomerID string")


def test_counts_are_noted_in_passing(spark):
    from pyspark.sql import Observation

    counts = Observation()
    df = clean(_raw(spark), counts=counts)
    assert sorted(r.customerid for r in df.collect()) == ["x"]
    found = {k: v for k, v in counts.get.items() if v}
    assert found == {
        "rows": 4, "dropped": 3, "null:unitprice": 1, "blank:unitprice": 1, "token:quantity": 2, "null:invoicedate": 1, "blank:customerid": 1,
    }
    assert sorted(map(str, df.collect())) == sorted(map(str, clean(_raw(spark)).collect()))


def test_counts_of_a_subset(spark):
    from pyspark.sql import Observation

    counts = Observation()
    kept = clean(_raw(spark), subset=["quantity", "invoicedate"], counts=counts)
    assert kept.count() == 2 and {r.customerid for r in kept.collect()} == {"x", None}
    assert counts.get["dropped"] == 2 and "null:unitprice" not in counts.get


def test_both_sides_from_one_scan(spark, tmp_path):
    from tallyfold import clean_and_rejected

    kept, rejected = clean_and_rejected(_raw(spark), str(tmp_path / "sides"))
    assert kept.columns == ["unitprice", "quantity", "invoicedate", "customerid"]
    assert [r.customerid for r in clean(kept).collect()] == ["x"]
    assert sorted((r.customerid, r.missing_values) for r in rejected.collect()) == [
        ("", ["blank:customerid"]),
        ("y", ["null:unitprice", "token:quantity"]),
        ("z", ["blank:unitprice", "token:quantity", "null:invoicedate"]),
    ]
    nan = spark.createDataFrame([(1.0, 2, "2011-01-01", "x"), (float("nan"), 2, "2011-01-01", "y")], "unitprice double, quantity int, invoicedate string, customerid string")
    kept, rejected = clean_and_rejected(nan, str(tmp_path / "nan"))
    assert kept.count() == 1 and rejected.first().missing_values == ["nan:unitprice"]


@pytest.mark.parametrize("kind", ["string", "double", "decimal(38,12)"])
@pytest.mark.parametrize("lenient", [False, True])
def test_tiny_numbers_fail_instead_of_becoming_zero(spark, kind, lenient):
    from tallyfold.functions import numbers

    read = numbers.lenient_number if lenient else numbers.strict_number
    def values(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string").select(F.col("x").cast(kind))
        return [float(r[0]) for r in df.select(read(df, "x").alias("x")).collect()]

    assert values("0", "0.00000001", "-2.5", "0.0") == [0, 1e-8, -2.5, 0]
    with pytest.raises(Exception, match="too many decimals"):
        values("0.000000001")


def test_line_value_of_typed_columns_is_a_plain_product(spark):
    from tallyfold.functions import numbers

    df = spark.createDataFrame([("2.5", "4"), (None, "1"), ("99999999999999.9999", "99999999999999.9999")], "unitprice string, quantity string")
    typed = df.select(*[F.col(c).cast("decimal(18,4)") for c in df.columns])
    product = numbers.line_value(typed)
    assert "double" not in str(product) and "raise_error" not in str(product)
    for lenient in (False, True):
        mine, general = (d.select(numbers.line_value(d, lenient).alias("v")).collect() for d in (typed, df))
        assert mine == general
