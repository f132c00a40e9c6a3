"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import tallyfold as tf
from tallyfold_checks.views import (
    PREDICTED,
    RETAIL,
    WINDOWS,
    dirty,
    purchases,
    retail,
    supplier_country,
    table,
)
from tallyfold.functions import numbers
from tallyfold.operators import cleaning, rfm
from tallyfold.operators.scoring import segment_sizes, segment_value
from tallyfold.plans import forecast
from tallyfold.session import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

# The SQL side repeats this one start; the library's default tries three.
START = ("quantile",)
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Double results that engines add up in different orders, to six places."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# Files


def _scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


#: Copies of the tables as files, written once in an application.
_COPIES: dict[tuple[str, str, str], str] = {}


def _copy(spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _COPIES:
        path = _scratch_path(spark, name)
        write(dirty(spark, sf_dir), path)
        _COPIES[key] = path
    return _COPIES[key]


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', emptyValue="", mode="append")


def _csv_copy(spark: SparkSession, sf_dir: str) -> str:
    return _copy(spark, sf_dir, "invoices.csv", _write_csv)


@query
def scan_csv(spark, sf_dir):
    return tf.read_transactions(spark, _csv_copy(spark, sf_dir))


@query
def scan_csv_folder(spark, sf_dir):
    """Two kinds of files in one folder, their columns in different orders."""

    def write(df: DataFrame, path: str) -> None:
        first, *rest = df.columns
        odd = F.col(first).cast("long") % 2 == 1
        _write_csv(df.filter(odd), path)
        _write_csv(df.filter(~odd).select(first, *reversed(rest)), path)

    return tf.read_transactions(spark, _copy(spark, sf_dir, "folder.csv", write))


@query
def scan_json(spark, sf_dir):
    return tf.read_transactions(spark, _copy(spark, sf_dir, "invoices.jsonl", lambda df, path: df.write.json(path)))


#: Order keys of one array.
ARRAY_KEYS = 1 << 15


@query
def scan_json_array(spark, sf_dir):
    """Files that hold one array of records each; nothing but a test needs to write them."""

    def write(df: DataFrame, path: str) -> None:
        record = F.to_json(F.struct("*"))
        dealt = df.select(F.expr(f"bigint(`{df.columns[0]}`) div {ARRAY_KEYS}").alias("part"), record.alias("record"))
        arrays = dealt.groupBy("part").agg(F.collect_list("record").alias("records"))
        text = arrays.select(F.concat(F.lit("["), F.array_join("records", ",\n"), F.lit("]")))
        text.write.option("maxRecordsPerFile", 1).text(path)

    return tf.read_transactions(spark, _copy(spark, sf_dir, "invoices.json", write))


@query
def scan_csv_quoted(spark, sf_dir):
    """Files with a note in each row: line breaks, quotes and separators inside quotes."""

    def write(df: DataFrame, path: str) -> None:
        first, key = df.columns[0], F.col(df.columns[0]).cast("long")
        note = F.concat(F.lit('to "'), F.col("Country"), F.lit('",\n'), F.col(first), F.lit("\n\n,x"))
        noted = F.when(key % 3 == 0, note).when(key % 3 == 1, F.concat(F.lit("plain "), F.col(first)))
        _write_csv(df.withColumn("Note", noted), path)

    return tf.read_transactions(spark, _copy(spark, sf_dir, "quoted.csv", write), multiline=True)


@query
def scan_dispatch(spark, sf_dir):
    return tf.read_transactions(spark, _copy(spark, sf_dir, "invoices.PARQUET", lambda df, path: df.write.parquet(path)))


@query
def records_json(spark, sf_dir):
    clean = cleaning.lowercase_all(retail(spark, sf_dir), keep=["invoicedate"])
    return tf.records_json(clean)


@query
def records_round_trip(spark, sf_dir):
    """Records written in files of bounded length, and read after their manifest was compared with them."""
    write = lambda df, path: tf.write_records(df, path, file_records=20_000)
    return tf.read_records(spark, _copy(spark, sf_dir, "records", write))


# Cleaning


@query
def normalise_missing(spark, sf_dir):
    return cleaning.normalise_missing(dirty(spark, sf_dir))


@query
def drop_incomplete(spark, sf_dir):
    return cleaning.drop_incomplete(cleaning.normalise_missing(dirty(spark, sf_dir)))


@query
def incomplete_rows(spark, sf_dir):
    return cleaning.incomplete_rows(cleaning.normalise_missing(dirty(spark, sf_dir)))


@query
def lowercase_all(spark, sf_dir):
    return cleaning.lowercase_all(dirty(spark, sf_dir))


@query
def normalise_names(spark, sf_dir):
    return cleaning.normalise_names(dirty(spark, sf_dir))


@query
def parse_dates(spark, sf_dir):
    named = cleaning.normalise_names(dirty(spark, sf_dir, bad_dates=True))
    return cleaning.parse_dates(named, strict=False).select("invoiceno", "invoicedate")


@query
def lenient_numbers(spark, sf_dir):
    df = cleaning.normalise_names(dirty(spark, sf_dir))
    return df.select(
        "invoiceno",
        numbers.lenient_number(df, "quantity").cast("double").alias("quantity"),
        numbers.line_value(df, lenient=True).cast("double").alias("monetary"),
    )


@query
def line_value(spark, sf_dir):
    df = retail(spark, sf_dir, *PREDICTED)
    return df.select(
        "customerid", "invoicedate", numbers.line_value(df).cast("double").alias("monetary")
    )


@query
def clean_transactions(spark, sf_dir):
    return tf.clean(tf.read_transactions(spark, _csv_copy(spark, sf_dir)))


@query
def clean_counts(spark, sf_dir):
    """How many rows the cleaner dropped, for which columns and why: noted while the clean rows were written."""
    counts = Observation()
    materialise(tf.clean(dirty(spark, sf_dir), counts=counts))
    noted = [(name, value) for name, value in counts.get.items() if value]
    return spark.createDataFrame(noted, "name string, lines long")


@query
def clean_rejected(spark, sf_dir):
    """The rows that the cleaner drops, and for which columns, written beside those it keeps in one pass."""
    kept, rejected = tf.clean_and_rejected(dirty(spark, sf_dir), _scratch_path(spark, "sides"))
    sides = [kept.withColumn("missing", F.lit("")), rejected.withColumn("missing", F.array_join("missing_values", ","))]
    shown = ("invoiceno", "stockcode", "quantity", "country", "missing")
    return sides[0].select(*shown).unionByName(sides[1].select(*shown))


# Monthly description


def _describe(df: DataFrame, metric: str, **options) -> DataFrame:
    return tf.describe(df, metric, **options).drop("month_start")


@query
def month_list(spark, sf_dir):
    return tf.month_list(retail(spark, sf_dir, "invoicedate")).select("month")


@query
def country_list(spark, sf_dir):
    return tf.country_list(retail(spark, sf_dir, "country"))


@query
def monthly_revenue(spark, sf_dir):
    return _describe(retail(spark, sf_dir, "invoicedate", "quantity", "unitprice"), "revenue")


@query
def monthly_revenue_lenient(spark, sf_dir):
    return _describe(tf.clean(dirty(spark, sf_dir).drop("Invoice No")), "revenue")


@query
def monthly_revenue_growth(spark, sf_dir):
    df = retail(spark, sf_dir, "invoicedate", "quantity", "unitprice")
    return _rounded(_describe(df, "revenue_growth"), "revenue_growth")


@query
def monthly_quantity(spark, sf_dir):
    return _describe(retail(spark, sf_dir, "invoicedate", "quantity"), "quantity")


@query
def monthly_customers(spark, sf_dir):
    return _describe(retail(spark, sf_dir, "invoicedate", "customerid"), "customers")


@query
def monthly_transactions(spark, sf_dir):
    return _describe(retail(spark, sf_dir, "invoicedate"), "transactions")


@query
def monthly_revenue_country(spark, sf_dir):
    return _describe(retail(spark, sf_dir), "revenue", country="nation_3")


@query
def monthly_customers_country(spark, sf_dir):
    return _describe(retail(spark, sf_dir), "customers", country="nation_3")


@query
def monthly_revenue_fallback(spark, sf_dir):
    return _describe(retail(spark, sf_dir), "revenue", country="atlantis", empty_means_all=True)


def _stored(spark, sf_dir, folder: str = "sale_month") -> DataFrame:
    """The transactions at rest, in folders by month or country."""
    key = (spark.sparkContext.applicationId, sf_dir, folder)
    if key not in _COPIES:
        path = _scratch_path(spark, "stored")
        tf.write_cleaned(retail(spark, sf_dir), path, folders=(folder,))
        _COPIES[key] = path
    return tf.read_cleaned(spark, _COPIES[key])


@query
def stored_transactions(spark, sf_dir):
    amounts = ("quantity", "unitprice")
    return _stored(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in amounts})


@query
def monthly_revenue_stored(spark, sf_dir):
    return _describe(_stored(spark, sf_dir, "country"), "revenue", country="nation_3")


@query
def monthly_customers_stored(spark, sf_dir):
    return _describe(_stored(spark, sf_dir, "country"), "customers", country="nation_3")


@query
def window_slice_stored(spark, sf_dir):
    sliced = tf.window_slice(_stored(spark, sf_dir), WINDOWS.rfm_start, WINDOWS.rfm_end)
    return sliced.select(*RETAIL).withColumns({c: F.col(c).cast("double") for c in ("quantity", "unitprice")})


@query
def customers_by_quarter(spark, sf_dir):
    """Distinct customers from sketches of months and countries: how many exactly, and whether the sketches come within 3 %."""
    df = retail(spark, sf_dir, "customerid", "invoicedate", "country")
    sketches = tf.customer_sketches(df)
    quarter = F.trunc("month_start", "quarter").alias("quarter")
    found = tf.distinct_customers_of(sketches, [quarter]).withColumnRenamed("customers", "estimate")
    exact = df.groupBy(F.trunc(F.col("invoicedate").cast("date"), "quarter").alias("quarter")).agg(
        F.count_distinct("customerid").alias("customers")
    )
    near = F.abs(F.col("estimate") - F.col("customers")) <= 0.03 * F.col("customers")
    return exact.join(found, "quarter").select("quarter", "customers", near.alias("near"))


# Recency, frequency, monetary value


@query
def last_purchase(spark, sf_dir):
    return rfm.last_purchase(retail(spark, sf_dir, "customerid", "invoicedate"))


@query
def recency(spark, sf_dir):
    return rfm.recency(retail(spark, sf_dir, "customerid", "invoicedate"))


@query
def recency_purchases(spark, sf_dir):
    return rfm.recency(purchases(spark, sf_dir))


@query
def frequency(spark, sf_dir):
    return rfm.frequency(retail(spark, sf_dir, "customerid", "invoicedate"))


@query
def monetary(spark, sf_dir):
    return rfm.monetary(retail(spark, sf_dir, "customerid", "quantity", "unitprice"))


@query
def distinct_customers(spark, sf_dir):
    return rfm.distinct_customers(retail(spark, sf_dir, "customerid"))


@query
def customer_countries(spark, sf_dir):
    return rfm.customer_countries(supplier_country(spark, sf_dir))


@query
def rfm_metrics(spark, sf_dir):
    return tf.rfm_metrics(retail(spark, sf_dir, *PREDICTED))


@query
def rfm_by_country(spark, sf_dir):
    return tf.rfm_by_country(supplier_country(spark, sf_dir))


# Clusters and segments


def _metric_clusters(metric: str, method: str) -> Query:
    def run(spark, sf_dir):
        df = tf.rfm_metrics(retail(spark, sf_dir, *PREDICTED)).select("customerid", metric)
        return tf.cluster_1d(df, metric, 4, f"{metric}_cluster", method=method, starts=START)

    return run


for _metric in ("recency", "frequency", "monetary"):
    QUERIES[f"{_metric}_clusters"] = _metric_clusters(_metric, "lloyd")
    QUERIES[f"{_metric}_clusters_ml"] = _metric_clusters(_metric, "ml")


@query
def monetary_clusters_optimal(spark, sf_dir):
    """Customers in the four clusters of money with the least squared error there is."""
    df = tf.rfm_metrics(retail(spark, sf_dir, *PREDICTED)).select("customerid", "monetary")
    return tf.cluster_1d(df, "monetary", 4, "monetary_cluster", method="optimal")


@query
def quantity_clusters_optimal(spark, sf_dir):
    """Lines by quantity: few values, each in very many rows."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return tf.cluster_1d(df, "l_quantity", 4, "label", method="optimal", ascending=False).drop("l_quantity")


@query
def default_clusters_gap(spark, sf_dir):
    """The deviation that the default, three starts of Lloyd's steps, leaves beside the least there is."""
    df = materialise(tf.rfm_metrics(retail(spark, sf_dir, *PREDICTED)).select("customerid", "monetary"))
    default = _spread(tf.cluster_1d(df, "monetary", 4, "label"), "monetary", "label").head()[0]
    least = _spread(tf.cluster_1d(df, "monetary", 4, "label", method="optimal"), "monetary", "label")
    near = F.lit(default).between((1 - 1e-9) * F.col("left_within"), 1.1 * F.col("left_within"))
    return least.select(F.round("left_within", 6).alias("least_within"), near.alias("default_near"))


@query
def order_cluster(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("label"), "l_extendedprice"
    )
    return tf.order_cluster(lines, "label", "l_extendedprice", ascending=False)


def _segments(spark, sf_dir) -> DataFrame:
    return tf.segment(retail(spark, sf_dir), starts=START)


def _window_segments(spark, sf_dir) -> DataFrame:
    slice_ = tf.window_slice(retail(spark, sf_dir, *PREDICTED), WINDOWS.rfm_start, WINDOWS.rfm_end)
    return tf.segment(slice_, profile="window", starts=START)


@query
def rfm_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query
def rfm_segments_many_countries(spark, sf_dir):
    return tf.segment(supplier_country(spark, sf_dir), starts=START)


@query
def segment_counts(spark, sf_dir):
    return tf.segment_counts(_segments(spark, sf_dir))


@query
def segment_counts_country(spark, sf_dir):
    return tf.segment_counts(_segments(spark, sf_dir), country="nation_3")


@query
def scatter_rvsm(spark, sf_dir):
    return tf.scatter(_segments(spark, sf_dir), "recency", "monetary")


@query
def scatter_thinned(spark, sf_dir):
    """Three points for each segment and cell of a grid at most."""
    return tf.scatter(_segments(spark, sf_dir), "recency", "monetary", grid=20, per_cell=3)


@query
def scatter_rvsf(spark, sf_dir):
    return tf.scatter(_segments(spark, sf_dir), "recency", "frequency", country="nation_3")


@query
def scatter_fvsm(spark, sf_dir):
    return tf.scatter(_segments(spark, sf_dir), "frequency", "monetary")


# Windows


@query
def window_slice(spark, sf_dir):
    sliced = tf.window_slice(retail(spark, sf_dir), WINDOWS.rfm_start, WINDOWS.rfm_end)
    amounts = ("quantity", "unitprice")
    return sliced.withColumns({c: F.col(c).cast("double") for c in amounts})


@query
def window_segments(spark, sf_dir):
    return _window_segments(spark, sf_dir)


@query
def window_customer_count(spark, sf_dir):
    slice_ = window_slice(spark, sf_dir)
    return rfm.distinct_customers(slice_).agg(F.count("customerid").alias("customerid"))


@query
def window_segment_counts(spark, sf_dir):
    return segment_sizes(_window_segments(spark, sf_dir))


@query
def window_segment_value(spark, sf_dir):
    return _rounded(segment_value(_window_segments(spark, sf_dir)), "monetary")


@query
def score_profile(spark, sf_dir):
    means = ("mean_recency", "mean_frequency", "mean_monetary")
    return _rounded(tf.score_profile(_window_segments(spark, sf_dir)), *means)


@query
def future_revenue(spark, sf_dir):
    df = retail(spark, sf_dir, *PREDICTED)
    return tf.future_revenue(df, WINDOWS.pred_start, WINDOWS.pred_end)


@query
def future_revenue_joined(spark, sf_dir):
    df = retail(spark, sf_dir, *PREDICTED)
    scored = rfm.distinct_customers(df.filter(WINDOWS.scored))
    return tf.with_future_revenue(
        scored, tf.future_revenue(df, WINDOWS.pred_start, WINDOWS.pred_end)
    )


@query
def revenue_p99(spark, sf_dir):
    found = tf.column_quantiles(future_revenue_joined(spark, sf_dir), "future_revenue", (0.99,))
    return found.select(F.round("value", 6).alias("p99"))


@query
def outlier_trim(spark, sf_dir):
    return tf.outlier_trim(future_revenue_joined(spark, sf_dir), "future_revenue")


# Value clusters


def _ltv(spark, sf_dir) -> DataFrame:
    df = retail(spark, sf_dir, *PREDICTED)
    return tf.future_value(
        df, WINDOWS.rfm_start, WINDOWS.rfm_end, WINDOWS.pred_start, WINDOWS.pred_end, starts=START
    )


@query
def ltv_clusters(spark, sf_dir):
    return _ltv(spark, sf_dir)


@query
def ltv_describe(spark, sf_dir):
    return _rounded(tf.ltv_describe(_ltv(spark, sf_dir)), "value")


@query
def ltv_counts(spark, sf_dir):
    return forecast.ltv_counts(_ltv(spark, sf_dir))


@query
def ltv_revenue(spark, sf_dir):
    return _rounded(forecast.ltv_revenue(_ltv(spark, sf_dir)), "future_revenue")


@query
def class_balance(spark, sf_dir):
    return _rounded(tf.class_balance(_ltv(spark, sf_dir)), "share")


@query
def value_report(spark, sf_dir):
    df = retail(spark, sf_dir, *PREDICTED)
    return _rounded(tf.value_report(df, WINDOWS, starts=START), "value")


@query
def ltv_summaries(spark, sf_dir):
    return _rounded(tf.ltv_summaries(_ltv(spark, sf_dir)), "value")


@query
def report_json(spark, sf_dir):
    return tf.report_json(value_report(spark, sf_dir))


# Classification


@query
def segment_onehot(spark, sf_dir):
    return tf.segment_onehot(_window_segments(spark, sf_dir).select("customerid", "segment"))


@query
def ltv_features(spark, sf_dir):
    return tf.ltv_features(_ltv(spark, sf_dir))


@query
def train_test_split(spark, sf_dir):
    customer = F.col("c_custkey").cast("string").alias("customerid")
    return tf.split(table(spark, sf_dir, "customer").select(customer))


@query
def ltv_predictions(spark, sf_dir):
    return tf.train_predict(_ltv(spark, sf_dir), algo="forest")


@query
def ltv_predictions_boosted(spark, sf_dir):
    return tf.train_predict(_ltv(spark, sf_dir), algo="boosted")


def _guesses(spark, sf_dir) -> DataFrame:
    """Value clusters against a guess from the money score, held-out customers only."""
    return tf.split(_ltv(spark, sf_dir)).filter("is_test").select(
        F.col("ltv_cluster").alias("label"),
        F.least(F.col("monetary_cluster"), F.lit(2)).alias("prediction"),
    )


@query
def accuracy(spark, sf_dir):
    return _rounded(tf.accuracy(_guesses(spark, sf_dir)), "accuracy")


@query
def classification_report(spark, sf_dir):
    report = tf.classification_report(_guesses(spark, sf_dir))
    return _rounded(report, "precision", "recall", "f1")


@query
def classification_report_lines(spark, sf_dir):
    """Every order line: return flag against a rule, one class of which never occurs."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", 0).when(flag == "N", 1).when(flag == "R", 2).otherwise(3)
    guess = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_quantity") > 25, 1).otherwise(4)
    pairs = table(spark, sf_dir, "lineitem").select(
        label.alias("label"), guess.alias("prediction")
    )
    return _rounded(tf.classification_report(pairs), "precision", "recall", "f1")


@query
def classifier_report(spark, sf_dir):
    """The report of a trained forest on the customers it has not seen."""
    predictions = tf.train_predict(_ltv(spark, sf_dir), algo="forest")
    return tf.classification_report(predictions.filter("is_test"))


# Columns that need many steps, many decimals, many digits or many groups


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") / 1_000_000).alias("x"))


@query
def skewed_clusters(spark, sf_dir):
    """An inverse of a digest: far more steps than a well-behaved column takes."""
    digest = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(2654435761) % 1000003
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(F.lit(10**12) / (1 + digest)).cast("long").alias("x")
    )
    return tf.cluster_1d(df, "x", 12, "label", starts=START).drop("x")


@query
def fine_clusters(spark, sf_dir):
    return tf.cluster_1d(_fine(spark, sf_dir), "x", 4, "label", starts=START).drop("x")


@query
def fine_quantiles(spark, sf_dir):
    found = tf.column_quantiles(_fine(spark, sf_dir), "x", (0.25, 0.5, 0.99))
    return found.withColumn("value", F.round("value", 12))


@query
def fine_trim(spark, sf_dir):
    return tf.outlier_trim(_fine(spark, sf_dir), "x").select("event_id")


@query
def quantiles_by_customer(spark, sf_dir):
    return tf.column_quantiles(table(spark, sf_dir, "events"), "value", (0.5,), by="user_id")


@query
def lenient_extremes(spark, sf_dir):
    """Text with more digits or decimals than money has; only what is no number becomes 0."""
    third, odd = F.col("l_orderkey") % 3, F.col("l_linenumber") % 2
    quantity = F.when(third == 0, "1e15").when(third == 1, "none").otherwise(F.col("l_quantity").cast("string"))
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        quantity.alias("quantity"),
        F.when(odd == 0, "0.00004").otherwise("2.5").alias("unitprice"),
    )
    return df.withColumns({c: numbers.lenient_number(df, c).cast("double") for c in ("quantity", "unitprice")})


def _ranked(df: DataFrame, found: DataFrame, by: str, value: str, error: float) -> DataFrame:
    """(by, probability, near): whether the share of rows up to each value found is as near as ``error`` to the probability."""
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("own"))
    below, upto = F.count_if(F.col("own") < F.col("value")) / F.count("*"), F.count_if(F.col("own") <= F.col("value")) / F.count("*")
    near = (below <= F.col("probability") + error) & (upto >= F.col("probability") - error)
    return rows.join(found, by).groupBy(by, "probability").agg(near.alias("near"))


@query
def approximate_quantiles(spark, sf_dir):
    """Quantiles of each kind of event from sketches in one pass, and whether they are within 3 % of their ranks."""
    events = table(spark, sf_dir, "events")
    found = tf.column_quantiles(events, "value", (0.1, 0.5, 0.99), by="event_type", rank_error=0.01)
    return _ranked(events, found, "event_type", "value", 0.03)


@query
def merged_quantiles(spark, sf_dir):
    """The same by flag, from sketches of days and flags that are merged."""
    lines = table(spark, sf_dir, "lineitem")
    sketches = materialise(tf.quantile_sketches(lines, "l_extendedprice", ["l_shipdate", "l_returnflag"]))
    found = tf.quantiles_of_sketches(sketches, (0.25, 0.5, 0.75, 0.99), ["l_returnflag"])
    return _ranked(lines, found, "l_returnflag", "l_extendedprice", 0.03)


@query
def approximate_describe(spark, sf_dir):
    """The description of value clusters in one pass: figures as ever, quartiles between the clusters' ends."""
    ltv = _ltv(spark, sf_dir)
    found = _rounded(tf.ltv_describe(ltv, rank_error=0.01), "value")
    quartile = F.col("stat").endswith("%")
    ends = ltv.groupBy("ltv_cluster").agg(F.min("future_revenue").alias("low"), F.max("future_revenue").alias("high"))
    inside = F.col("value").between(F.col("low") - 1e-6, F.col("high") + 1e-6)
    return found.join(ends, "ltv_cluster").select(
        "ltv_cluster", "stat", F.when(~quartile, F.col("value")).alias("value"), F.when(quartile, inside).alias("inside")
    )


# What is certain about trained models


@query
def ltv_predictions_known(spark, sf_dir):
    """Split and labels of the forest's rows, and whether each prediction is one of the labels."""
    found = tf.train_predict(_ltv(spark, sf_dir), algo="forest")
    return found.withColumn("known", F.col("prediction").between(0, 2)).drop("prediction")


@query
def ltv_predictions_fit(spark, sf_dir):
    """Whether the forest fits its training rows at least as well as always naming the largest class."""
    train = tf.train_predict(_ltv(spark, sf_dir), algo="forest").filter(~F.col("is_test"))
    sizes = train.groupBy("label").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == F.col("prediction")).alias("hits")
    )
    return sizes.agg(
        F.sum("rows").alias("train_rows"),
        F.max("rows").alias("largest_class"),
        (F.sum("hits") >= F.max("rows")).alias("fits"),
    )


@query
def model_accuracy(spark, sf_dir):
    """Accuracy of the forest on its training and its held-out rows."""
    found = tf.train_predict(_ltv(spark, sf_dir), algo="forest")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return found.groupBy("is_test").agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy"))


def _spread(df: DataFrame, value: str, label: str):
    """Share of the squared deviation of ``value`` that is left within clusters."""
    deviation = (F.var_pop(value) * F.count(value)).alias("deviation")
    whole = df.agg(deviation).head()[0]
    return df.groupBy(label).agg(deviation).agg((F.sum("deviation") / whole).alias("left_within"))


@query
def cluster_spread_ml(spark, sf_dir):
    """How tight the exact clusters of the money are, and that Spark ML's come within a tenth of that."""
    df = tf.rfm_metrics(retail(spark, sf_dir, *PREDICTED)).select("customerid", "monetary")
    exact = _spread(tf.cluster_1d(df, "monetary", 4, "label", starts=START), "monetary", "label")
    other = _spread(tf.cluster_1d(df, "monetary", 4, "label", method="ml"), "monetary", "label")
    close = F.lit(other.head()[0]) <= 1.1 * F.col("left_within")
    return exact.select(F.round("left_within", 6).alias("left_within"), close.alias("ml_close"))
