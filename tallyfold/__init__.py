"""Customer value analytics over retail transactions, on Spark DataFrames."""

from tallyfold.errors import InvalidDataset
from tallyfold.operators.clusters import cluster_1d, order_cluster
from tallyfold.operators.evaluation import accuracy, class_balance, classification_report, split
from tallyfold.operators.monthly import country_list, month_list
from tallyfold.operators.quantiles import column_quantiles, outlier_trim
from tallyfold.operators.records import read_records, records_json, write_records
from tallyfold.operators.rfm import rfm_by_country, rfm_metrics
from tallyfold.operators.scoring import scatter, score_profile, segment_counts, segment_onehot
from tallyfold.operators.sketches import (
    customer_sketches,
    distinct_customers_of,
    quantile_sketches,
    quantiles_of_sketches,
)
from tallyfold.operators.windows import Windows, future_revenue, window_slice, with_future_revenue
from tallyfold.plans.classification import ltv_features, train_predict
from tallyfold.plans.cleaning import clean, clean_and_rejected
from tallyfold.plans.description import describe
from tallyfold.plans.forecast import (
    customer_value,
    future_value,
    ltv_describe,
    ltv_summaries,
    report_json,
    value_report,
)
from tallyfold.plans.segments import segment
from tallyfold.session import build_session, materialise, release
from tallyfold.sources.files import allowed_file, read_transactions
from tallyfold.sources.store import read_cleaned, write_cleaned

__all__ = [
    "InvalidDataset", "Windows", "accuracy", "allowed_file", "build_session", "class_balance",
    "classification_report", "clean", "clean_and_rejected", "cluster_1d", "column_quantiles",
    "country_list", "customer_sketches", "customer_value", "describe", "distinct_customers_of",
    "future_revenue", "future_value", "ltv_describe", "ltv_features", "ltv_summaries",
    "materialise", "month_list", "order_cluster", "outlier_trim", "quantile_sketches",
    "quantiles_of_sketches", "read_cleaned", "read_records", "read_transactions", "records_json", "release", "report_json",
    "rfm_by_country", "rfm_metrics", "scatter", "score_profile", "segment", "segment_counts",
    "segment_onehot", "split", "train_predict", "value_report", "window_slice",
    "with_future_revenue", "write_cleaned", "write_records",
]
