import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyfold import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        partitions=4,
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def transactions(spark):
    """Clean transactions from (customer, moment, quantity, price[, country]) rows."""

    def build(rows, country=True):
        names = ["customerid", "invoicedate", "quantity", "unitprice"] + ["country"] * country
        df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
        return df.withColumn("invoicedate", df.invoicedate.cast("timestamp_ntz"))

    return build
