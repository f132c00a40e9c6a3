"""Cleaned transactions at rest, laid out for date windows and countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import SALE_MONTH, month_of

#: Rows of a file at most.
FILE_ROWS = 4_000_000


def write_cleaned(df: DataFrame, path: str, folders: Sequence[str] = (SALE_MONTH,), file_rows: int = FILE_ROWS) -> None:
    """Write cleaned transactions as Parquet, with a folder for each month or for each value of ``folders``.

    ``folders`` may name columns of ``df``, such as the country, beside or in place of the
    month of sale, which is added. Rows are dealt to tasks by ranges of folder and date, so a
    folder gets few files and each file few days, sorted; a day that holds most rows is dealt to
    several tasks, as rows of one moment are told apart by where they were. A file has
    ``file_rows`` rows at most. Folders keep text and months only (see ``read_cleaned``). Date windows and countries then leave out whole folders (see
    ``window_slice`` and ``monthly``), and parts of files by the smallest and largest date in them.
    """
    if SALE_MONTH in df.columns:
        raise InvalidDataset(f"the dataset has a column {SALE_MONTH} already")
    for name in folders:
        if name not in (*df.columns, SALE_MONTH):
            raise InvalidDataset(f"the dataset has no column {name}")
        if name != SALE_MONTH and not isinstance(df.schema[name].dataType, StringType):
            raise InvalidDataset(f"folders are named after text, which column {name} is not")
    dated = df.withColumn(SALE_MONTH, month_of(F.col("invoicedate"))) if SALE_MONTH in folders else df
    place = "__place"
    order = [*folders, "invoicedate", place]
    ranged = dated.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.drop(place).write.partitionBy(*folders).option("maxRecordsPerFile", file_rows).parquet(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_cleaned`` wrote; folders' values are text, not what they look like, but for the month."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = spark.read.parquet(path).schema
    finally:
        spark.conf.set(name, before)
    fields = [StructField(SALE_MONTH, DateType()) if f.name == SALE_MONTH else f for f in found]
    return spark.read.schema(StructType(fields)).parquet(path)
