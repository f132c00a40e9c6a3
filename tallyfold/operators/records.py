"""Rows as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import timestamp_text
from tallyfold.operators.cleaning import is_temporal
from tallyfold.sources.files import read_transactions

#: Records of a file at most.
FILE_RECORDS = 1_000_000

_MANIFEST = "file string, bytes long, records long"


def printable(df: DataFrame) -> DataFrame:
    """Timestamps as text, everything else as it is."""
    return df.withColumns({c: timestamp_text(F.col(c)) for c in df.columns if is_temporal(df, c)})


def records_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in a single text column."""
    return printable(df).select(F.to_json(F.struct("*")).alias("record"))


def manifest_path(path: str) -> str:
    """Where the manifest of the records at ``path`` lies: beside them."""
    return f"{path.rstrip('/')}.manifest"


def write_records(df: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write the records as JSON lines, ``file_records`` a file at most, and last a manifest of the files.

    The manifest has name, bytes and records of each file, as read back. Where it is missing, or
    does not fit the files, the write did not end or something happened to them since.
    """
    spark = df.sparkSession
    records_json(df).write.option("maxRecordsPerFile", file_records).text(path)
    found = spark.read.text(path).groupBy(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    found.agg(F.count("*").alias("records")).write.json(manifest_path(path))


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records that ``write_records`` wrote, if all of them are there as they were written."""
    try:
        listed = spark.read.schema(_MANIFEST).json(manifest_path(path), mode="FAILFAST")
    except AnalysisException:
        raise InvalidDataset(f"{path} has no manifest: its records were not written to the end") from None
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("there")
    )
    both = listed.join(files.filter("there > 0"), "file", "full").filter("NOT (bytes <=> there)")
    wrong = both.orderBy("file").first()
    if wrong is not None:
        raise InvalidDataset(f"{path}: {wrong['file']} has {wrong['there'] or 0} bytes and should have {wrong['bytes'] or 0}")
    return read_transactions(spark, path, fmt="jsonl", schema=schema)
