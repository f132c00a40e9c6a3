"""Reading transaction files: CSV, JSON and Parquet; files, folders or globs."""

from __future__ import annotations

import json
import posixpath
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyfold.errors import InvalidDataset
from tallyfold.sources import pieces

_JSON = {"mode": "FAILFAST", "primitivesAsString": True}
_OPTIONS = {"mode": "FAILFAST", "primitivesAsString": "true"}
_CSV = {"mode": "FAILFAST", "escape": '"'}
FORMATS = ("csv", "json", "jsonl", "parquet")
# Formats whose first column is a row index.
INDEXED = ("csv",)


def extension(path: str) -> str:
    """What follows the last dot of the last path element, in lower case."""
    name = posixpath.basename(path.rstrip("/"))
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def allowed_file(path: str) -> bool:
    """Whether the name ends in a format that can be read."""
    return extension(path) in FORMATS


def read_transactions(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    drop_first_column: bool | None = None,
    schema: StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A transaction file as text columns, untouched otherwise.

    ``fmt`` is taken from the extension unless given. The first column of a CSV file is a
    row index and left out by default. CSV files are read by the names in their own
    headers, whatever their order; a row with more or fewer fields than its header fails
    the query. Line breaks inside quotes need ``multiline``. ``json`` is one array of records a
    file, ``jsonl`` has a record per line. Many tasks read one file of any format; arrays and
    ``multiline`` take a pass over the data first. JSON takes another one to learn its columns
    unless a ``schema`` is given. What is cut off, malformed, or follows the array fails, with
    the file and the byte for arrays.
    """
    fmt = (fmt or extension(path)).lower()
    if fmt not in FORMATS:
        raise ValueError(f"cannot read {path}: the format must be one of {', '.join(FORMATS)}")
    if drop_first_column is None:
        drop_first_column = fmt in INDEXED
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv" and multiline:
        return _read_quoted_csv(spark, path, schema, drop_first_column)
    if fmt == "csv":
        return _read_csv(spark, path, schema, drop_first_column)
    if fmt == "parquet":
        df = reader.parquet(path)
    elif fmt == "jsonl":
        df = _read_json_lines(spark, path, schema)
    else:
        df = _read_json_arrays(spark, path, schema)
    return df.drop(df.columns[0]) if drop_first_column and df.columns else df


def _strings(df: DataFrame):
    """A frame of one text column as a dataset of strings, which Spark's own readers take."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def _json_schema(texts: DataFrame, schema: StructType | str | None) -> StructType:
    """``schema``, or what Spark learns from a pass over JSON texts."""
    if isinstance(schema, str):
        return StructType.fromDDL(schema)
    if schema is not None:
        return schema
    learned = texts.sparkSession.read.options(**_JSON)._jreader.json(_strings(texts))
    return StructType.fromJson(json.loads(learned.schema().json()))


def _read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    """Lines of one record. Spark's own reader stops after the first value of a line and says nothing of others.

    Here a line is read as what stands between the brackets of an array, so all of it counts:
    records with commas between them are all read, anything else fails.
    """
    lines = spark.read.text(path)
    lines = lines.where(F.trim(F.col("value"), F.lit(" \t\r\n")) != "")
    array = F.concat(F.lit("["), "value", F.lit("]"))
    kind = _json_schema(lines.select(array), schema)
    further = [F.col(f"`{c}`") for c in lines.columns[1:]]
    if not kind.fields:
        return lines.select(*further)
    parsed = F.from_json(array, ArrayType(kind), _OPTIONS).alias("value")
    missing = F.raise_error(F.lit("malformed: a line holds null in place of a record")).cast(ArrayType(kind))
    rows = F.when(F.forall("value", lambda r: r.isNotNull()), F.col("value")).otherwise(missing)
    return lines.select(parsed, *further).select(F.inline(rows), *further)


def _read_json_arrays(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    records = pieces.scan(spark, path, pieces.JSON).records()
    kind = _json_schema(records.select("text"), schema)
    further = [F.col(f"`{c}`") for c in records.columns[1:]]
    if not kind.fields:
        return records.select(*further)
    return records.select(F.from_json("text", kind, _OPTIONS).alias("row"), *further).select("row.*", *further)


def _read_quoted_csv(
    spark: SparkSession, path: str, schema: StructType | str | None, drop_first_column: bool
) -> DataFrame:
    """CSV with line breaks inside quotes: records are found first, then read like lines."""
    found = pieces.scan(spark, path, pieces.CSV)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    ranges = Counter(start.path for start in found.starts.values())
    named: dict[str, tuple[str, ...]] = {}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in found.paths.values():
        head = found.heads.get(file)
        if head is None and ranges[file] > 1:
            raise InvalidDataset(f"{file} has no header in its first range of bytes")
        if head is None:
            continue  # an empty file
        if head not in named:
            line = spark.createDataFrame([(head,)], "text string")
            named[head] = tuple(spark.read.options(header=True, **_CSV)._jreader.csv(_strings(line)).columns())
            if schema is not None and list(named[head]) != schema.names:
                raise InvalidDataset(f"{file} has the columns {', '.join(named[head])}")
        groups.setdefault(named[head], []).append(file)

    def read(names: tuple[str, ...], paths: list[str]) -> DataFrame:
        kind = schema or _texts(names)
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kind)
        records = found.records(paths)
        further = [F.col(f"`{c}`") for c in records.columns[1:]]
        row = F.from_csv("text", columns, _CSV | {"multiLine": "true"}).alias("row")
        df = records.select(row, *further).select("row.*", *further)
        return df.drop(df.columns[0]) if drop_first_column else df

    if not groups:
        raise InvalidDataset(f"{path} holds no header")
    return _by_name(groups, read)


def _read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None,
    drop_first_column: bool,
) -> DataFrame:
    """Files with the same header are one read; reads are put together by column name."""

    def read(paths, kind) -> DataFrame:
        reader = spark.read.schema(kind).option("enforceSchema", False).option("columnPruning", False)
        df = reader.csv(paths, header=True, **_CSV)
        return df.drop(df.columns[0]) if drop_first_column and df.columns else df

    if schema is not None:
        return read(path, schema)
    first = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    files = first.inputFiles()
    groups = _by_header(spark, files, first.columns)
    return _by_name(groups, lambda names, paths: read(paths, _texts(names))) if groups else first


def _texts(names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _by_name(
    groups: dict[tuple[str, ...], list[str]], read: Callable[[tuple[str, ...], list[str]], DataFrame]
) -> DataFrame:
    """The files of each header, put together by column name."""
    whole: DataFrame | None = None
    for names, paths in groups.items():
        part = read(names, paths)
        if whole is not None and set(part.columns) != set(whole.columns):
            raise InvalidDataset(f"{paths[0]} has other columns than the files before it")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _by_header(
    spark: SparkSession, files: list[str], names: list[str]
) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, from their first lines: one job for all files."""
    if len(files) < 2:
        return {tuple(names): files} if files else {}
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), "_metadata.file_block_start")
    started = lines.filter("file_block_start = 0").withColumn("place", F.monotonically_increasing_id())
    heads = started.groupBy("file").agg(F.min_by("value", "place").alias("head"))
    headers: dict[str, list[str]] = {}
    for r in heads.orderBy("file").collect():  # a row per file, as Spark's own listing has
        headers.setdefault(r["head"], []).append(r["file"])
    found: dict[tuple[str, ...], list[str]] = {}
    for paths in headers.values():
        own = tuple(spark.read.csv(paths[0], header=True, inferSchema=False, escape='"').columns)
        found.setdefault(own, []).extend(paths)
    return found
