"""Session settings and the scratch tables that cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_UNNAMED: set[str] = set()
#: Folders on a file system of machines, found to be one folder for all of them.
_REACHED: set[str] = set()


def build_session(master: str, partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tallyfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def _scheme(spark: SparkSession, folder: str) -> str:
    if ":" in folder.split("/", 1)[0]:
        return folder.split(":", 1)[0]
    system = spark._jvm.org.apache.hadoop.fs.FileSystem
    return system.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()


def _reached(spark: SparkSession, path: str) -> bool:
    """Whether the driver sees what the executors write to ``path``: a row from two tasks for each of their cores."""
    parts, trial = 2 * spark.sparkContext.defaultParallelism, f"{path}/{uuid.uuid4().hex}"
    spark.range(0, parts, 1, parts).write.parquet(trial)
    seen = len(spark.read.schema("id long").parquet(trial).inputFiles())
    _delete(spark, trial)
    return seen == parts


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    On a cluster a ``file:`` folder may be a mounted share or each machine's own disk, so
    the first use tries it, and it is refused if the driver does not see all that executors
    wrote. What a local session writes to the warehouse goes when Python ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = named or spark.conf.get("spark.sql.warehouse.dir", None) or "file:"
    own_disk = _scheme(spark, folder) == "file"
    path = f"{folder.rstrip('/')}/tallyfold-{context.applicationId}"
    if own_disk and not context.master.startswith("local") and path not in _REACHED:
        refused = "set spark.checkpoint.dir to a folder that all executors share"
        try:
            reached = folder != "file:" and _reached(spark, path)
        except Exception as error:
            raise RuntimeError(refused) from error
        if not reached:
            raise RuntimeError(refused)
        _REACHED.add(path)
    if not named and own_disk and path not in _UNNAMED:
        _UNNAMED.add(path)
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back from there.

    What follows no longer depends on the lineage of ``df``: a lost executor costs
    a re-read of the written table. Parquet rather than ``checkpoint()``, so that
    later steps read only the columns they need and join planning knows the size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a stored table as it stands, else written and read back."""
    plan = df._jdf.queryExecution().analyzed()
    stored = plan.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2Relation")
    return df if stored else materialise(df)


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is columns or rows of one table at rest, so that its parts can be read on their own."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2Relation")


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; frames built on them are dead after."""
    _delete(spark, shared_folder(spark))
