"""Tables in the shared folder that cut lineage and go when they are done with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyfold.session import shared_folder

#: Rows of a file, where their number is known: few rows in many shuffle partitions would be as many files, for each
#: of which a local file system starts programs, and as many tasks of what reads them.
FILE_ROWS = 25_000
#: Has Spark delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one job. A lost executor costs a re-read of them.

    ``drop`` deletes one that nothing reads any more; what the result reads stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` as a written table. ``rows``, about how many it has at most, only says into how many files they go."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
