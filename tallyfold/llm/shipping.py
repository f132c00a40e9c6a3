"""Sends this package's code to the executors, for sessions whose workers cannot import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session, its executors able to import the package. The driver serves the archive; nothing else is in it."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return spark
