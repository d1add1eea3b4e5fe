"""Send this library to the Python workers of a cluster that has no copy of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the library's source to the application once; Spark hands it to every worker."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="levelfield-source-")  # the driver serves it from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "levelfield.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
