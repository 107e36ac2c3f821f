"""Make this package importable by the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors once per application, as a zip that Spark's file server hands out."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp())  # on the driver, whose file server hands the zip out until it ends
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "annalist_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for place, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    out.write(full, os.path.join("annalist", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
