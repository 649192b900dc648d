"""The package's own source, for the Python workers of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

import kilnwork


def ship(spark: SparkSession) -> None:
    """Add the package to what Python workers load, once a session, so that it needs no installation for them.

    Executors fetch it. A stateful stream also starts a worker beside the
    driver, which knows only the environment it is given, so the path is named
    there; on other machines it names nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_kilnwork_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(kilnwork.__file__))
    folder = tempfile.mkdtemp(prefix="kilnwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "kilnwork.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for inner, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(inner, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = f"{path}{os.pathsep}{known}" if known else path
    context._kilnwork_shipped = True
