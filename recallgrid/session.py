"""Sending the package to a session's Python workers, and the folder its written tables go to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Workers then need neither a shared code folder nor the driver's working directory.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="recallgrid-code-"), "recallgrid.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` where it is set.

    Unset, a cluster gets a folder in its warehouse, which executors share; a local master, as in tests, a temporary
    folder that is removed when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="recallgrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_roots[app] = "file://" + folder
        else:
            _own_roots[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own_roots[app]
