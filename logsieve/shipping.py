"""Send this repository's packages to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Once per session: the Python files below ``root`` as an archive that every task can import from.

    Needed where the executors don't share the driver's folders and the packages aren't installed there.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="logsieve-code-"), "code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, names, files in os.walk(root):
            names[:] = [n for n in names if not n.startswith(".") and n not in ("__pycache__", "tests")]
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
