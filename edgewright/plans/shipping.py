"""The package for the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's sources to the workers of the session's application, once, wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        # the driver serves this file to the executors; nothing else reads it
        folder = tempfile.mkdtemp(prefix="edgewright-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as held:
            for source in sorted(package.rglob("*.py")):
                held.write(source, source.relative_to(package.parent))
        context.addPyFile(str(path))
    _shipped.add(context.applicationId)
