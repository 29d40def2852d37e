"""Gives the executors this package, where they cannot import it from a path of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python files of the application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        target = Path(folder, "doctide.zip")
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        kept = Path(tempfile.gettempdir()).resolve() / f"doctide-{context.applicationId}.zip"
        kept.write_bytes(target.read_bytes())
    context.addPyFile(str(kept))
