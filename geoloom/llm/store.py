"""The package for Python workers, and tables in the shared folder."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from geoloom.sources.store import shared_dir, written

__all__ = ["shared_dir", "ship_package", "written"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever they start, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    path = Path(tempfile.mkdtemp(prefix="spark-geoloom-")) / f"{package.name}.zip"
    path.write_bytes(out.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
