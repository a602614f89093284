"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of this application a copy of the package, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="factorspark-")) / f"{root.name}.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
