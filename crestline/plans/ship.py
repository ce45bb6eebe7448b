"""Making the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once per application, unless workers find it by path already."""
    sc = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if sc.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in known):
        return
    _shipped.add(sc.applicationId)
    target = Path(tempfile.mkdtemp(prefix="crestline-")) / "crestline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "crestline").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
