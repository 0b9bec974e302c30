"""Hands this package to the executors' Python workers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session, once for each application and state of the code."""
    files = sorted(p for p in HERE.rglob("*.py"))
    tag = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    key = (spark.sparkContext.applicationId, tag)
    if key in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lakelink-"), f"lakelink-{tag}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, f"{HERE.name}/{p.relative_to(HERE)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)
