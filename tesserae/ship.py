"""Makes this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once; Spark's own file server hands them to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    out = Path(tempfile.mkdtemp(prefix="tesserae-")) / f"tesserae-{digest}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in files:
            z.write(p, f"tesserae/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._tesserae_shipped = True
