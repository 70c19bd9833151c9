"""Brings the package to the executors of a cluster on which it isn't installed."""

from __future__ import annotations

import os
import site
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def found_by_workers() -> bool:
    """Whether a worker started with the driver's environment imports the package by itself."""
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) + site.getsitepackages() + [site.getusersitepackages()]
    return str(ROOT.parent) in {os.path.realpath(p) for p in known if p}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for a session's context; workers import them from
    there. Nothing is done where they find the package anyway."""
    sc = spark.sparkContext
    if found_by_workers() or getattr(sc, "_quire_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "quire-sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(ROOT.rglob("*.py")):
            z.write(source, source.relative_to(ROOT.parent))
    sc.addPyFile(path)
    sc._quire_shipped = True
