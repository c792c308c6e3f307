"""Spark session with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "docquery", **conf: str) -> SparkSession:
    """A session with adaptive execution (joins skewed by one key are split at run time) and UTC times."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local sessions may do without it, with a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _own_roots:
            _own_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docquery-")
        root = _own_roots[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, where neither PYTHONPATH nor the working folder already does."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(p and Path(p).resolve() == root for p in known):
        return
    archive = Path(tempfile.mkdtemp(prefix="docquery-")) / "docquery.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "docquery").rglob("*.py")):
            out.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
