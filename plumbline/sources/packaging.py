"""Makes the package importable in Python workers, wherever they start."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[2]
    name = os.path.join(tempfile.mkdtemp(prefix="plumbline-code-"), "plumbline_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in [*sorted((root / "plumbline").rglob("*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
