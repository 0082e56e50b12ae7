"""Session settings that the operators rely on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "growthlens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, adaptive plans and ANSI arithmetic; `settings` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed but its folder is shared."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    return spark
