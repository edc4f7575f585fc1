"""Session and table helpers shared by the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "voxlake", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """The active session, or a new one with the defaults this package is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; a table is one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
