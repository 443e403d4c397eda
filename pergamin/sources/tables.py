"""Named Parquet tables of one archive folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a file or a folder of files. Pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
