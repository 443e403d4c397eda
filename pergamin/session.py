"""Session construction and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "pergamin") -> SparkSession:
    """A session with adaptive execution on; every other setting is left to the cluster."""
    return importable(
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only on one machine is one of our own chosen where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pergamin-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of fewer partitions than cores one partition per core, before work that is heavy per row.

    Large inputs already have enough splits and are left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def write_through(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and read it again, in parts by the column ``by`` if named.

    For a result that several branches of a query read: none of them repeats the work or its Python stage, and a lost
    executor loses nothing. The tables of a context lie in one folder, which Spark deletes with it or, if so set, the cluster.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver runs outside its folder and the path is shared.

    On a cluster without a shared path, ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
