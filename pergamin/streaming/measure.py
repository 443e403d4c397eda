"""The engine over a stream: measuring is stateless, so the same expressions serve a stream and a table; only counts keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergamin.functions import text as X


def texts(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored(stream: DataFrame, text: str = "text") -> DataFrame:
    """Metrics and score of every text as it arrives; no state."""
    return X.with_score(X.with_metrics(stream, text), text)


def quality_by_window(stream: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Texts, mean score and poor ones by window of ``time`` and step. Rows later than ``late`` are left out by the watermark,
    which bounds the state to the open windows."""
    groups = [F.window(time, window).alias("window"), "step"]
    return scored(stream).withWatermark(time, late).groupBy(*groups).agg(F.count("*").alias("texts"), F.avg("score").alias("mean_score"), F.count_if(F.col("label") == "poor").alias("poor"))
