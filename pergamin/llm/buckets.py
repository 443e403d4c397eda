"""Rows and the part of a corpus-wide dictionary that they need, side by side in one task.

A dictionary of a corpus has no bound, so it is not broadcast and not cut either: rows are dealt to buckets by a hash, every
bucket is given the entries its own rows hold, and a task reads the entries of a bucket first and its rows behind them, as a
stream. Memory depends on the size of a bucket and results on neither the number of buckets nor the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket, about; fewer if not all cores have one; and buckets at most (they get larger then).
BUCKET_ROWS, LEAST_ROWS, MOST_BUCKETS = 240_000, 20_000, 200_000


def number_of(rows: int, cores: int = 1) -> int:
    return max(1, min(math.ceil(rows / BUCKET_ROWS), MOST_BUCKETS), min(cores, math.ceil(rows / LEAST_ROWS)))


Reader = Callable[[Iterator[tuple[int, bool, pa.RecordBatch]]], Iterator[pa.RecordBatch]]


def read(entries: DataFrame, rows: DataFrame, buckets: int, group: list[str], order: list[str], reader: Reader, schema: str | T.StructType) -> DataFrame:
    """What ``reader`` makes of every bucket: it gets (bucket, whether these are entries, columns) of a task in order, of each
    bucket the entries before the rows, the rows of a ``group`` together and by ``order``. Both frames have ``bucket``, and a
    bucket is a partition; other columns of one name are shared."""
    none = F.lit(None).cast("long").alias("_group")  # a number first: comparing it decides nearly always
    both = entries.select("*", none).unionByName(rows.select("*", F.xxhash64(*group).alias("_group")), allowMissingColumns=True)
    dealt = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions(F.col("_group").asc_nulls_first(), *group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reader(parts(batches))

    return dealt.mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        is_row = batch.column("_group").is_valid().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (is_row[1:] != is_row[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(bucket[a]), not bool(is_row[a]), batch.slice(a, b - a)
