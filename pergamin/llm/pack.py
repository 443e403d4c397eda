"""Problem 7: items of varying length into containers of a fixed capacity.

First-fit decreasing, run independently in randomised groups of rows: a row is hashed by its key, its size and its number among
the rows that are equal to it, so no key, however frequent, makes a group larger than another, and the result depends on
neither the order nor the partitions of the input. In a group a tournament tree over the room left in the
containers finds the first container that an item fits into in logarithmic time. Only (key, size) pairs are shuffled, once,
for all capacities together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group, about; one container of every group stays partly empty, so larger groups waste less and take longer.
GROUP_ROWS = 20_000
#: Equal rows numbered at once.
COPIES = 10_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all items: item, number within the item, size, and container (from 0).

    An item above the capacity fills containers of its own and only its rest is packed with the others; no other item is
    divided. Items without size go into container 0. Ties in size keep the order of the input.
    """
    sizes = np.asarray(sizes, np.int64)
    full = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - full * capacity
    whole_item = np.repeat(np.arange(len(sizes)), full)
    whole_number = np.arange(len(whole_item)) - np.repeat(np.cumsum(full) - full, full)
    item = np.flatnonzero((rest > 0) | (sizes <= 0))
    item = item[np.argsort(-rest[item], kind="stable")]
    leaves = 1
    while leaves < max(len(item), 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # of every subtree the largest room; containers not yet open are empty ones
    place = np.zeros(len(item), np.int64)
    for k, size in enumerate(np.maximum(rest[item], 0).tolist()):
        if size == 0:
            break  # the rest have no size: container 0
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        place[k] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            largest = left if left > right else right
            if room[node] == largest:
                break
            room[node] = largest
            node //= 2
    used = int(place.max()) + 1 if len(place) else 0
    return (
        np.concatenate([item, whole_item]),
        np.concatenate([full[item], whole_number]),
        np.concatenate([np.maximum(rest[item], 0), np.full(len(whole_item), capacity, np.int64)]),
        np.concatenate([place, used + np.arange(len(whole_item))]),
    )


def pack(items: DataFrame, targets: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens", group_rows: int = GROUP_ROWS, seed: int = 17, rows: int | None = None) -> DataFrame:
    """Rows (target_id, key, piece, n_tokens, group_no, container_no): where each item lies for every (target_id, capacity).

    A container is named by (target_id, group_no, container_no). Every row of ``items`` is an item of its own, repeated rows
    and null keys included. A null or non-positive size takes no room and lies in container 0 of its group. An empty table
    gives no rows; a capacity below 1 is an error. ``rows``: the number of items if known, else they are counted.
    """
    if any(capacity is None or capacity < 1 for _, capacity in targets):
        raise ValueError("a container must hold at least one unit")
    groups = max(1, math.ceil((items.count() if rows is None else rows) / group_rows))
    source = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    times = source.groupBy("_key", "_size").agg(F.count("*").alias("_times"))
    blocks = times.select("_key", "_size", "_times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES))).alias("_block"))
    first = F.col("_block") * COPIES
    source = blocks.select("_key", "_size", F.explode(F.sequence(first, F.least(F.col("_times"), first + COPIES) - 1)).alias("_copy"))
    source = source.withColumn("_group", F.pmod(F.xxhash64("_key", "_size", "_copy", F.lit(seed)), F.lit(groups)).cast("int"))
    schema = T.StructType(
        [
            T.StructField("target_id", T.IntegerType()),
            T.StructField(key, source.schema["_key"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("group_no", T.IntegerType()),
            T.StructField("container_no", T.IntegerType()),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_key", "ascending"), ("_copy", "ascending"), ("_size", "ascending")])
        keys, sizes = table.column("_key").combine_chunks(), table.column("_size").to_numpy()
        group, parts = table.column("_group")[0].as_py(), []
        for target, capacity in targets:
            item, piece, units, container = first_fit_decreasing(sizes, capacity)
            n = len(item)
            columns = [pa.array(np.full(n, target), pa.int32()), keys.take(pa.array(item)), pa.array(piece, pa.int32()), pa.array(units, pa.int64()), pa.array(np.full(n, group), pa.int32()), pa.array(container, pa.int32())]
            parts.append(pa.Table.from_arrays(columns, names=schema.names))
        return pa.concat_tables(parts)

    return source.groupBy("_group").applyInArrow(run, schema)


def fill(packed: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """Per target: containers used, the least number that could do, units held and share of the room that is filled.

    Aggregated per container first, so what is gathered per target is one row for each of its containers' partial sums.
    """
    capacity = packed.sparkSession.createDataFrame(targets, "target_id int, capacity long")
    held = packed.groupBy("target_id", "group_no", "container_no").agg(F.sum("n_tokens").alias("held"))
    total = held.groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    return total.join(F.broadcast(capacity), "target_id").select(
        "target_id",
        "capacity",
        "containers",
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
        "n_tokens",
        "fullest",
        F.try_divide(F.col("n_tokens"), F.col("containers") * F.col("capacity")).alias("filled"),
    )


def read_targets(targets: DataFrame) -> list[tuple[int, int]]:
    """The (target_id, capacity) pairs of the table of containers, of a few rows by its nature."""
    return [(r.target_id, r.capacity) for r in targets.select("target_id", "capacity").distinct().orderBy("target_id").collect()]
