"""Joins on keys that may be hot: any key may be that of a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if at least one of so many rows has it, so there are at most so many hot keys; and rows it is looked for in, about.
HOT, LOOKED_AT = 200, 50_000


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Keys of at least a HOT-th of ``rows``, at most HOT of them, counted within every task first.

    They decide how a join is carried out and nothing of its result, so they are looked for in about LOOKED_AT of the rows: none
    that matters is missed. ``total``: the number of rows if known; else they are counted.
    """
    total = rows.count() if total is None else total
    share = min(1.0, LOOKED_AT / max(total, 1))
    some = rows.select(keys) if share == 1 else rows.select(keys).sample(share, 7)
    return some.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total * share / HOT, 10)).drop("_n")


def join(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows.join(other, keys, how)`` for inner, left and left_semi joins to an ``other`` of unique keys.

    Rows with hot keys meet the few rows of ``other`` with these keys, which are broadcast as there are at most HOT of them, and
    stay in their tasks; all other rows are shuffled by key, no key being that of many. Rows with a null key find nothing and
    are not shuffled at all. Read ``rows`` from a table or a cheap plan: they are read three times.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    hot = F.broadcast(hot_keys(rows.where(known), keys, total))
    cold = rows.where(known).join(hot, keys, "left_anti").join(other, keys, how)
    warm = rows.where(known).join(hot, keys, "left_semi").join(F.broadcast(other.join(hot, keys, "left_semi")), keys, how)
    found = cold.unionByName(warm)
    if how == "left":
        found = found.unionByName(rows.where(~known), allowMissingColumns=True)
    return found
