"""Joins whose hot keys do not land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key with more than this share of the rows is hot: there are fewer than 1 / HOT_SHARE of them
HOT_SHARE = 1e-3


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key`` where ``lookup`` has one row per key and says in ``weight`` how many rows share it.

    Keys with more than HOT_SHARE of all rows go by broadcast, fewer than 1 / HOT_SHARE of them whatever the size of the
    tables; their rows stay where they are.  All others are joined by shuffle.
    """
    hot = lookup.where(F.col(weight) > total * HOT_SHARE).drop(weight)
    rest = lookup.where(F.col(weight) <= total * HOT_SHARE).drop(weight)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
