"""Sizes that decide how many blocks and shards a job is dealt over, and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a key with more than this share of the rows is hot: there are fewer than 1 / HOT_SHARE of them
HOT_SHARE = 1e-3


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column (one aggregate over one column)."""
    r = docs.select(F.octet_length(F.col(column)).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return r.n, int(r.b or 0)


def pieces(total: int, each: int) -> int:
    return max(1, -(-total // each))


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, copies: str, total: Column | int) -> DataFrame:
    """Left join on ``key`` where ``lookup`` has one row per key and says in ``copies`` how many rows share it.

    Keys with more than HOT_SHARE of all rows go by broadcast: fewer than 1 / HOT_SHARE lookup rows, whatever
    the size of the tables.  All others are joined by shuffle, and no key there holds more than that share.
    """
    hot = lookup.where(F.col(copies) > total * F.lit(HOT_SHARE))
    rest = lookup.where(~(F.col(copies) > total * F.lit(HOT_SHARE)))
    marked = rows.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"))), key, "left")
    return (marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, "left")
            .unionByName(marked.where("_hot is null").drop("_hot").join(rest, key, "left")))
