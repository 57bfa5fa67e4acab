"""Joins on keys that a great part of all rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key held by more than one in so many rows is hot; so there are at most as many hot keys.
HOT = 1000
SALTS = 64


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key) of the keys held by more than one in ``HOT`` rows: fewer than ``HOT`` by counting, so they may be broadcast."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") * HOT > total).select(F.col(key).alias("_hot"))


def hot_of(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``hot_keys`` of rows that are counted already: (key, n) with each key once."""
    return counts.where(F.col(n) * HOT > total).select(F.col(key).alias("_hot"))


def salted(rows: DataFrame, other: DataFrame, key: str, spread: Column, total: int, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt`` to join on beside ``key``.

    Rows of a hot key get one of ``SALTS`` salts by a hash of ``spread``; ``other``, which holds few rows
    for any key, repeats the hot ones once for each salt. ``total`` is the number of ``rows``,
    which are read twice and should be a written table, unless
    ``hot`` names the hot keys.
    """
    hot = F.broadcast(hot_keys(rows, key, total) if hot is None else hot)
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    mine = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    theirs = other.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return mine, theirs
