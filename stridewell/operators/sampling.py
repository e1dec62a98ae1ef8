"""Seeded draws that depend on each row's own key only, so that they are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash32(seed: int, *cols: Column | str) -> Column:
    """A number of 32 random bits from the seed and the row's key."""
    parts = [F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *cols: Column | str) -> Column:
    """Uniform in (0, 1)."""
    return (hash32(seed, *cols).cast("double") + 0.5) / 4294967296.0


def race_key(seed: int, weight: Column, *cols: Column | str) -> Column:
    """Exponential clock with rate `weight`: the smallest keys of a pool are a weighted draw without replacement."""
    return -F.log(uniform(seed, *cols)) / weight


def sample_keys(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n of the distinct keys, uniformly without replacement."""
    return keys.select(key).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def take_per_group(df: DataFrame, group: list[str], n: int, by: list[Column], rank: str = "_rank") -> DataFrame:
    """The first n rows of each group by `by`; Spark cuts each partition to n before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col(rank) <= n)
