"""Data-quality profiles of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(one_row: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Turn one row of struct columns into a row a column."""
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), *(F.col(f"`{n}`.{f}").alias(f) for f in fields)) for n in names))
    return one_row.select(F.inline(rows))


def missing(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null, share_null of every column, in one pass."""
    n = F.count(F.lit(1))
    stats = df.agg(*(F.struct(n.alias("n_rows"), (n - F.count(F.col(c))).alias("n_null"), F.round(F.try_divide(n - F.count(F.col(c)), n), 9).alias("share_null")).alias(c) for c in df.columns))
    return _long(stats, df.columns, ["n_rows", "n_null", "share_null"])


def schema(df: DataFrame) -> DataFrame:
    """column_name, kind, n_present, n_distinct of every column."""
    kinds = dict(df.dtypes)
    # one distinct count a column, each a two-stage aggregation of its own: no row is multiplied by the column count
    parts = [df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_present"), F.count(F.lit(1)).alias("n_distinct")).select(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), "n_present", "n_distinct") for c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extra_copies(df: DataFrame, name: str) -> DataFrame:
    """by_columns, n_extra: rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_extra")).select(F.lit(name).alias("by_columns"), "n_extra")


def value_counts(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values with count and share of the present ones; ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    top = counts.orderBy(F.desc("n"), column).limit(most)
    return top.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("_all"), 9).alias("share"))


def describe(df: DataFrame, column: str, n_name: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact linear quantiles of one column."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias(n_name), F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_samp(c), 9).alias("sd"), F.min(c).alias("least"),
        *(F.percentile(c, F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))), F.max(c).alias("most"),
    )


def support(df: DataFrame) -> DataFrame:
    """item, n_users: different users of each item. Distinct pairs first, so a popular item isn't one task's work."""
    return df.select("item", "user_id").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n_users"))
