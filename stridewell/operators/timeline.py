"""Ordered timelines of entities, their split in time, and what is new after it.

One account may hold a third of all events, so nothing here sorts an account in one task: a timeline is cut into blocks
of time, rows are numbered within a block, and each block starts where the account's earlier blocks end. A block with
more rows than a task should sort is cut into as many shorter ones as its rows fill tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored

BLOCK_S = 30 * 86_400
#: Rows of one block that a task sorts.
TASK_ROWS = 2_000_000


def ordered(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("t", "item", "seq"), block_s: int = BLOCK_S, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add rn (1..n in the key's order), n (the key's rows) and prev (the row before, a struct of `order`, or null).

    `order` must be a total order that starts with a time in seconds.
    """
    at = F.struct(*order)
    b = events.withColumn("_block", F.floor(F.col(order[0]) / F.lit(block_s)))
    size = [F.count(F.lit(1)).alias("_m"), F.max(at).alias("_last")]
    sizes = stored(b.groupBy(key, "_block").agg(*size))
    full = sizes.filter(F.col("_m") > task_rows).select(key, "_block", F.ceil(F.col("_m") / task_rows).alias("_parts"))
    if full.isEmpty():
        b, sizes = (x.withColumn("_part", F.lit(0).cast("bigint")) for x in (b, sizes))
    else:
        # at most rows / task_rows blocks are that full
        part = F.coalesce(F.floor((F.col(order[0]) - F.col("_block") * block_s) * F.col("_parts") / block_s), F.lit(0).cast("bigint"))
        b = b.join(F.broadcast(full), [key, "_block"], "left").withColumn("_part", part).drop("_parts")
        sizes = b.groupBy(key, "_block", "_part").agg(*size)
    line = Window.partitionBy(key).orderBy("_block", "_part")  # as many rows a key as it has blocks
    blocks = sizes.select(
        key, "_block", "_part",
        F.coalesce(F.sum("_m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy(key)).alias("n"),
        F.lag("_last").over(line).alias("_edge"),
    )
    inner = Window.partitionBy(key, "_block", "_part").orderBy(*order)
    numbered = b.withColumn("_i", F.row_number().over(inner)).withColumn("_p", F.lag(at).over(inner))
    return numbered.join(blocks, [key, "_block", "_part"]).withColumn("rn", F.col("_i") + F.col("_before")).withColumn("prev", F.coalesce("_p", "_edge")).drop("_block", "_part", "_i", "_p", "_before", "_edge")


def cut_of(n: Column, test_frac: float = 0.2) -> Column:
    """Events before the cut: the first 1 - test_frac of n, rounded down (in whole numbers for a fifth)."""
    if test_frac == 0.2:
        return F.floor(n * 4 / 5)
    return F.floor(n * F.lit(1 - test_frac))


def split(line: DataFrame, min_events: int = 20, test_frac: float = 0.2) -> DataFrame:
    """Of an ordered timeline, the rows of keys with at least `min_events` events, with cut and held (after the cut)."""
    return line.filter(F.col("n") >= min_events).withColumn("cut", cut_of(F.col("n"), test_frac)).withColumn("held", F.col("rn") > F.col("cut"))


def seen_before(parts: DataFrame) -> DataFrame:
    """Distinct user_id, item before the cut."""
    return parts.filter("not held").select("user_id", "item").distinct()


def held_out(parts: DataFrame) -> DataFrame:
    """The events after the cut, with is_novel: the item does not occur in the user's events before it."""
    past = seen_before(parts).withColumn("_old", F.lit(True))
    return parts.filter("held").join(past, ["user_id", "item"], "left").withColumn("is_novel", F.col("_old").isNull()).drop("_old")


def popularity(parts: DataFrame) -> DataFrame:
    """item, pop: events before the cut."""
    return parts.filter("not held").groupBy("item").agg(F.count(F.lit(1)).alias("pop"))


def first_visits(line: DataFrame) -> DataFrame:
    """user_id, item, rn of the first and last event of each item in a timeline."""
    return line.groupBy("user_id", "item").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.count(F.lit(1)).alias("visits"))
