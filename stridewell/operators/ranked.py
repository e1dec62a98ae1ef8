"""Row numbers inside classes, and joins on keys, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, cls: list[str], order: list[str], total: int, name: str = "rank", bucket_rows: int = 100_000) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each class, in an order fixed by the hash of `order` (a row's unique id).

    A class may hold a third of all rows: classes are split into hash buckets of about `bucket_rows`, numbered apart,
    and each bucket starts where the class's earlier ones end. `total` is the number of rows, to choose the buckets.
    """
    n = max(1, -(-total // bucket_rows))
    b = rows.withColumn("_num_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    local = b.withColumn("_num_i", F.row_number().over(Window.partitionBy(*cls, "_num_b").orderBy(*order)) - 1)
    if n == 1:
        return local.withColumn(name, F.col("_num_i").cast("bigint")).drop("_num_b", "_num_i")
    sizes = b.groupBy(*cls, "_num_b").agg(F.count(F.lit(1)).alias("_num_n"))
    before = sizes.withColumn("_num_at", F.coalesce(F.sum("_num_n").over(Window.partitionBy(*cls).orderBy("_num_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_num_n")
    return local.join(before, [*cls, "_num_b"]).withColumn(name, F.col("_num_i") + F.col("_num_at")).drop("_num_b", "_num_i", "_num_at")


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", task_rows: int = 2_000_000) -> DataFrame:
    """many join one on `key`, where `one` has at most a row per key and a key may hold a third of the rows of `many`.

    Keys with more than `task_rows` rows are spread over as many parts as they fill tasks, and their row of `one` goes to
    each part. There are at most rows / task_rows such keys, so their list is broadcast.
    """
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > task_rows).select(key, F.ceil(F.col("_n") / task_rows).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    left = many.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts)).drop("_parts")
    right = one.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
