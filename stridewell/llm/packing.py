"""Packing items into containers of one capacity with little space left over.

Items above a third of the capacity go at most two to a container: largest first, each is matched with the largest
other one that still fits. Smaller items, largest first, go to the container with the least sufficient gap. Items of a
size are interchangeable, so the plan is made on the histogram of sizes (as many numbers as the capacity, whatever the
data): it says which places of which containers the items of each size take, as ranges. Each item then looks up its
place by its number among the items of its size, which is computed without gathering a size in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import require_columns, stored
from ..operators.ranked import numbered
from .tokens import token_counts


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first item, end item, first container, items a container) ranges, and the number of containers."""
    left = {s: c for s, c in counts.items() if c and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item is larger than a container")
    used: dict[int, int] = defaultdict(int)  # items of a size that have a place
    spans: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> ranges of containers
    open_gaps: list[int] = []
    n_containers = 0

    def put(size: int, items: int, first: int, each: int = 1) -> None:
        spans.append((size, used[size], used[size] + items, first, each))
        used[size] += items

    def free(gap: int, first: int, end: int) -> None:
        if gap > 0 and end > first:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, end))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((x for x in large if x <= s and x + s <= capacity and left[x] >= (2 if x == s else 1)), None)
            if mate is None:
                k = left[s]
                put(s, k, n_containers)
                free(capacity - s, n_containers, n_containers + k)
                left[s] = 0
            elif mate == s:
                k = left[s] // 2
                put(s, 2 * k, n_containers, 2)
                free(capacity - 2 * s, n_containers, n_containers + k)
                left[s] -= 2 * k
            else:
                k = min(left[s], left[mate])
                put(s, k, n_containers)
                put(mate, k, n_containers)
                free(capacity - s - mate, n_containers, n_containers + k)
                left[s] -= k
                left[mate] -= k
            n_containers += k
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(open_gaps, s)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, end = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            else:
                gap, first, end = capacity, n_containers, n_containers + -(-left[s] // (capacity // s))
                n_containers = end
            # the best fit of the next item of this size is the container just used, until it is full
            each = gap // s
            full = min(end - first, left[s] // each)
            if full:
                put(s, full * each, first, each)
                free(gap - each * s, first, first + full)
                left[s] -= full * each
            if left[s] and first + full < end:
                k = left[s]
                put(s, k, first + full, k)
                free(gap - k * s, first + full, first + full + 1)
                left[s] = 0
                full += 1
            free(gap, first + full, end)
    return spans, n_containers


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """item_id, piece, container, start and size of every piece of every item.

    An item larger than `capacity` is cut into full containers of its own and a rest, which is packed like an item;
    others are one piece. Items of size 0, or of null or negative size, take no space and are put into container 0.
    Repeated ids are items of their own; an empty table gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    require_columns(items, item_id, size)
    rows = items.select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    rows = stored(rows.withColumn("whole", F.expr(f"case when n > {capacity} then n div {capacity} else 0 end")).withColumn("s", F.expr(f"n - whole * {capacity}")))
    spark = items.sparkSession
    counts = {r.s: r.c for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most capacity + 1 rows
    total = sum(counts.values())
    spans, n = plan_containers(counts, capacity)
    table = spark.createDataFrame(spans, "s bigint, a bigint, z bigint, c0 bigint, each bigint")
    rest = (
        numbered(rows.filter("s > 0"), ["s"], ["id"], total, "i")
        .join(table, "s")
        .filter("i >= a and i < z")
        .select("id", F.col("whole").alias("piece"), F.expr("c0 + (i - a) div each").alias("container"), F.expr(f"whole * {capacity}").alias("start"), F.col("s").alias("size"))
    )
    nothing = rows.filter("n = 0").select("id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("container"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"))
    # containers that one long item fills follow the others; items with as many of them are numbered together
    wholes, at = [], n
    for r in sorted(rows.filter("whole > 0").groupBy("whole").agg(F.count(F.lit(1)).alias("c")).collect()):
        wholes.append((r.whole, at))
        at += r.whole * r.c
    table = spark.createDataFrame(wholes, "whole bigint, c0 bigint")
    cut = (
        numbered(rows.filter("whole > 0"), ["whole"], ["id"], total, "i")
        .join(table, "whole")
        .withColumn("piece", F.explode(F.expr("sequence(0L, whole - 1)")))
        .select("id", "piece", F.expr("c0 + i * whole + piece").alias("container"), F.expr(f"piece * {capacity}").alias("start"), F.lit(capacity).cast("bigint").alias("size"))
    )
    return rest.unionByName(nothing).unionByName(cut).withColumnRenamed("id", item_id)


def pack_documents(documents: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, piece, container, start_token and n_tokens of every document's pieces, sized by the public tokenizer."""
    sized = stored(token_counts(documents, path=path))
    return pack(sized, capacity).withColumnRenamed("start", "start_token").withColumnRenamed("size", "n_tokens")
