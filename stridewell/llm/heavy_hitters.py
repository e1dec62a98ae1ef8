"""Most frequent values of a column in bounded memory.

Every partition keeps a heavy and a light part. The heavy part has buckets of a few slots, each with a value and its
exact count since it came in. A value that finds no slot votes against its bucket's smallest resident and is counted in
the light part, one array of counters; when the votes outnumber the resident's count several times, the resident is
evicted, its count goes to the light part, and the challenger takes the slot. Partitions merge bucket by bucket: equal
values add up, the largest stay, the rest goes to the light part as an eviction would.

Merged, a value's count lies between its resident count and that plus its light counter. A value that is resident
nowhere has all its rows in its light counter. So for a threshold T, the residents whose upper bound reaches T and the
values of light counters that reach T include every value with at least T rows; an exact count of these alone follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..common import norm_id, require_columns, stored

#: Partitions whose parts one task recombines.
MERGE = 32
_SCHEMA = "kind string, place int, h bigint, n bigint"


@dataclass(frozen=True)
class Sketch:
    """Sizes: memory is buckets * slots values and `counters` numbers a partition, whatever the data."""

    buckets: int = 512
    slots: int = 4
    counters: int = 8192
    evict_at: int = 8

    def __post_init__(self):
        if min(self.buckets, self.slots, self.counters, self.evict_at) < 1:
            raise ValueError("sketch sizes must be positive")


class _Parts:
    """Heavy and light part of one partition."""

    def __init__(self, size: Sketch):
        self.size = size
        self.key = np.zeros((size.buckets, size.slots), dtype=np.int64)
        self.count = np.zeros((size.buckets, size.slots), dtype=np.int64)
        self.votes = np.zeros(size.buckets, dtype=np.int64)
        self.light = np.zeros(size.counters, dtype=np.int64)

    def add(self, hashes: np.ndarray) -> None:
        size = self.size
        h, n = np.unique(hashes, return_counts=True)
        bucket = _bucket(h, size.buckets)
        same = (self.key[bucket] == h[:, None]) & (self.count[bucket] > 0)
        found = same.any(1)
        self.count[bucket[found], same[found].argmax(1)] += n[found]
        # the largest newcomer of each bucket challenges first, then the next, as long as there are slots
        h, n, bucket = h[~found], n[~found], bucket[~found]
        order = np.lexsort((h, -n, bucket))
        h, n, bucket = h[order], n[order], bucket[order]
        for _ in range(size.slots):
            if not len(h):
                return
            first = np.ones(len(bucket), dtype=bool)
            first[1:] = bucket[1:] != bucket[:-1]
            b, ch, cn = bucket[first], h[first], n[first]
            slot = self.count[b].argmin(1)
            low = self.count[b, slot]
            votes = self.votes[b] + np.add.reduceat(n, np.flatnonzero(first))
            win = (low == 0) | (votes >= size.evict_at * low)
            b, slot = b[win], slot[win]
            np.add.at(self.light, _counter(self.key[b, slot], size.counters), low[win])
            self.key[b, slot], self.count[b, slot] = ch[win], cn[win]
            self.votes[b[low[win] > 0]] = 0
            taken = np.flatnonzero(first)[win]
            rest = np.ones(len(h), dtype=bool)
            rest[taken] = False
            lost = ~np.isin(bucket, b)  # whose challenger lost: all its newcomers vote and go to the light part
            np.add.at(self.votes, bucket[lost], n[lost])
            np.add.at(self.light, _counter(h[lost], size.counters), n[lost])
            rest &= ~lost
            h, n, bucket = h[rest], n[rest], bucket[rest]
        np.add.at(self.votes, bucket, n)
        np.add.at(self.light, _counter(h, size.counters), n)

    def batches(self) -> Iterator[pa.RecordBatch]:
        b, s = np.nonzero(self.count)
        c = np.flatnonzero(self.light)
        for kind, place, h, n in (("heavy", b, self.key[b, s], self.count[b, s]), ("light", c, np.zeros(len(c), np.int64), self.light[c])):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array(place.astype(np.int32)), pa.array(h), pa.array(n)], names=["kind", "place", "h", "n"])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _counter(h: np.ndarray, n: int) -> np.ndarray:
    return ((h.view(np.uint64) & np.uint64(0x7FFFFFFF)) % np.uint64(n)).astype(np.int64)


def _counter_sql(h: Column, n: int) -> Column:
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def _recombined(size: Sketch):
    """Merge the parts of several partitions: equal values add up, a bucket's largest stay, the others go to the light part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).group_by(["kind", "place", "h"]).aggregate([("n", "sum")])
        heavy = t["kind"].to_numpy(zero_copy_only=False) == "heavy"
        place, h, n = (t[c].to_numpy(zero_copy_only=False) for c in ("place", "h", "n_sum"))
        light = np.bincount(place[~heavy], n[~heavy], size.counters).astype(np.int64)
        place, h, n = place[heavy], h[heavy], n[heavy]
        order = np.lexsort((h, -n, place))
        place, h, n = place[order], h[order], n[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        stay = rank < size.slots
        np.add.at(light, _counter(h[~stay], size.counters), n[~stay])
        full = np.flatnonzero(light)
        yield pa.RecordBatch.from_arrays([pa.array(["heavy"] * int(stay.sum()), pa.string()), pa.array(place[stay], pa.int32()), pa.array(h[stay]), pa.array(n[stay])], names=["kind", "place", "h", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(["light"] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(np.zeros(len(full), np.int64)), pa.array(light[full])], names=["kind", "place", "h", "n"])

    return run


def sketch(rows: DataFrame, column: str, size: Sketch = Sketch()) -> tuple[DataFrame, DataFrame, int]:
    """Merged (heavy, light, rows counted): heavy has h and n, light has place and n; a value is known by its 64-bit hash."""
    require_columns(rows, column)
    hashes = rows.select(norm_id(column).alias("v")).filter("v is not null").select(F.xxhash64("v").alias("h"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, many = _Parts(size), [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            many += batch.num_rows
            if many >= 200_000:
                parts.add(np.concatenate(held))
                held, many = [], 0
        if many:
            parts.add(np.concatenate(held))
        yield from parts.batches()

    parts = hashes.mapInArrow(local, _SCHEMA)
    n = hashes.rdd.getNumPartitions()
    while n > MERGE:  # level by level: each task recombines the parts of up to MERGE others
        n = -(-n // MERGE)
        parts = parts.repartition(n, F.spark_partition_id()).mapInArrow(_recombined(size), _SCHEMA)
    summed = stored(parts.groupBy("kind", "place", "h").agg(F.sum("n").alias("n")))
    total = summed.agg(F.sum("n")).first()[0] or 0
    ranked = summed.filter("kind = 'heavy'").withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "h")))
    heavy = ranked.filter(F.col("k") <= size.slots).select("h", "n")
    evicted = ranked.filter(F.col("k") > size.slots).select(_counter_sql(F.col("h"), size.counters).alias("place"), "n")
    light = summed.filter("kind = 'light'").select("place", "n").unionByName(evicted).groupBy("place").agg(F.sum("n").alias("n"))
    return heavy, light, total


def candidates(rows: DataFrame, column: str, one_in: int, size: Sketch = Sketch()) -> tuple[DataFrame, DataFrame, int]:
    """(residents that may reach one row in `one_in`, with bounds; light counters that reach it; that many rows)."""
    heavy, light, total = sketch(rows, column, size)
    least = max(1, -(-total // one_in))
    bounded = heavy.withColumn("place", _counter_sql(F.col("h"), size.counters)).join(light.withColumnRenamed("n", "light"), "place", "left")
    bounded = bounded.select("h", F.col("n").alias("low"), (F.col("n") + F.coalesce("light", F.lit(0))).alias("high"))
    return bounded.filter(F.col("high") >= least), light.filter(F.col("n") >= least), least


def frequent(rows: DataFrame, column: str, one_in: int, size: Sketch = Sketch()) -> DataFrame:
    """`column` and n_rows of the values that have at least one in `one_in` of the rows with a value; exact and complete.

    Values are taken in canonical form (trimmed, lower case). Rows without a value don't count, repeated rows do; an
    empty table gives no rows; ties have no influence; other columns are ignored.
    """
    if one_in < 1:
        raise ValueError("one_in must be positive")
    few, cells, least = candidates(rows, column, one_in, size)
    # at most one_in counters can be that full, and there are at most buckets * slots residents
    few = [r.h for r in few.select("h").collect()]
    cells = [r.place for r in cells.select("place").collect()]
    v = rows.select(norm_id(column).alias(column)).filter(F.col(column).isNotNull()).withColumn("_h", F.xxhash64(column))
    wanted = F.col("_h").isin(few)
    if cells:
        wanted = wanted | _counter_sql(F.col("_h"), size.counters).isin(cells)
    return v.filter(wanted).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)


def top_values(rows: DataFrame, column: str, k: int, size: Sketch = Sketch()) -> DataFrame:
    """The k residents with the largest counts: `column`, n_low and n_high, bounds of the count, ties by value.

    One pass over the data for the sketch and one to name the values by their hashes.
    """
    heavy, light, _ = sketch(rows, column, size)
    bounded = heavy.withColumn("place", _counter_sql(F.col("h"), size.counters)).join(light.withColumnRenamed("n", "light"), "place", "left")
    best = stored(bounded.select("h", F.col("n").alias("n_low"), (F.col("n") + F.coalesce("light", F.lit(0))).alias("n_high")))
    # all residents that reach the k-th count: ties are settled by value, which only the next pass tells
    counts = [r.n_low for r in best.orderBy(F.desc("n_low")).limit(k).select("n_low").collect()]
    best = best.filter(F.col("n_low") >= (counts[-1] if counts else 0))
    hs = [r.h for r in best.select("h").collect()]  # at most buckets * slots
    named = rows.select(norm_id(column).alias(column)).filter(F.col(column).isNotNull()).withColumn("h", F.xxhash64(column)).filter(F.col("h").isin(hs)).groupBy("h").agg(F.min(column).alias(column))
    return best.join(F.broadcast(named), "h").select(column, "n_low", "n_high").orderBy(F.desc("n_low"), column).limit(k)
