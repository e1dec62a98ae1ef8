"""Service metrics from scrapes of counters and histograms: deltas, windows, quantiles, alerts.

A scrape row has t (seconds) and cumulative values that fall when a service restarts. These are the batch forms; the
streaming package has the same logic over state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timeline import ordered


def deltas(scrapes: DataFrame, series: list[str], value: str = "value", t: str = "t") -> DataFrame:
    """Add delta, the growth since the series' scrape before (null at the first), and reset, where the value fell.

    After a fall the counter began again at 0, and delta is the value itself.
    """
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(t))
    fell = F.coalesce(F.col(value) < before, F.lit(False))
    return scrapes.withColumn("reset", fell).withColumn("delta", F.when(fell, F.col(value)).otherwise(F.col(value) - before))


def last_requests(scrapes: DataFrame, most: int, max_age_s: int, by: list[str], t: str = "t", n: str = "n") -> DataFrame:
    """Of each key's scrapes, those that the window holds at the end: whole scrapes, newest first, while the newer ones
    hold fewer than `most` requests, and none older than `max_age_s` before the newest. Scrapes without requests never enter.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, -1)
    x = scrapes.filter(F.col(n) > 0)
    x = x.withColumn("_newer", F.coalesce(F.sum(n).over(w), F.lit(0))).withColumn("_end", F.max(t).over(Window.partitionBy(*by)))
    return x.filter((F.col("_newer") < most) & (F.col("_end") - F.col(t) <= max_age_s)).drop("_newer", "_end")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float = 0.95, le: str = "le", c: str = "c") -> DataFrame:
    """By key, the q-quantile from cumulative bucket counts: linear within its bucket, the lower edge in the infinite one,
    null without observations.
    """
    line = Window.partitionBy(*by).orderBy(le)  # a histogram has a few buckets
    x = buckets.withColumn("_le0", F.coalesce(F.lag(le).over(line), F.lit(0.0))).withColumn("_c0", F.coalesce(F.lag(c).over(line), F.lit(0.0))).withColumn("_goal", F.lit(q) * F.max(c).over(Window.partitionBy(*by)))
    inner = F.col("_le0") + (F.col(le) - F.col("_le0")) * (F.col("_goal") - F.col("_c0")) / F.greatest(F.col(c) - F.col("_c0"), F.lit(1e-9))
    value = F.when(F.col("_goal") > 0, F.when(F.col(le) == float("inf"), F.col("_le0")).otherwise(inner))
    return x.filter(F.col(c) >= F.col("_goal")).groupBy(*by).agg(F.min_by(value, le).alias("quantile"))


def alert(n: Column, errors: Column, p95: Column, least: int = 10, max_share: float = 0.3, max_p95: float = 2.0) -> Column:
    """'ALERT' if the share of errors or the p95 is too large, 'OK', or 'FEW' below `least` requests."""
    bad = (F.try_divide(errors, n) > max_share) | F.coalesce(p95 > max_p95, F.lit(False))
    return F.when(n < least, "FEW").when(bad, "ALERT").otherwise("OK")


def rolling_min(rows: DataFrame, by: list[str], value: str, seconds: int, t: str = "t") -> DataFrame:
    """Add the smallest value of the last `seconds` up to each row."""
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-seconds, 0)
    return rows.withColumn("rolling_min", F.min(value).over(w))


def latest_wins(rows: DataFrame, key: list[str], token: str) -> DataFrame:
    """Of each key only the row with the largest token: late answers to earlier requests are ignored."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), token).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def cache_hits(rows: DataFrame, key: str, ttl_s: int = 900, t: str = "t", order: str = "event_id") -> DataFrame:
    """Add hit: whether a request finds the answer that a request of its key stored within the `ttl_s` seconds before. A
    miss stores one, a hit doesn't make it younger: the same fold as a limit of one request a window.
    """
    return accepted_by_rate(rows, key, t, order, 1, ttl_s).withColumn("hit", ~F.col("accepted")).drop("accepted")


def stretches(rows: DataFrame, key: str, gap_s: int, t: str = "t", order: str = "event_id", name: str = "stretch") -> DataFrame:
    """Add `name`: the time at which the row's stretch began, a run of the key's rows with at most `gap_s` seconds between
    neighbours. Rows are sorted in blocks of time; of each block only the last beginning goes on to the next.
    """
    block_s = max(86_400, 4 * gap_s)
    x = ordered(rows.filter(F.col(t).isNotNull() & F.col(key).isNotNull()), key, (t, order), block_s)
    x = x.withColumn("_b", F.floor(F.col(t) / F.lit(block_s))).withColumn("_s", F.when(F.col("prev").isNull() | (F.col(t) - F.col(f"prev.{t}") > gap_s), F.col(t)))
    ends = x.groupBy(key, "_b").agg(F.max("_s").alias("_m"))
    before = ends.select(key, "_b", F.max("_m").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))  # blocks of a key
    inner = F.max("_s").over(Window.partitionBy(key, "_b").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_i", inner).join(before, [key, "_b"]).withColumn(name, F.coalesce("_i", "_c")).select(*rows.columns, name)


def accepted_by_rate(rows: DataFrame, key: str, t: str = "t", order: str = "event_id", limit: int = 30, window_s: int = 60) -> DataFrame:
    """Add accepted: a request passes if fewer than `limit` accepted ones of its key lie in the `window_s` seconds before.

    What passes depends on what passed before, but not beyond a silence longer than the window. So each stretch of requests
    is folded apart, in any task, and those of at most `limit` requests pass whole; of a longer one the last `limit`
    accepted times are held. Rows without key or time are left out.
    """
    schema = rows.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, deque(maxlen=limit)
        for batch in batches:
            times = batch.column(batch.schema.get_field_index(t)).to_numpy(zero_copy_only=False)
            keys, begins = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index("_stretch"))
            new = np.ones(batch.num_rows, dtype=bool)
            if batch.num_rows > 1:
                same = pc.and_(pc.equal(keys[1:], keys[:-1]), pc.equal(begins[1:], begins[:-1]))
                new[1:] = ~same.to_numpy(zero_copy_only=False)
            ok = np.ones(batch.num_rows, dtype=bool)
            starts = np.append(np.flatnonzero(new), batch.num_rows)
            for a, b in zip(starts[:-1], starts[1:]):
                mark = (keys[int(a)].as_py(), begins[int(a)].as_py())
                if mark != now:
                    now, held = mark, deque(maxlen=limit)
                if len(held) + b - a <= limit:
                    held.extend(times[a:b].tolist())
                    continue
                for k in range(a, b):
                    # the last accepted request but `limit` - 1 decides
                    ok[k] = len(held) < limit or times[k] - held[0] > window_s
                    if ok[k]:
                        held.append(times[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names), pa.array(ok)], names=[*schema.names, "accepted"])

    spread = stretches(rows, key, window_s, t, order, "_stretch").repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", t, order)
    return spread.mapInArrow(fold, T.StructType([*schema.fields, T.StructField("accepted", T.BooleanType())]))
