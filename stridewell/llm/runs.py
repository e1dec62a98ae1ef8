"""Runs of repeated consecutive events, each collapsed into one with its count and duration.

The rows are sorted into ranges of (entity, time, item, seq), so that an entity with a third of the rows spreads over
many tasks. Each range is encoded into runs on its own. Its first and last run are summaries that may go on beyond the
range; these, two a range, are put in order and merged by a prefix scan: a last run and the next range's first one are
one run if entity and item agree and the pause between is short. Merging summaries is associative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import epoch_s, norm_id, require_columns, stored

_SCHEMA = "user_id string, item string, first_seq bigint, last_seq bigint, start_s bigint, end_s bigint, n bigint, opens boolean, closes boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _encode(gap: int, least: int):
    """Runs of one sorted range; runs of fewer than `least` rows are left out unless they touch the range's ends."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # the run that is still open: user, item, first_seq, last_seq, start, end, n
        opening = True  # no run of this range is finished yet
        for batch in batches:
            if not batch.num_rows:
                continue
            user, item = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            u, i = (x.indices.to_numpy(zero_copy_only=False) for x in (user, item))
            t, seq = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            new = np.empty(len(t), dtype=bool)
            new[0] = True
            new[1:] = (u[1:] != u[:-1]) | (i[1:] != i[:-1]) | (t[1:] - t[:-1] > gap)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(t)) - 1
            n = z - a + 1
            text = lambda d, k: d.dictionary[int(d.indices[int(k)].as_py())].as_py()
            begin = 0
            if last is not None and text(user, 0) == last[0] and text(item, 0) == last[1] and t[0] - last[5] <= gap:
                last[3], last[5], last[6] = int(seq[z[0]]), int(t[z[0]]), last[6] + int(n[0])
                begin = 1
            if begin < len(a):
                if last is not None and (opening or last[6] >= least):
                    yield batch_of([(*last, opening, False)])
                if last is not None:
                    opening = False
                if opening and begin < len(a) - 1:  # the range's first run ends within the first batch
                    yield batch_of([(text(user, a[begin]), text(item, a[begin]), int(seq[a[begin]]), int(seq[z[begin]]), int(t[a[begin]]), int(t[z[begin]]), int(n[begin]), True, False)])
                    opening = False
                    begin += 1
                inner = np.arange(begin, len(a) - 1)
                inner = inner[n[inner] >= least]
                if len(inner):
                    x, y = a[inner], z[inner]
                    no = pa.array(np.zeros(len(inner), dtype=bool))
                    yield pa.RecordBatch.from_arrays([user.take(pa.array(x)).cast(pa.string()), item.take(pa.array(x)).cast(pa.string()), *map(pa.array, (seq[x], seq[y], t[x], t[y], n[inner].astype(np.int64))), no, no], names=_NAMES)
                k = len(a) - 1
                last = [text(user, a[k]), text(item, a[k]), int(seq[a[k]]), int(seq[z[k]]), int(t[a[k]]), int(t[z[k]]), int(n[k])]
        if last is not None:
            yield batch_of([(*last, opening, True)])

    return run


def runs(events: DataFrame, user: str = "user_id", item: str = "item", ts: str = "ts", seq: str = "seq", gap_s: int = 1800, min_rows: int = 1) -> DataFrame:
    """user_id, item, first_seq, last_seq, start_s, end_s, duration_s, n: runs of at least `min_rows` rows.

    In each entity's rows ordered by time, item and seq, a run goes on while the item stays the same and at most
    `gap_s` seconds lie between neighbours. Rows in which one of the four fields is missing take no part; repeated rows
    are rows of the run; an empty table gives no runs; other columns are ignored.
    """
    require_columns(events, user, item, ts, seq)
    rows = events.select(norm_id(user).alias("user_id"), norm_id(item).alias("item"), epoch_s(events, ts).alias("t"), F.col(seq).cast("bigint").alias("seq")).dropna()
    key = ["user_id", "t", "item", "seq"]
    ranges = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("user_id", "item", "t", "seq")
    local = stored(ranges.mapInArrow(_encode(gap_s, min_rows), _SCHEMA))
    inner = local.filter("not opens and not closes").select(*_NAMES[:7])
    # edge runs come alternately as first and last of a range, or as both at once
    line = Window.partitionBy("user_id").orderBy("start_s", "item", "first_seq")
    goes_on = F.lag("closes").over(line) & F.col("opens") & (F.lag("item").over(line) == F.col("item")) & (F.col("start_s") - F.lag("end_s").over(line) <= gap_s)
    edge = (
        local.filter("opens or closes")
        .withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("k", F.sum("new").over(line))
        .groupBy("user_id", "k")
        .agg(
            F.first("item").alias("item"),
            F.min_by("first_seq", F.struct("start_s", "item", "first_seq")).alias("first_seq"),
            F.max_by("last_seq", F.struct("start_s", "item", "first_seq")).alias("last_seq"),
            F.min("start_s").alias("start_s"),
            F.max("end_s").alias("end_s"),
            F.sum("n").alias("n"),
        )
        .filter(F.col("n") >= min_rows)
        .select(*_NAMES[:7])
    )
    return inner.unionByName(edge).select(*_NAMES[:6], (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n")
