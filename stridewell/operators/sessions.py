"""Grouping activity into sessions by inactivity gaps, with occupancy bitmaps.

Each entity's time line is cut into fixed blocks, and a block is a bitmap with a bit for every second that has an event.
A coarse bitmap whose bits are as wide as the gap is taken first: two events with an empty coarse bit between them are
surely apart, so the fine bitmaps cover only the runs of the coarse one. A fine bitmap is closed by OR-ing it with
itself shifted by 1, 2, 4, ... seconds until every bit has spread over one gap; its runs of ones are the sessions, the
event counts are joined to the runs, and the spread is trimmed off the ends again. Sessions near a block's edge are then
joined with those of the next block. Equal seconds are counted before the shuffle, so that a block has no more rows than
seconds however many events an entity has in it, and a task works on a few blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import epoch_s, norm_id, require_columns, stored

#: Rows that a task takes together before it works on them.
TASK_ROWS = 500_000
#: Bits of fine bitmap worked on at once: half a megabyte, so that the shifts stay in a core's cache.
CHUNK_BITS = 1 << 22
_SCHEMA = "user_id string, start_s bigint, end_s bigint, n_events bigint, at_edge boolean"


def _shift_or(words: np.ndarray, by: int) -> None:
    """words |= words << by, for a little-endian bitmap of 64-bit words."""
    w, b = divmod(by, 64)
    src = words[: len(words) - w] if w else words
    moved = src << np.uint64(b) if b else src.copy()
    if b:
        moved[1:] |= src[:-1] >> np.uint64(64 - b)
    words[w:] |= moved


def close_gaps(words: np.ndarray, gap: int) -> None:
    """Let every set bit spread over the `gap` - 1 bits after it, in about log2(gap) shifts."""
    cover = 1
    while cover < gap:
        step = min(cover, gap - cover)
        _shift_or(words, step)
        cover += step


def _fine_runs(pos: np.ndarray, n_bits: int, gap: int) -> np.ndarray:
    """Start bits of the runs that the occupied bits `pos` form after closing."""
    words = np.zeros(-(-n_bits // 64), dtype="<u8")
    np.bitwise_or.at(words, pos >> 6, np.uint64(1) << (pos & 63).astype(np.uint64))
    close_gaps(words, gap)
    before = words << np.uint64(1)
    before[1:] |= words[:-1] >> np.uint64(63)
    edges = words & ~before
    some = np.flatnonzero(edges)  # few words have the start of a run
    place = np.flatnonzero(np.unpackbits(edges[some].view(np.uint8), bitorder="little"))
    return (some[place >> 6] << 6) + (place & 63)


def _extremes(ids: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.full(n, np.iinfo(np.int64).max)
    hi = np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(lo, ids, t)
    np.maximum.at(hi, ids, t)
    return lo, hi


def _coarse_runs(group: np.ndarray, t: np.ndarray, base: np.ndarray, top: np.ndarray, width: int) -> np.ndarray:
    """Number of the run of occupied coarse bits that each time falls into; runs are numbered from 0 in rising order.

    One row of bits a group, an empty bit after each. Where the rows would take more than `CHUNK_BITS` (small gaps, long
    spans), the few occupied bits are sorted instead: the same runs.
    """
    span = (top - base) // width + 2
    offset = np.concatenate(([0], np.cumsum(span)))
    at = offset[group] + (t - base[group]) // width
    if offset[-1] <= max(CHUNK_BITS, 8 * len(t)):
        coarse = np.zeros(int(offset[-1]), dtype=bool)
        coarse[at] = True
        occupied = np.flatnonzero(coarse)
    else:
        occupied = np.unique(at)
    new = np.empty(len(occupied), dtype=bool)
    new[:1] = True
    np.greater(np.diff(occupied), 1, out=new[1:])
    return (np.cumsum(new) - 1)[np.searchsorted(occupied, at)]


def session_runs(group: np.ndarray, t: np.ndarray, n_groups: int, gap: int, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sessions of every group: (group, start, end, events), for times `t` (seconds) of groups 0..n_groups-1, with the
    numbers of events at these times (one each by default).
    """
    if gap == 0:  # neighbouring seconds must stay apart: put an empty bit between them
        owner, start, end, n = session_runs(group, t * 2, n_groups, 1, count)
        return owner, start // 2, end // 2, n
    base, top = _extremes(group, t, n_groups)
    run = _coarse_runs(group, t, base, top, gap)
    n_runs = int(run.max()) + 1
    lo, hi = _extremes(run, t, n_runs)
    # fine bitmaps, of the coarse runs with more than one occupied second
    wide = hi > lo
    need = np.where(wide, hi - lo + gap + 2, 1)
    first = np.concatenate(([0], np.cumsum(need)))  # place of a run's first bit in the row of all bitmaps
    bit = first[run] + (t - lo[run])
    starts = [first[:-1][~wide]]
    order = np.flatnonzero(wide)
    if len(order):
        inner = np.sort(bit[wide[run]])
        total = np.cumsum(need[order])
        begin = 0
        while begin < len(order):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + CHUNK_BITS, "right")))
            a, b = first[order[begin]], first[order[end - 1]] + need[order[end - 1]]
            part = inner[np.searchsorted(inner, a) : np.searchsorted(inner, b)]
            # the narrow runs between the wide ones take no bits here
            wide_at = np.concatenate(([0], np.cumsum(need[order[begin:end]])))
            k = np.searchsorted(first[order[begin:end]], part, "right") - 1
            found = _fine_runs(part - first[order[begin:end]][k] + wide_at[k], int(wide_at[-1]), gap)
            k = np.searchsorted(wide_at, found, "right") - 1
            starts.append(found - wide_at[k] + first[order[begin:end]][k])
            begin = end
    starts = np.sort(np.concatenate(starts))
    session = np.searchsorted(starts, bit, "right") - 1
    begin_t, end_t = _extremes(session, t, len(starts))
    owner = np.empty(len(starts), dtype=np.int64)
    owner[session] = group
    n = np.bincount(session, count, minlength=len(starts))
    return owner, begin_t, end_t, n if count is None else np.rint(n).astype(np.int64)


def _block_sessions(gap: int, block_s: int):
    def found(table: pa.Table) -> pa.RecordBatch:
        users = table.column("user_id").combine_chunks().dictionary_encode()
        user = users.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        block, t, count = (table.column(c).to_numpy() for c in ("block", "t", "n"))
        low = int(block.min())
        n_blocks = int(block.max()) - low + 1
        keys, group = np.unique(user * n_blocks + (block - low), return_inverse=True)
        owner, start, end, n = session_runs(group, t, len(keys), gap, count)
        first = (keys % n_blocks + low) * block_s
        edge = (start - first[owner] <= gap) | (first[owner] + block_s - end <= gap)
        return pa.RecordBatch.from_arrays(
            [users.dictionary.take(pa.array(keys[owner] // n_blocks)).cast(pa.string()), pa.array(start), pa.array(end), pa.array(n), pa.array(edge)],
            names=["user_id", "start_s", "end_s", "n_events", "at_edge"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks come whole and one after the other: what is held is a few of them, cut off before the last one's first row
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= TASK_ROWS:
                user, block = batch.column(0), batch.column(1)
                last = pc.and_(pc.equal(user, user[-1]), pc.equal(block, block[-1]))
                keep = batch.num_rows - int(pc.sum(last).as_py())
                if keep:
                    yield found(pa.Table.from_batches([*held[:-1], batch.slice(0, keep)]))
                    held = [batch.slice(keep)]
                    rows = held[0].num_rows
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_s: int = 14_400, block_s: int = 1 << 22) -> DataFrame:
    """One row per session: user_id, start_s, end_s, duration_s, n_events.

    A session ends where more than `gap_s` seconds lie between an event and the entity's next one. Rows without entity
    or time take no part; repeated rows and rows in the same second count as events; an empty table gives no rows;
    other columns, whatever their names, are not looked at. Ids come out trimmed and in lower case.
    """
    require_columns(events, user, ts)
    if gap_s < 0:
        raise ValueError("gap_s must not be negative")
    block_s = max(block_s, 3 * gap_s)
    rows = (
        events.select(norm_id(user).alias("user_id"), epoch_s(events, ts).alias("t"))
        .filter("user_id is not null and t is not null")
        .withColumn("block", F.floor(F.col("t") / F.lit(block_s)).cast("bigint"))
    )
    # seconds are counted first, spread by second too: a block has at most block_s rows then, however hot it is
    rows = rows.groupBy("user_id", "block", "t").agg(F.count(F.lit(1)).alias("n")).repartition("user_id", "block").sortWithinPartitions("user_id", "block")
    local = stored(rows.mapInArrow(_block_sessions(gap_s, block_s), _SCHEMA))
    inner = local.filter("not at_edge").select("user_id", "start_s", "end_s", "n_events")
    line = Window.partitionBy("user_id").orderBy("start_s")
    joined = (
        local.filter("at_edge")
        .withColumn("new", (F.col("start_s") - F.lag("end_s").over(line) > gap_s).cast("int"))
        .withColumn("k", F.sum(F.coalesce("new", F.lit(1))).over(line))
        .groupBy("user_id", "k")
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n_events").alias("n_events"))
        .drop("k")
    )
    return inner.unionByName(joined).select("user_id", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n_events")
