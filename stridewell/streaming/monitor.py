"""Streams of requests and scrapes, over event time or over state.

Each function turns a streaming DataFrame into another; the caller chooses sink, trigger and checkpoint folder.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(requests: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling counts by key; a window is final once the watermark has passed its end."""
    w = requests.withWatermark(ts, late).groupBy(F.window(ts, size), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("window.start").alias("start"), *by, "n", "errors")


def sliding_error_share(requests: DataFrame, ts: str = "ts", size: str = "1 minute", slide: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Share of errors in sliding windows."""
    w = requests.withWatermark(ts, late).groupBy(F.window(ts, size, slide))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("share")).select(F.col("window.end").alias("end"), "n", "share")


def session_counts(requests: DataFrame, ts: str = "ts", gap: str = "4 hours", late: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Sessions as they close, by Spark's session windows; a session is emitted once no late event can extend it."""
    w = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user)
    return w.agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def tally_once(done: DataFrame, key: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return done.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


#: Seconds of event time after which a key's state is forgotten, where a function has no shorter age of its own, and how
#: late a row may come.
FORGET_S, LATE_S = 86_400, 600


def _by_key(rows: DataFrame, key: str, step, out: str, state: str, t: str | None, forget_s: int, late_s: int, at_end=None) -> DataFrame:
    """Fold each key's new rows into its state. `step` takes (key, rows, state or None) and gives (output rows, state).

    `t` is the column of event time in seconds: when all keys' time has moved `forget_s` beyond a key's last row, its state
    goes, and `at_end` of the key is put out. Without `t` the state stays.
    """
    names = [x.split()[0] for x in out.split(", ")]
    if t is not None:
        ahead = late_s + 1  # so that time 0 is not late before anything has come
        rows = rows.withColumn("_at", F.timestamp_seconds(F.col(t) + ahead)).withWatermark("_at", f"{late_s} seconds")

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame(at_end(k[0]) if at_end else [], columns=names)
            return
        got = pd.concat(list(batches))
        result, new = step(k[0], got, held.get if held.exists else None)
        held.update(new)
        if t is not None:
            held.setTimeoutTimestamp(max((int(got[t].max()) + ahead + forget_s) * 1000, held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(result, columns=names)

    timeout = GroupStateTimeout.NoTimeout if t is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(fold, out, state, "append", timeout)


def counter_deltas(scrapes: DataFrame, series: str = "series", t: str = "t", value: str = "value", forget_s: int = FORGET_S, late_s: int = LATE_S) -> DataFrame:
    """series, t, delta, reset between a series' scrapes. The state is the last scrape; a fall means a restart from 0.

    Rows of one micro-batch are put in order of t; a scrape older than the state is dropped. A series that is silent for
    `forget_s` begins anew.
    """

    def step(key, rows, state):
        rows = rows.sort_values(t, kind="stable").drop_duplicates(t)
        if state is not None:
            rows = pd.concat([pd.DataFrame({t: [state[0]], value: [state[1]]}), rows[rows[t] > state[0]][[t, value]]])
        grown = rows[value].diff()
        fell = grown < 0
        out = pd.DataFrame({"series": key, "t": rows[t].astype("int64"), "delta": grown.where(~fell, rows[value]), "reset": fell})[grown.notna()]
        return out, (int(rows[t].iloc[-1]), float(rows[value].iloc[-1]))

    return _by_key(scrapes, series, step, "series string, t bigint, delta double, reset boolean", "t bigint, value double", t, forget_s, late_s)


def request_window(scrapes: DataFrame, most: int = 500, max_age_s: int = 60, least: int = 10, max_share: float = 0.3, key: str = "service", late_s: int = LATE_S) -> DataFrame:
    """After each scrape (key, t, n, errors) the window's total and state: 'FEW', 'OK' or 'ALERT'; and once 'FEW' with no
    requests, at null t, when a service has been silent for `max_age_s` while others went on.

    The window is a suffix of the scrapes: those that fewer than `most` newer requests follow and that aren't too old. A
    null n says that the counters began anew, and empties it. So its ends are found in the running sums.
    """

    def step(key, rows, state):
        rows = rows.sort_values("t", kind="stable")
        old = pd.DataFrame(dict(zip(("t", "n", "errors"), state or ((), (), ())))).astype("int64")
        restart = np.r_[np.zeros(len(old), bool), rows["n"].isna()]
        x = pd.concat([old, rows[["t", "n", "errors"]]]).fillna(0).astype("int64")
        at, n, e = x["t"].to_numpy(), x["n"].to_numpy(), x["errors"].to_numpy()
        sums, errors = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(e)))
        new_life = np.maximum.accumulate(np.where(restart, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
        first = np.maximum.reduce([np.searchsorted(sums[1:], sums[1:] - most, "right"), np.searchsorted(at, at - max_age_s), new_life])
        total, wrong = sums[1:] - sums[first], errors[1:] - errors[first]
        said = np.where(total < least, "FEW", np.where(wrong > max_share * total, "ALERT", "OK"))
        out = pd.DataFrame({"service": key, "t": at, "n": total, "errors": wrong, "state": said})[len(old) :]
        keep = np.arange(len(at)) >= (first[-1] if len(first) else 0)
        keep &= n > 0
        return out, tuple(c[keep].tolist() for c in (at, n, e))

    return _by_key(scrapes, key, step, "service string, t bigint, n bigint, errors bigint, state string", "t array<bigint>, n array<bigint>, errors array<bigint>", "t", max_age_s, late_s, lambda key: [(key, None, 0, 0, "FEW")])


def latest_wins(answers: DataFrame, key: str = "request", token: str = "token", t: str | None = None, forget_s: int = FORGET_S, late_s: int = LATE_S) -> DataFrame:
    """Answers (key, token) that are newer than any seen for their key; late ones to earlier requests are ignored. With
    `t`, a column of seconds, a key that is silent for `forget_s` is forgotten; without it, keys are kept for good.
    """

    def step(key, rows, state):
        newest = int(rows[token].max())
        fresh = state is None or newest > state[0]
        return [(key, newest)] if fresh else [], (newest,) if fresh else state

    return _by_key(answers, key, step, "request string, token bigint", "token bigint", t, forget_s, late_s)


def rate_limited(requests: DataFrame, limit: int = 30, window_s: int = 60, key: str = "ip", late_s: int = LATE_S) -> DataFrame:
    """ip, t, accepted: a request passes if fewer than `limit` accepted ones lie in the window before it. The state is the
    last accepted times, at most `limit`; it is forgotten when the window has passed.
    """

    def step(key, rows, state):
        held = deque(state[0] if state else (), maxlen=limit)
        out = []
        for t in np.sort(rows["t"].to_numpy()).tolist():
            # the limit-th last accepted request decides
            ok = len(held) < limit or t - held[0] > window_s
            if ok:
                held.append(t)
            out.append((key, t, ok))
        return out, (list(held),)

    return _by_key(requests, key, step, "ip string, t bigint, accepted boolean", "t array<bigint>", "t", window_s, late_s)


def scrape_loop(stream: DataFrame, checkpoint: str, seconds: int = 3, sink: str = "console", name: str | None = None):
    """Start a stream that takes what has come every so many seconds."""
    if seconds < 1:
        raise ValueError("seconds must be at least 1")
    w = stream.writeStream.outputMode("append").format(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
    return (w.queryName(name) if name else w).start()
