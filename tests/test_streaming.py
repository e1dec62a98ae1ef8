"""Streams run to the end over files and are held against the batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from stridewell.operators import monitor
from stridewell.streaming import monitor as stream


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def source(spark, tmp_path, schema, batches):
    d = tmp_path / "in"
    d.mkdir()
    import os
    import time

    for k, rows in enumerate(batches):
        p = d / f"{k:03d}.json"
        p.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(p, (time.time() + k, time.time() + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def test_counter_deltas(spark, tmp_path):
    batches = [[{"series": "a", "t": 1, "value": 5.0}], [{"series": "a", "t": 2, "value": 9.0}, {"series": "b", "t": 2, "value": 1.0}], [{"series": "a", "t": 1, "value": 2.0}], [{"series": "a", "t": 3, "value": 4.0}, {"series": "b", "t": 4, "value": 1.0}]]
    out = run(spark, stream.counter_deltas(source(spark, tmp_path, "series string, t bigint, value double", batches)), tmp_path, "deltas")
    got = sorted((r.series, r.t, r.delta, r.reset) for r in out.collect())
    assert got == [("a", 2, 4.0, False), ("a", 3, 4.0, True), ("b", 4, 0.0, False)]
    flat = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, 4.0), ("b", 2, 1.0), ("b", 4, 1.0)], "series string, t bigint, value double")
    batch = monitor.deltas(flat, ["series"]).filter("delta is not null")
    assert sorted((r.series, r.t, r.delta, r.reset) for r in batch.collect()) == got


def test_request_window(spark, tmp_path):
    s = [(10, 4, 4), (12, 0, 0), (15, 5, 0), (20, 6, 6), (90, 3, 0), (95, 20, 1)]
    batches = [[{"service": "x", "t": t, "n": n, "errors": e}] for t, n, e in s]
    out = run(spark, stream.request_window(source(spark, tmp_path, "service string, t bigint, n bigint, errors bigint", batches), most=10), tmp_path, "win")
    got = {r.t: (r.n, r.errors, r.state) for r in out.collect()}
    assert got == {10: (4, 4, "FEW"), 12: (4, 4, "FEW"), 15: (9, 4, "FEW"), 20: (11, 6, "ALERT"), 90: (3, 0, "FEW"), 95: (20, 1, "OK")}
    for k in range(1, len(s) + 1):  # the batch form gives the window after any scrape with requests
        if s[k - 1][1]:
            df = spark.createDataFrame([("x", *r) for r in s[:k]], "service string, t bigint, n bigint, errors bigint")
            w = monitor.last_requests(df, 10, 60, ["service"]).agg(F.sum("n"), F.sum("errors")).first()
            assert tuple(w) == got[s[k - 1][0]][:2]


def test_request_window_of_many_scrapes_in_one_batch(spark, tmp_path):
    rows = [{"service": "x", "t": t, "n": n, "errors": 0} for t, n in ((1, 4), (2, 6), (3, None), (4, 3), (200, 1))]
    out = run(spark, stream.request_window(source(spark, tmp_path, "service string, t bigint, n bigint, errors bigint", [rows[:3], rows[3:]]), most=10), tmp_path, "win2")
    # a restart of the counters empties the window, age does too
    assert {r.t: r.n for r in out.collect() if r.t is not None} == {1: 4, 2: 10, 3: 0, 4: 3, 200: 1}


def test_silent_keys_are_forgotten(spark, tmp_path):
    batches = [[{"service": "x", "t": 0, "n": 20, "errors": 9}, {"service": "y", "t": 0, "n": 20, "errors": 0}], [{"service": "y", "t": 1000, "n": 20, "errors": 0}], [{"service": "y", "t": 1001, "n": 1, "errors": 0}]]
    src = source(spark, tmp_path, "service string, t bigint, n bigint, errors bigint", batches)
    out = run(spark, stream.request_window(src, late_s=10), tmp_path, "win3")
    assert [(r.service, r.n, r.state) for r in out.collect() if r.t is None] == [("x", 0, "FEW")]


def test_latest_wins(spark, tmp_path):
    batches = [[{"request": "a", "token": 2}], [{"request": "a", "token": 1}, {"request": "b", "token": 7}], [{"request": "a", "token": 3}, {"request": "a", "token": 2}]]
    out = run(spark, stream.latest_wins(source(spark, tmp_path, "request string, token bigint", batches)), tmp_path, "latest")
    assert sorted((r.request, r.token) for r in out.collect()) == [("a", 2), ("a", 3), ("b", 7)]


def test_rate_limit(spark, tmp_path):
    times = [0, 1, 2, 30, 61, 62, 63, 200]
    batches = [[{"ip": "x", "t": t}] for t in times]
    out = run(spark, stream.rate_limited(source(spark, tmp_path, "ip string, t bigint", batches), limit=2), tmp_path, "rate")
    got = {r.t: r.accepted for r in out.collect()}
    assert got == {0: True, 1: True, 2: False, 30: False, 61: True, 62: True, 63: False, 200: True}
    df = spark.createDataFrame([("x", t, k) for k, t in enumerate(times)], "ip string, t bigint, event_id bigint")
    assert {r.t: r.accepted for r in monitor.accepted_by_rate(df, "ip", limit=2).collect()} == got


def test_event_time(spark, tmp_path):
    at = lambda m, s=0: f"2024-01-01T00:{m:02d}:{s:02d}"
    batches = [[{"ts": at(0, 5), "event_type": "view", "user_id": 1}, {"ts": at(0, 50), "event_type": "error", "user_id": 1}], [{"ts": at(1, 5), "event_type": "view", "user_id": 2}, {"ts": at(0, 59), "event_type": "view", "user_id": 1}], [{"ts": at(30), "event_type": "view", "user_id": 3}], [{"ts": at(40), "event_type": "view", "user_id": 3}]]
    src = source(spark, tmp_path, "ts timestamp, event_type string, user_id bigint", batches)
    counts = run(spark, stream.windowed_counts(src, size="1 minute", late="2 minutes"), tmp_path, "counts")
    closed = sorted((r.start.minute, r.event_type, r.n, r.errors) for r in counts.collect())
    assert closed[:3] == [(0, "error", 1, 1), (0, "view", 2, 0), (1, "view", 1, 0)]
    sess = run(spark, stream.session_counts(src, gap="2 minutes", late="1 minute"), tmp_path, "sess")
    assert sorted((r.user_id, r.n_events) for r in sess.collect())[:2] == [(1, 3), (2, 1)]
    once = run(spark, stream.tally_once(src.select("ts", "user_id"), ["user_id"], late="2 hours"), tmp_path, "once")
    assert sorted(r.user_id for r in once.collect()) == [1, 2, 3]
    share = run(spark, stream.sliding_error_share(src, size="1 minute", slide="1 minute", late="1 minute"), tmp_path, "share")
    assert max(r.share for r in share.collect()) == pytest.approx(1 / 3)


def test_histogram_quantile(spark):
    b = [("a", 0.1, 10.0), ("a", 0.5, 90.0), ("a", float("inf"), 100.0), ("b", 0.1, 0.0), ("b", float("inf"), 0.0), ("c", 1.0, 96.0), ("c", float("inf"), 100.0)]
    df = spark.createDataFrame(b, "k string, le double, c double")
    got = {r.k: r.quantile for r in monitor.histogram_quantile(df, ["k"]).collect()}
    assert got["a"] == 0.5 and got["b"] is None and got["c"] == pytest.approx(95 / 96)


def test_rolling_min_and_alert(spark):
    df = spark.createDataFrame([("a", 0, 3.0), ("a", 100, 5.0), ("a", 1801, 4.0)], "k string, t bigint, v double")
    assert [r.rolling_min for r in monitor.rolling_min(df, ["k"], "v", 1800).orderBy("t").collect()] == [3.0, 3.0, 4.0]
    a = lambda n, e, p: spark.range(1).select(monitor.alert(F.lit(n), F.lit(e), F.lit(p).cast("double"))).first()[0]
    assert [a(9, 9, None), a(10, 4, None), a(10, 3, 1.0), a(10, 0, 2.5)] == ["FEW", "ALERT", "OK", "ALERT"]


def test_cache_hits(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(5000), k) for k in range(300)]
    got = {r.event_id: r.hit for r in monitor.cache_hits(spark.createDataFrame(rows, "k string, t bigint, event_id bigint"), "k", 100).collect()}
    kept, want = {}, {}
    for k, t, e in sorted(rows):
        want[e] = k in kept and t - kept[k] <= 100
        if not want[e]:
            kept[k] = t
    assert got == want


def test_scrape_loop(spark, tmp_path):
    q = stream.scrape_loop(source(spark, tmp_path, "t bigint", [[{"t": 1}], [{"t": 2}]]), str(tmp_path / "cp"), 1, "memory", "scraped")
    try:
        q.processAllAvailable()
        assert sorted(r.t for r in spark.table("scraped").collect()) == [1, 2]
    finally:
        q.stop()
    with pytest.raises(ValueError):
        stream.scrape_loop(spark.readStream.format("rate").load(), "x", 0)
