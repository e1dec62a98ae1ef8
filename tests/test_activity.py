"""Sessions, feature vectors and nearby points against plain Python versions."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from stridewell.operators import features, nearby
from stridewell.operators.ranked import numbered
from stridewell.operators.sessions import session_runs, sessions

EVENTS = "seq bigint, user_id string, ts timestamp_ntz, item string, cat string, lat double, lon double, n_events bigint, t string, block string, idx string"
T0 = datetime(2015, 1, 1)
E0 = datetime(1970, 1, 1)


def canon(x):
    return (x.strip(" \t").lower() or None) if x is not None else None


def rows_of(rng, n, span):
    rows = []
    for k in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(6)}"
        row = [k, rng.choice([user, user.upper(), f" {user}\t"]), T0 + timedelta(seconds=rng.randrange(span)), f"v{rng.randrange(4)}", rng.choice(["Park", "park ", "Bar", "odd"]), 1.0, 2.0]
        if rng.random() < 0.15:
            row[rng.randrange(1, 7)] = None
        rows.append((*row, 7, "x", "y", "z"))
    return rows


def secs(d):
    return int((d - E0).total_seconds())


def test_sessions_of_one_hot_block_and_of_small_and_large_gaps(spark, monkeypatch):
    """One account with all rows in one block, several times at the same second; tasks that cut between blocks."""
    from stridewell.operators import sessions as module

    rows = [("hot", datetime(2018, 1, 1) + timedelta(seconds=(k * 37) % 50_000)) for k in range(60_000)]
    rows += [(f"u{k % 50}", datetime(2018, 1, 1) + timedelta(days=k * 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz")
    for gap in (0, 5, 60, 3_000_000):
        got = sorted((r.user_id, r.start_s, r.end_s, r.n_events) for r in sessions(df, gap_s=gap).collect())
        want = []
        times = {}
        for u, t in rows:
            times.setdefault(u, []).append(secs(t))
        for u, ts in times.items():
            ts.sort()
            begin = 0
            for k in range(1, len(ts) + 1):
                if k == len(ts) or ts[k] - ts[k - 1] > gap:
                    want.append((u, ts[begin], ts[k - 1], k - begin))
                    begin = k
        assert got == sorted(want), gap
    monkeypatch.setattr(module, "TASK_ROWS", 7)
    import pyarrow as pa

    table = pa.table({"user_id": ["a"] * 9 + ["b"] * 9, "block": [0] * 5 + [1] * 4 + [0] * 9, "t": [*range(0, 5), *range(100, 104), *range(0, 90, 10)], "n": [1] * 18})
    out = pa.Table.from_batches(list(module._block_sessions(5, 100)(iter(table.to_batches(max_chunksize=2))))).to_pylist()
    assert [(r["user_id"], r["start_s"], r["n_events"]) for r in out] == [("a", 0, 5), ("a", 100, 4), *(("b", k, 1) for k in range(0, 90, 10))]


@pytest.mark.parametrize("gap", [0, 1, 63, 64, 900, 14_400])
def test_sessions(spark, gap):
    rng = random.Random(gap)
    rows = rows_of(rng, 400, 400_000)
    for block in (1 << 22, 30_000):
        if block <= 2 * gap:
            continue
        got = sorted((r.user_id, r.start_s, r.end_s, r.duration_s, r.n_events) for r in sessions(spark.createDataFrame(rows, EVENTS), gap_s=gap, block_s=block).collect())
        want, last = [], None
        for u, t in sorted((canon(r[1]), secs(r[2])) for r in rows if canon(r[1]) and r[2]):
            if last and last[0] == u and t - last[2] <= gap:
                last[2], last[4] = t, last[4] + 1
            else:
                last = [u, t, t, 0, 1]
                want.append(last)
        assert got == sorted((u, a, b, b - a, n) for u, a, b, _, n in want)


def test_session_over_many_blocks(spark):
    rows = [(k, "a", T0 + timedelta(seconds=50 * k), *["v", "c", 1.0, 1.0, 1, "x", "y", "z"]) for k in range(400)]
    got = sessions(spark.createDataFrame(rows, EVENTS), gap_s=60, block_s=130).collect()
    assert [(r.duration_s, r.n_events) for r in got] == [(50 * 399, 400)]


def test_session_runs_before_1970():
    g = np.zeros(3, dtype=np.int64)
    assert [x.tolist() for x in session_runs(g, np.array([-10, -5, 20]), 1, 5)] == [[0, 0], [-10, 20], [-5, 20], [2, 1]]


def test_feature_vectors(spark):
    rows = rows_of(random.Random(1), 500, 4000)
    rows += rows[:50]
    df = spark.createDataFrame(rows, EVENTS)
    types = features.type_dictionary(spark.createDataFrame([("Park",), (" bar",), (None,), ("PARK",), ("zoo",)], "cat string"))
    assert types == ["bar", "park", "zoo"]
    low, high = secs(T0) + 100, secs(T0) + 3000
    v = features.sparse_vectors(df, types, distinct_by=("item",), between=(low, high))
    want = defaultdict(lambda: [set(), 0, 0])
    for r in rows:
        u, i, c = canon(r[1]), canon(r[3]), canon(r[4])
        if u and i and c and r[2] and low <= secs(r[2]) < high:
            w = want[u, c if c in types else "(other)"]
            w[0].add((c, secs(r[2]), i))
            w[1] += 1
            w[2] = max(w[2], secs(r[2]))
    want = {k: (len(a), float(b), c) for k, (a, b, c) in want.items()}
    assert {(r.user_id, r.cat): (r.n, r.total, r.last_s) for r in features.entries(v, types).collect()} == want
    wide = features.expand(v, types).collect()
    assert len(wide) == len({u for u, _ in want})
    for r in wide:
        for stem, cat in zip(features.column_names(types), [*types, "(other)"]):
            n, total, last = want.get((r.user_id, cat), (0, 0.0, None))
            assert (r[f"n_{stem}"], r[f"total_{stem}"], r[f"last_s_{stem}"]) == (n, total, last)


def test_features_keep_rows_without_an_item(spark, tmp_path):
    from stridewell.plans import activity

    rows = [(k, u, T0 + timedelta(seconds=t), i, c, 1.0, 2.0, 1, "x", "y", "z") for k, (u, t, i, c) in enumerate([("a", 1, "v", "Bar"), ("a", 1, "v", "Bar"), ("a", 9, None, "Bar"), ("a", 9, " ", "bar"), ("a", 5, None, "Park"), ("b", 7, "", "Park"), (None, 8, None, "Park")])]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/checkins.parquet")
    spark.createDataFrame([("bar",), ("park",), ("zoo",)], "cat string").write.parquet(f"{tmp_path}/categories.parquet")
    got = {r.user_id: r for r in activity.p5_features(spark, str(tmp_path)).collect()}
    t = secs(T0)
    pick = lambda r, c: (r[f"n_{c}"], r[f"total_{c}"], r[f"last_s_{c}"])
    assert set(got) == {"a", "b"}
    assert pick(got["a"], "bar") == (1, 4.0, t + 9) and pick(got["a"], "park") == (0, 1.0, t + 5) and pick(got["a"], "zoo") == (0, 0.0, None)
    assert pick(got["b"], "park") == (0, 1.0, t + 7) and pick(got["b"], "bar") == (0, 0.0, None)


def test_merging_vectors_equals_one_pass(spark):
    rows = rows_of(random.Random(2), 300, 4000)
    types = ["park"]
    a, b = (features.sparse_vectors(spark.createDataFrame(x, EVENTS), types) for x in (rows[:100], rows[100:]))
    key = lambda df: sorted((r.user_id, [tuple(e) for e in r.vec]) for r in df.collect())
    assert key(features.merge_vectors(a, b)) == key(features.sparse_vectors(spark.createDataFrame(rows, EVENTS), types))


def test_column_names_are_distinct():
    assert len(set(features.column_names(["a b", "a-b", "other"]))) == 4


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * nearby.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))


@pytest.mark.parametrize("radius", [0.08, 30.0])
def test_near_pairs(spark, radius):
    rng = random.Random(int(radius * 100))
    d = radius / 111
    places = []
    for lat, lon in ((0, 0.01), (52, 13), (-33, 180), (90, 10), (-90, 0), (60, -180), (0, -179.99999)):
        for _ in range(25):
            x, y = rng.gauss(0, d), rng.gauss(0, d / max(0.01, math.cos(math.radians(lat))))
            places.append((max(-90.0, min(90.0, lat + x)), (lon + y + 180) % 360 - 180))
    places += [places[3]] * 3
    ids = [f"v{k:03d}" for k in range(len(places))]
    asked = [rng.random() < 0.4 for _ in places]
    rows = [(i, *p, q, 1, "c") for i, p, q in zip(ids, places, asked)]
    rows += [("nan", float("nan"), 1.0, True, 1, "c"), ("null", None, 1.0, True, 1, "c"), ("far", 91.0, 1.0, True, 1, "c"), ("zero", 0.0, 0.0, True, 1, "c"), (None, 52.0, 13.0, True, 1, "c")]
    df = spark.createDataFrame(rows, "item string, lat double, lon double, is_query boolean, cell int, part string")
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if (asked[a] or asked[b]) and km(places[a], places[b]) <= radius}
    for dense in (1000, 2):
        got = [(r.item_a, r.item_b) for r in nearby.near_pairs(df, radius, dense=dense).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_first_places_and_candidates(spark):
    c = [(5, "u", T0, "A", "c", 10.0, 10.0), (2, "u", T0, " a", "c", 20.0, 20.0), (1, "u", T0, "a", "c", float("nan"), 1.0), (3, "u", T0, "b", "c", 20.0, 20.0001), (4, "u", T0, "c", "c", 20.0, 20.0001)]
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in c], EVENTS)
    q = spark.createDataFrame([(["B", None, " "],), (None,), ([],)], "candidates array<string>")
    got = {(r.item_a, r.item_b) for r in nearby.venues_near_candidates(df, q).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_numbered(spark):
    df = spark.createDataFrame([(k % 3 if k > 50 else 7, k, "x") for k in range(200)], "c int, id int, rank string").drop("rank")
    for bucket in (10**6, 10):
        out = numbered(df, ["c"], ["id"], 200, bucket_rows=bucket).collect()
        by = defaultdict(list)
        for r in out:
            by[r.c].append(r["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(out) == 200


def test_empty(spark):
    none = spark.createDataFrame([], EVENTS)
    assert sessions(none).count() == 0
    assert features.sparse_vectors(none, ["a"]).count() == 0
    assert features.expand(features.sparse_vectors(none, ["a"]), ["a"]).count() == 0
    assert nearby.venues_near_candidates(none, spark.createDataFrame([], "candidates array<string>")).count() == 0


def test_near_pairs_in_crowded_cells(spark):
    """Many venues in one cell, thousands at one point, few queries: cut to the smallest cells and spread beyond."""
    rng = random.Random(3)
    at = [(51.5 + rng.random() * 4e-4, -0.1 + rng.random() * 4e-4) for _ in range(20_000)] + [(51.5001, -0.1001)] * 3000 + [(51.7 + rng.random(), rng.random()) for _ in range(2000)]
    rows = [(f"v{k:06d}", *p, k % 2300 == 7) for k, p in enumerate(at)]
    df = spark.createDataFrame(rows, "item string, lat double, lon double, is_query boolean")
    got = {(r.item_a, r.item_b) for r in nearby.near_pairs(df, 0.02, dense=64, depth=4).collect()}
    lat, lon = (np.radians([r[c] for r in rows]) for c in (1, 2))
    want = set()
    for k, r in enumerate(rows):
        if r[3]:
            h = np.sin((lat - lat[k]) / 2) ** 2 + np.cos(lat[k]) * np.cos(lat) * np.sin((lon - lon[k]) / 2) ** 2
            want |= {tuple(sorted((r[0], rows[j][0]))) for j in np.flatnonzero(2 * nearby.EARTH_KM * np.arcsin(np.sqrt(h)) <= 0.02) if j != k}
    assert got == want and len(want) > 10_000


def test_spread_join(spark):
    from stridewell.operators.ranked import spread_join

    many = spark.createDataFrame([(("a" if k % 3 else f"k{k}") if k % 50 else None, k) for k in range(1000)], "k string, v int")
    one = spark.createDataFrame([("a", 1), ("k3", 2), ("zz", 3)], "k string, w int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(one, "k", how).select("v", "w").collect()), key=str)
        assert sorted(map(tuple, spread_join(many, one, "k", how, task_rows=40).select("v", "w").collect()), key=str) == want
