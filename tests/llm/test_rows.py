"""Operators on rows against plain Python versions."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import heavy_hitters as hh
from stridewell.llm import linked_splits as ls
from stridewell.llm import packing, runs, top_n

EVENTS = "seq bigint, user_id string, ts timestamp_ntz, item string, g string, score string, h string, n string, place string, _h string"
T0 = datetime(2015, 1, 1)


def canon(x):
    x = None if x is None else x.strip(" \t").lower()
    return x or None


def dirty(rng, x):
    return rng.choice([x, x, x, x.upper(), f" {x}", f"{x}\t "])


def make_events(spark, rng, n, users=6, items=4, span=20_000):
    rows = []
    for seq in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(users)}"
        item = f"v{rng.randrange(items)}"
        ts = T0 + timedelta(seconds=rng.randrange(span))
        row = [seq, dirty(rng, user), ts, dirty(rng, item)]
        if rng.random() < 0.1:
            row[rng.randrange(1, 4)] = rng.choice([None]) if rng.random() < 0.6 else None
        if rng.random() < 0.05:
            row[1] = " \t"
        rows.append((*row, "x", None, "y", "", "z", "w"))
        if rng.random() < 0.1:  # delivered again
            rows.append((n + seq, *row[1:], "x", None, "y", "", "z", "w"))
    return rows, spark.createDataFrame(rows, EVENTS)


def clean(rows):
    out = [(canon(r[1]), int((r[2] - datetime(1970, 1, 1)).total_seconds()) if r[2] else None, canon(r[3]), r[0]) for r in rows]
    return [r for r in out if None not in r]


@pytest.mark.parametrize("seed", range(3))
def test_runs(spark, seed):
    rng = random.Random(seed)
    rows, df = make_events(spark, rng, 600, span=60_000)
    for gap, parts in ((1800, 7), (5, 3), (10**6, 40)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted((r.user_id, r.item, r.first_seq, r.last_seq, r.start_s, r.end_s, r.n) for r in runs.runs(df, gap_s=gap).collect())
            two = sorted((r.user_id, r.first_seq, r.last_seq) for r in runs.runs(df, gap_s=gap, min_rows=2).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        want = []
        for u, t, i, s in sorted(clean(rows)):
            if want and want[-1][0] == u and want[-1][1] == i and t - want[-1][5] <= gap:
                want[-1][3], want[-1][5], want[-1][6] = s, t, want[-1][6] + 1
            else:
                want.append([u, i, s, s, t, t, 1])
        assert got == sorted(map(tuple, want))
        assert two == sorted((w[0], w[2], w[3]) for w in want if w[6] >= 2)


def test_runs_of_one_item_over_all_ranges(spark):
    df = spark.createDataFrame([(k, "a", T0 + timedelta(seconds=k), "v", *["x"] * 6) for k in range(500)], EVENTS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = runs.runs(df).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.first_seq, r.last_seq, r.n, r.duration_s) for r in got] == [(0, 499, 500, 499)]


@pytest.mark.parametrize("seed", range(2))
def test_top_n(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows, df = make_events(spark, rng, 500, span=40)
    secs = F.expr("unix_seconds(cast(ts as timestamp))")
    from stridewell.common import norm_id

    for n in (1, 5, 1000):
        got = sorted((r.group, r.pos, r.seq) for r in top_n.top_n(df, norm_id("user_id"), secs, norm_id("item"), F.col("seq"), n).collect())
        best = defaultdict(dict)
        for u, t, i, s in clean(rows):
            best[u][(t, i)] = min(s, best[u].get((t, i), s))
        want = [(u, k + 1, d[c]) for u, d in best.items() for k, c in enumerate(sorted(d, key=lambda c: (-c[0], c[1]))[:n])]
        assert got == sorted(want)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_top_n_of_groups_larger_than_a_task(spark, kind):
    """Half of the rows in one group, with ties, repeated rows and one outlier, ranked across tasks."""
    rng = random.Random(4)
    rows = [("hot" if k % 2 else f"g{k % 7}", rng.choice([3, 5, 10**15, -7, rng.randrange(1000)]), f"i{rng.randrange(300)}", k) for k in range(4000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g string, s bigint, i string, q bigint").repartition(6)
    score = F.col("s") if kind == "bigint" else F.col("s") / 8.0
    for n in (3, 120, 5000):
        got = sorted((r.group, r.pos, r.ident, r.seq) for r in top_n.top_n(df, F.col("g"), score, F.col("i"), F.col("q"), n, task_rows=100).collect())
        best = {}
        for g, s, i, q in rows:
            best.setdefault(g, {}).setdefault((-s, i), []).append(q)
        want = sorted((g, k + 1, key[1], min(v[key])) for g, v in best.items() for k, key in enumerate(sorted(v)[:n]))
        assert got == want, n


def test_cutoffs_by_bisection():
    rng = np.random.default_rng(0)
    for _ in range(50):
        groups, n = int(rng.integers(1, 6)), int(rng.integers(0, 8))
        g = rng.integers(0, groups, int(rng.integers(0, 200)))
        code = rng.choice(2**61, len(g), replace=False) if rng.random() < 0.5 else rng.permutation(len(g))
        cut = top_n.cutoffs(g, code.astype(np.int64), n, groups)
        for k in range(groups):
            assert (code[g == k] >= cut[k]).sum() == min(n, (g == k).sum())


def test_order_code_of_floats():
    x = np.array([-np.inf, -3.5, -0.0, 0.0, 1e-300, 2.0, np.inf])
    c = top_n.order_code(x, np.zeros(7, dtype=np.int64))
    assert (np.diff(c) >= 0).all() and c[2] == c[3] and len(set(c.tolist())) == 6


def test_top_n_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    import pyarrow as pa

    monkeypatch.setattr(top_n, "PIECE_ROWS", 50)
    g, s = rng.integers(0, 3, 1000), rng.integers(0, 10**6, 1000)
    batches = [pa.RecordBatch.from_arrays([pa.array([str(x) for x in g[a : a + 30]]), pa.array(s[a : a + 30]), pa.array(["i"] * len(g[a : a + 30])), pa.array(np.arange(a, min(a + 30, 1000)))], names=["g", "score", "ident", "seq"]) for a in range(0, 1000, 30)]
    out = pa.Table.from_batches(list(top_n._top(4, True)(iter(batches)))).to_pylist()
    for k in range(3):
        assert [r["score"] for r in sorted((r for r in out if r["g"] == str(k)), key=lambda r: r["pos"])] == sorted(set(s[g == k].tolist()), reverse=True)[:4]


@pytest.mark.parametrize("size", [hh.Sketch(), hh.Sketch(2, 1, 4, 2), hh.Sketch(1, 1, 1, 1), hh.Sketch(16, 2, 64, 8)])
def test_frequent_is_complete_at_any_size(spark, size):
    rng = random.Random(5)
    values = ["a"] * 300 + ["b"] * 90 + ["c"] * 50 + [f"r{rng.randrange(200)}" for _ in range(400)]
    rng.shuffle(values)
    df = spark.createDataFrame([(dirty(rng, v), "q") for v in values] + [(None, "q"), (" ", "q")], "item string, h string").repartition(5)
    got = {r.item: r.n_rows for r in hh.frequent(df, "item", 20, size).collect()}
    count = Counter(values)
    assert got == {v: n for v, n in count.items() if 20 * n >= len(values)}


def test_parts_recombine_level_by_level(spark, monkeypatch):
    """Whatever the order of merging, the bounds hold and no frequent value is lost."""
    from stridewell.llm import heavy_hitters as H

    rng = random.Random(2)
    values = [f"v{min(int(rng.expovariate(0.05)), 400)}" for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "item string").repartition(9)
    monkeypatch.setattr(H, "MERGE", 2)
    small = H.Sketch(buckets=8, slots=2, counters=64)
    count = Counter(values)
    got = {r["item"]: r.n_rows for r in H.frequent(df, "item", 60, small).collect()}
    assert got == {v: n for v, n in count.items() if 60 * n >= len(values)}
    top = H.top_values(df, "item", 6, small).collect()
    assert len(top) == 6 and all(r.n_low <= count[r["item"]] <= r.n_high for r in top)
    ties = H.top_values(spark.createDataFrame([(f"t{k}",) for k in range(9)] * 3, "item string"), "item", 4).collect()
    assert [r["item"] for r in ties] == ["t0", "t1", "t2", "t3"]


def test_sketch_bounds(spark):
    rng = random.Random(6)
    values = [f"i{int(rng.paretovariate(0.8))}" for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "item string").repartition(7)
    count = Counter(values)
    rows = hh.top_values(df, "item", 10, hh.Sketch(32, 2, 128)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.n_low <= count[r.item] <= r.n_high
    assert rows[0].item == count.most_common(1)[0][0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    assert hh.frequent(none, "item", 200).count() == 0
    assert hh.top_values(none, "item", 3).count() == 0
    assert runs.runs(none).count() == 0
    assert top_n.top_n(none, F.col("user_id"), F.col("seq"), F.col("item"), F.col("seq"), 2).count() == 0
    links = spark.createDataFrame([], "user_id string, other_id string")
    records = spark.createDataFrame([], "decision_id bigint, user_id string")
    assert ls.linked_pairs(links, records).count() == 0
    assert ls.linked_splits(records, links).count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 8).count() == 0


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("task_rows", [10**6, 30, 1])
def test_components(spark, task_rows):
    rng = random.Random(task_rows)
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]
    star = [("s000", f"s{k:03d}") for k in range(1, 60)]
    some = [(f"x{rng.randrange(120):03d}", f"x{rng.randrange(120):03d}") for _ in range(60)]
    links = chain + star + some
    rng.shuffle(links)
    raw = [(dirty(rng, a), dirty(rng, b), "r") for a, b in links] + [(b, a, "again") for a, b in links[:20]] + [(None, "x1", "r"), ("x1", " ", "r"), ("self", "SELF ", "r")]
    df = spark.createDataFrame(raw, "user_id string, other_id string, root string").repartition(6)
    got = {r.node: r.root for r in ls.components(df, task_rows=task_rows).collect()}
    want = brute_components([(a, b) for a, b in links if a != b])
    assert got == want


def test_pairs_and_splits(spark):
    rng = random.Random(3)
    links = [(f"u{rng.randrange(80)}", f"u{rng.randrange(80)}") for _ in range(40)]
    users = [f"u{rng.randrange(100)}" for _ in range(1000)] + ["hot"] * 500 + [None, None, " "]
    records = spark.createDataFrame([(k, None if u is None else dirty(rng, u), "x") for k, u in enumerate(users)], "decision_id bigint, user_id string, split string")
    linkdf = spark.createDataFrame(links, "user_id string, other_id string")
    root = brute_components([x for x in links if x[0] != x[1]])
    have = {canon(u) for u in users} - {None}
    want = {(a, b) for a in root for b in root if a < b and root[a] == root[b] and a in have and b in have}
    assert {(r.user_a, r.user_b) for r in ls.linked_pairs(linkdf, records).collect()} == want
    shares = {"train": 0.5, "validation": 0.3, "test": 0.2}
    out = ls.linked_splits(records, linkdf, shares=shares).collect()
    assert sorted(r.decision_id for r in out) == list(range(len(users)))
    by_root = defaultdict(set)
    for r in out:
        if r.root:
            by_root[r.root].add(r.split)
    assert all(len(s) == 1 for s in by_root.values())
    n = Counter(r.split for r in out)
    for name, share in shares.items():
        assert abs(n[name] / len(users) - share) < 0.03


def test_plan_splits_equals_the_greedy():
    rng = random.Random(9)
    for _ in range(60):
        sizes = {rng.randrange(1, 40): rng.choice([1, 3, 70, 500]) for _ in range(rng.randrange(1, 8))}
        shares = [rng.random() + 0.05 for _ in range(rng.randrange(1, 5))]
        plan = ls.plan_splits(list(sizes.items()), shares)
        total = sum(s * c for s, c in sizes.items())
        below = [total * x / sum(shares) for x in shares]
        for s in sorted(sizes, reverse=True):
            took = [0] * len(shares)
            for _ in range(sizes[s]):
                i = max(range(len(below)), key=lambda i: (round(below[i], 6), -i))
                took[i] += 1
                below[i] -= s
            assert sum(plan[s]) == sizes[s]
            assert sum(abs(a - b) for a, b in zip(took, plan[s])) <= 2 * len(shares)
            below = [d + (t - p) * s for d, t, p in zip(below, took, plan[s])]


def check_packing(rows, sizes, cap):
    fill, per = Counter(), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["size"]
        per[r["doc_id"]].append(r)
    assert set(per) == set(sizes)
    assert max(fill.values(), default=0) <= cap
    for k, n in sizes.items():
        pieces = sorted(per[k], key=lambda r: r["piece"])
        assert sum(r["size"] for r in pieces) == max(0, n or 0)
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at
            at += r["size"]
        if (n or 0) <= cap:
            assert len(pieces) == 1
    return fill


def test_pack(spark):
    rng = random.Random(2)
    for cap in (10, 64):
        sizes = {k: rng.choice([0, 1, 1, 2, rng.randrange(cap + 1), rng.randrange(3 * cap), cap, 2 * cap]) for k in range(700)}
        sizes |= {1000: None, 1001: -4}
        df = spark.createDataFrame([(k, v, 1, "x") for k, v in sizes.items()], "doc_id bigint, n_tokens bigint, size int, whole string")
        fill = check_packing([r.asDict() for r in packing.pack(df, cap).collect()], sizes, cap)
        need = -(-sum(max(0, v or 0) for v in sizes.values()) // cap)
        assert len(fill) <= need * 1.02 + 1


def test_plan_containers_is_best_fit():
    """The plan of ranges fills as many containers as item-by-item packing does."""
    rng = random.Random(4)
    for _ in range(100):
        cap = rng.choice([7, 30, 100])
        counts = {rng.randrange(1, cap + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))}
        spans, n = packing.plan_containers(counts, cap)
        fill = Counter()
        got = Counter()
        for s, a, z, c0, each in spans:
            for i in range(a, z):
                fill[c0 + (i - a) // each] += s
                got[s, i] += 1
        assert max(fill.values()) <= cap and len(fill) == n and set(fill) == set(range(n))
        assert got == Counter({(s, i): 1 for s, c in counts.items() for i in range(c)})
        bins = []
        large = sorted((s for s, c in counts.items() for _ in range(c) if 3 * s > cap), reverse=True)
        while large:
            s = large.pop(0)
            k = next((k for k, x in enumerate(large) if x + s <= cap), None)
            bins.append(cap - s - (large.pop(k) if k is not None else 0))
        for s in sorted((s for s, c in counts.items() for _ in range(c) if 3 * s <= cap), reverse=True):
            fits = [b for b in bins if b >= s]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - s)
            else:
                bins.append(cap - s)
        assert n == len(bins)
