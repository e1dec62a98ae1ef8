"""Supports of sets by lists and by bits, and how much they shuffle."""

import hashlib
import random
from statistics import median

import pytest

import __spark_entry__ as entry
from stridewell.operators import privacy


def shuffled_mb(spark) -> float:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size())) / 1e6


@pytest.mark.parametrize("fill", [False, True])
def test_unicity_by_lists_and_by_bits(spark, fill):
    """The same rows whichever values are hot and however few holders are looked through at once; against a loop."""
    rng = random.Random(5)
    held = {f"u{k:03d}": set(rng.sample("abcdefghij", rng.randrange(1, 8))) | ({"é"} if k % 9 == 0 else set()) for k in range(45)}
    shown = {u: set(sorted(v)[:5]) for u, v in held.items() if u != "u007"}
    frame = lambda x: spark.createDataFrame([(u, i) for u, v in x.items() for i in v], "user_id string, item string")
    f = {i: sum(i in v for v in held.values()) for i in "abcdefghijé"}
    want = {}
    for pool, least in (("all", 0), ("often", 18)):
        for k in (1, 3, 4):
            n, skipped = [], 0
            for u, vs in shown.items():
                vs = [v for v in vs if f[v] >= least]
                skipped += not vs or (not fill and len(vs) < k)
                for draw in range(7):
                    order = sorted(vs, key=lambda v: (int(hashlib.md5(f"0|{draw}|{u}|{v}".encode()).hexdigest()[:8], 16), v))
                    if vs and (fill or len(vs) >= k):
                        n.append(sum(set(order[:k]) <= other for other in held.values()))
            want[pool, k] = (len(n), skipped, round(n.count(1) / len(n), 9), median(n))
    for hot_users, holders in ((privacy.HOT_USERS, privacy.HOLDERS), (18, 7), (0, 1000)):
        got = privacy.unicity_of_pools(frame(shown), frame(held), "item", {"all": 0, "often": 18}, ks=(1, 3, 4), draws=7, fill=fill, hot_users=hot_users, holders=holders).collect()
        assert {(r.pool, r.k): (r.n_sets, r.users_skipped, r.unique_share, r.median_support) for r in got} == want


def test_unicity_of_nobody(spark):
    none = spark.createDataFrame([], "user_id string, item string")
    assert [tuple(r) for r in privacy.unicity_of_all(none, none, "item", ks=(1, 2)).collect()] == [(1, 0, 0, None, None), (2, 0, 0, None, None)]


@pytest.mark.parametrize("fill", [False, True])
def test_unicity_makes_no_rows_of_sets_and_holders(spark, fill):
    """300 users with the same 4 items: 20 draws of each would be looked for in 300 users."""
    same = spark.createDataFrame([(f"u{k}", i) for k in range(300) for i in "abcd"], "user_id string, item string").cache()
    before = shuffled_mb(spark)
    rows = privacy.unicity_of_all(same, same, "item", ks=(2, 3), fill=fill).collect()
    assert [(r.k, r.n_sets, r.median_support) for r in rows] == [(2, 6000, 300.0), (3, 6000, 300.0)]
    assert shuffled_mb(spark) - before < 1


def test_all_category_unicity_shuffles_little(spark, tmp_path):
    """Categories that everybody has, in the registered query."""
    rows = [(k * 100 + n, f"u{k}", 1_480_000_000 + n * 86_400, f"i{n}", f"c{n % 12}", f"n{n}", 1.0, 1.0) for k in range(200) for n in range(30)]
    df = spark.createDataFrame(rows, "seq bigint, user_id string, s bigint, item string, cat string, venue_name string, lat double, lon double")
    df.selectExpr("seq", "user_id", "timestamp_seconds(s) ts", "item", "cat", "lat", "lon", "venue_name").write.parquet(f"{tmp_path}/checkins.parquet")
    before = shuffled_mb(spark)
    got = entry.queries()["all_category_unicity"](spark, str(tmp_path)).collect()
    assert [(r.k, r.n_sets, r.users_skipped, r.unique_share, r.median_support) for r in got] == [(k, 4000, 0, 0.0, 200.0) for k in (3, 6, 10)]
    assert shuffled_mb(spark) - before < 3


def test_set_support(spark):
    """Sets of one to five values, some equal, some of values that nobody holds; against a loop."""
    rng = random.Random(6)
    held = {f"u{k:03d}": set(rng.sample("abcdefghij", rng.randrange(1, 9))) for k in range(60)}
    sets = {k: set(rng.sample("abcdefghijx", rng.randrange(1, 6))) for k in range(120)} | {200: {"x"}, 201: {"a", "b"}, 202: {"b", "a"}}
    want = {k: n for k, s in sets.items() if (n := sum(s <= v for v in held.values()))}
    pairs = spark.createDataFrame([(u, i) for u, v in held.items() for i in v] * 2, "user_id string, item string")
    wanted = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "set_id bigint, item string")
    for hot_users, holders in ((privacy.HOT_USERS, privacy.HOLDERS), (28, 7), (0, 1000)):
        got = privacy.set_support(wanted, pairs, "item", hot_users=hot_users, holders=holders).collect()
        assert {r.set_id: r.n_users for r in got} == want and len(got) == len(want)
    assert privacy.set_support(wanted, pairs.limit(0), "item").isEmpty() and privacy.set_support(wanted.limit(0), pairs, "item").isEmpty()


def test_posting_support_makes_no_rows_of_decisions_and_users(spark, tmp_path):
    """Decisions about places where everybody has been."""
    seen = spark.range(400).selectExpr("id user", "explode(array('a', 'b', 'c')) item")
    seen.selectExpr("user * 10 + ascii(item) seq", "concat('u', user) user_id", "timestamp_seconds(1480000000 + user) ts", "item", "'k' cat", "1.0D lat", "1.0D lon", "'n' venue_name").write.parquet(f"{tmp_path}/checkins.parquet")
    history = "if(id % 4 = 0, array('a', 'b', 'c'), if(id % 4 = 1, array('c', 'z', 'a', 'b', 'a'), if(id % 4 = 2, array('a', 'zz'), array('b'))))"
    spark.range(1200).selectExpr("id decision_id", "concat('u', id % 400) user_id", "timestamp_seconds(1490000000) ts", "5 k", "'a' true_item", "array('a') candidates", "0 answer_idx", f"{history} history").write.parquet(f"{tmp_path}/decisions.parquet")
    before = shuffled_mb(spark)
    got = {r.decision_id: r.n_users for r in entry.queries()["posting_support"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 if k % 4 == 2 else 400 for k in range(1200)}
    assert shuffled_mb(spark) - before < 1
