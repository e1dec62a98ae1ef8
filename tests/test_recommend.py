from pyspark.sql import functions as F

from stridewell.functions import planar, text
from stridewell.operators import recommend


def test_sequences(spark):
    ids = lambda *x: F.array(*(F.lit(v).cast("bigint") for v in x))
    r = spark.range(1).select(recommend.left_truncated(ids(1, 2, 3), 2), recommend.left_truncated(ids(1), 3), recommend.left_truncated(F.array().cast("array<bigint>"), 2), recommend.masked_labels(F.lit(3), ids(7, 8))).first()
    assert tuple(r) == ([2, 3], [0, 0, 1], [0, 0], [-100, -100, -100, 7, 8])


def test_factors_rank_what_goes_together(spark):
    rows = [(f"a{u}", f"x{i}") for u in range(12) for i in range(5) if (u + i) % 4] + [(f"b{u}", f"y{i}") for u in range(12) for i in range(5) if (u + i) % 4]
    model, users, items = recommend.fit_factors(spark.createDataFrame(rows, "user_id string, item string"), rank=4, iterations=6)
    options = spark.createDataFrame([("a1", "x3"), ("a1", "y3"), ("b1", "x3"), ("b1", "y3"), ("new", "x1"), ("a1", "new")], "user_id string, item string")
    s = {(r.user_id, r["item"]): r.score for r in recommend.factor_scores(model, users, items, options).collect()}
    assert s["a1", "x3"] > s["a1", "y3"] + 0.2 and s["b1", "y3"] > s["b1", "x3"] + 0.2
    assert s["new", "x1"] == 0 and s["a1", "new"] == 0


def test_training_pool(spark):
    users = spark.createDataFrame([(f"u{k}",) for k in range(20)], "user_id string")
    got = recommend.training_pool(users, users.filter("user_id in ('u3', 'u5')"), 6).collect()
    assert len(got) == 6 and {"u3", "u5"} <= {r.user_id for r in got} and sum(r.kept for r in got) == 2


def test_training_pool_keeps_all_beyond_the_budget(spark):
    users = spark.createDataFrame([(f"u{k}",) for k in range(20)], "user_id string")
    keep = users.filter("user_id < 'u15'").unionByName(spark.createDataFrame([("unknown",)], "user_id string"))
    mine = {f"u{k}" for k in range(20) if f"u{k}" < "u15"}
    for budget in (0, 3, len(mine), len(mine) + 2):
        got = recommend.training_pool(users, keep, budget).collect()
        assert {r.user_id for r in got if r.kept} == mine and len(got) == len({r.user_id for r in got}) == max(budget, len(mine))


def test_markers(spark):
    x = "HEAD\nown places\nTOP rest"
    r = spark.range(1).select(text.spliced(F.lit(x), F.lit("HEAD\ntheirs\nTOP z"), "HEAD\n", "\nTOP"), text.split_marker(F.lit("HEAD\nHEAD\n a\nTOP"), "HEAD\n", "\nTOP"), text.split_marker(F.lit("nothing"), "HEAD\n", "\nTOP")).first()
    assert tuple(r) == ("HEAD\ntheirs\nTOP rest", None, None)


def test_planar(spark):
    r = spark.range(1).select(planar.planar_km(F.lit(40.7), F.lit(-74.0), F.lit(41.7), F.lit(-74.0)), planar.padded(F.lit(1.0), F.lit(3.0), 1.0), planar.padded(F.lit(1.0), F.lit(1.0), 4.0)).first()
    assert abs(r[0] - 111.32) < 1e-9 and tuple(r[1]) == (0.5, 3.5) and tuple(r[2]) == (-1.0, 3.0)
