"""Every registered query against its SQL, on the smallest tables; and properties of the question sets."""

import importlib
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from tools import compare

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for m in entry._MODULES for n in importlib.import_module(m).QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    said = compare.compare(spark, duck, FOLDER, name)
    assert said.startswith(("equal", "rows")), said


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0, out.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("condition", ["popmatched", "textmatched", "popmatched_period", "popular", "random"])
def test_question_sets(spark, condition):
    from stridewell.plans import choices

    rows = entry.queries()[f"{condition}_options"](spark, FOLDER).collect()
    sets = defaultdict(list)
    for r in rows:
        sets[r.user_id, r.rn].append(r)
    base = choices.Base(spark, FOLDER)
    band = {r["item"]: r.band for r in base.bands.collect()}
    past = {(r.user_id, r["item"]) for r in base.past.collect()}
    assert sets
    for opts in sets.values():
        assert sorted(o.idx for o in opts) == [0, 1, 2, 3, 4]
        assert len({o["item"] for o in opts}) == 5 and sum(o.is_true for o in opts) == 1
        if condition.startswith(("popmatched", "textmatched")):
            assert not any((o.user_id, o["item"]) in past for o in opts)
        true = next(o["item"] for o in opts if o.is_true)
        if condition == "popmatched":
            assert max(abs(band[o["item"]] - band[true]) for o in opts) <= 19


def test_whole_job_asks_every_held_out_decision(spark):
    """All eligible users' decisions, revisits too; widths and pools as when the pools are enumerated."""
    from pyspark.sql import functions as F

    from stridewell.operators import items, questions
    from stridewell.plans import choices

    b = choices.Base(spark, FOLDER)
    b._b = choices._all(spark, FOLDER)
    whole = {c: choices._all(spark, FOLDER, c) for c in ("textmatched", "popmatched_period")}
    held = {(r.user_id, r.rn) for r in b.parts.filter("held").collect()}
    assert len(held) == b.cohort.count() > b.novel.count()
    assert {(r.user_id, r.rn) for r in choices.all_decoy_width(spark, FOLDER).collect()} == held
    labels = b.events.select("item").distinct().join(items.metadata(b.events), "item", "left").select("item", items.label(F.col("cat"), F.col("name")).alias("label"))
    label = {r["item"]: r.label for r in labels.collect()}
    decided = b.cohort.withColumn("per", items.period(F.col("t")))
    scores = choices._scores(b.events)
    bins = scores.withColumn("g", items.bin_of(F.col("score"), items.bin_edges(scores)))
    pools = {
        "textmatched": (questions.generic_pool(b.wide().filter("width is not null"), b.cohort_past, b.bands, bins), "g_width", whole["textmatched"].generic[0], choices.all_textmatched_options),
        "popmatched_period": (questions.period_pool(decided, b.cohort_past, b.bands, items.period_profile(b.events, b.parts), labels), "p_width", whole["popmatched_period"].period[0].filter("p_width is not null"), choices.all_popmatched_period_options),
    }
    for condition, (pool, width, spans, options) in pools.items():
        want, members = {}, defaultdict(set)
        for r in pool.collect():
            want[r.user_id, r.rn] = r[width]
            members[r.user_id, r.rn].add(r["item"])
        got = {(r.user_id, r.rn): r for r in spans.collect()}
        assert {x: r[width] for x, r in got.items()} == want and len(want) > 300, condition
        sets = defaultdict(list)
        for r in options(spark, FOLDER).collect():
            sets[r.user_id, r.rn].append(r)
        assert set(sets) == {x for x, m in members.items() if len(m) >= 4}
        for x, opts in sets.items():
            decoys = {o["item"] for o in opts if not o.is_true}
            assert len(opts) == 5 and len(decoys) == 4 and decoys <= members[x]
            if width == "p_width":
                assert len({label[o["item"]] for o in opts}) == 5 and got[x].n_labels == len({label[i] for i in members[x]})


def test_builder(spark):
    """Parameters, their errors, exclusions that change nothing for the others, and kinds that sum up."""
    from pyspark.sql import functions as F

    from stridewell.operators.build import Builder, training_instances
    from stridewell.sources.events import events

    e = events(spark, FOLDER).persist()
    for wrong in ({"condition": "x"}, {"kind": "x"}, {"k": 1}, {"condition": "textmatched"}):
        with pytest.raises(ValueError):
            Builder(e, **wrong)
    some = e.select("item").distinct().filter("item not like '%1%'").withColumn("score", F.lit(0.5))
    with pytest.raises(ValueError, match="items have no score"):
        Builder(e, "textmatched", scores=some).options
    rows = lambda b: {(r.user_id, r.rn, r.idx, r["item"]) for r in b.options.collect()}
    pooled, novel, revisit = (rows(Builder(e, "random", k=3, kind=kind)) for kind in ("pooled", "novel", "revisit"))
    assert pooled == novel | revisit and not novel & revisit and max(x[2] for x in pooled) == 2
    gone = min(pooled)[0]
    out = spark.createDataFrame([(gone,)], "user_id string")
    assert rows(Builder(e, "random", k=3, exclude=out)) == {x for x in pooled if x[0] != gone}
    b, options = training_instances(e, cap=3)
    assert b.decisions.groupBy("user_id").count().agg(F.max("count")).first()[0] == 3
    _, fewer = training_instances(e, cap=3, exclude=out)
    assert set(map(tuple, fewer.collect())) == {tuple(r) for r in options.collect() if r.user_id != gone}


def test_draws_follow_the_weights(spark):
    from pyspark.sql import functions as F

    from stridewell.operators import questions

    weights = [1, 2, 3, 4, 10]
    line, at = [], 0
    for k, w in enumerate(weights):
        line.append((f"i{k}", at, w))
        at += w
    line = spark.createDataFrame(line, "item string, w_from bigint, w bigint")
    d = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(1).alias("rn"), F.lit("none").alias("item"), F.lit(0).cast("bigint").alias("lo"), F.lit(at).cast("bigint").alias("hi"))
    first = Counter(r["item"] for r in questions.draw_decoys(d, line, None, 2).filter("nth = 0").collect())
    for k, w in enumerate(weights):
        assert abs(first[f"i{k}"] / 4000 - w / at) < 0.03
    # the race has the same distribution
    pool = d.select("user_id", "rn").crossJoin(line.select("item", "w"))
    raced = Counter(r["item"] for r in questions.race(pool, 2, 1, F.col("w")).filter("nth = 0").collect())
    for k, w in enumerate(weights):
        assert abs(raced[f"i{k}"] / 4000 - w / at) < 0.03


def test_widening_against_a_loop(spark):
    import random

    from stridewell.operators import questions

    rng = random.Random(0)
    items = [f"i{k:02d}" for k in range(24)]
    band = {i: rng.randrange(20) for i in items}
    order = sorted(items, key=lambda i: (band[i], i))
    bands = spark.createDataFrame([(i, 0, band[i], n, n) for n, i in enumerate(order)], "item string, pop bigint, band int, rank bigint, w_from bigint")
    past, decided = [], []
    for u in range(30):
        past += [(f"u{u}", i) for i in rng.sample(items, rng.choice([0, 5, 15, 21]))]
        decided += [(f"u{u}", k, 0, rng.choice(items)) for k in range(4)]
    got = {(r.user_id, r.rn): r.width for r in questions.decoy_width(spark.createDataFrame(decided, "user_id string, rn int, t bigint, item string"), spark.createDataFrame(past, "user_id string, item string"), bands).collect()}
    old = defaultdict(set)
    for u, i in past:
        old[u].add(i)
    for u, k, _, true in decided:
        want = next((w for w in range(20) if len([i for i in items if abs(band[i] - band[true]) <= w and i != true and i not in old[u]]) >= 4), None)
        assert got[u, k] == want
    assert len(set(got.values())) > 3


def test_fallback_enumerates_the_pool(spark):
    """A stretch on which nearly all weight is the true item: draws alone would not find four others."""
    from stridewell.operators import questions

    line = spark.createDataFrame([("big", 0, 10**9)] + [(f"s{k}", 10**9 + k, 1) for k in range(5)], "item string, w_from bigint, w bigint")
    d = spark.createDataFrame([("u", 1, "big", 0, 10**9 + 5), ("v", 1, "s0", 10**9, 10**9 + 3)], "user_id string, rn int, item string, lo bigint, hi bigint")
    rows = questions.draw_decoys(d, line, spark.createDataFrame([("u", "s4")], "user_id string, item string"), 4).collect()
    assert sorted(r["item"] for r in rows if r.user_id == "u") == ["s0", "s1", "s2", "s3"]
    assert sorted(r["item"] for r in rows if r.user_id == "v") == ["s1", "s2"]


def test_ordered_timeline_over_blocks(spark):
    import random

    from stridewell.operators import timeline

    rng = random.Random(1)
    rows = [(k, rng.choice(["hot", "hot", "u1", "u2"]), rng.randrange(3000), f"i{rng.randrange(3)}") for k in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, user_id string, t bigint, item string")
    for block in (10**9, 100, 7):
        got = {r.seq: (r.rn, r.n, r.prev and r.prev.seq) for r in timeline.ordered(df, block_s=block).collect()}
        for u in ("hot", "u1", "u2"):
            line = sorted((t, i, s) for s, v, t, i in rows if v == u)
            for k, (_, _, s) in enumerate(line):
                assert got[s] == (k + 1, len(line), line[k - 1][2] if k else None)


def test_global_rank(spark):
    from stridewell.operators import items

    df = spark.createDataFrame([(k * 7 % 100, k) for k in range(300)], "a int, b int").repartition(7)
    rows = sorted(items.global_rank(df, ["a", "b"], add_up="b").collect(), key=lambda r: r["rank"])
    want = sorted((k * 7 % 100, k) for k in range(300))
    assert [(r.a, r.b) for r in rows] == want and [r["rank"] for r in rows] == list(range(300))
    total = 0
    for r in rows:
        assert r.before == total and r.rows == 300 and r.total == sum(range(300))
        total += r.b
    assert items.global_rank(df.limit(0), ["a", "b"]).count() == 0


def test_donors(spark):
    from pyspark.sql import functions as F

    from stridewell.operators import controls

    users = spark.createDataFrame([(f"u{k}",) for k in range(7)], "user_id string")
    rows = users.crossJoin(spark.range(200).select(F.col("id").alias("n"))).select(F.concat_ws("-", "user_id", "n").alias("row"), "user_id")
    got = controls.random_donors(rows, users, "row").collect()
    assert len(got) == 1400 and all(r.user_id != r.donor for r in got)
    count = Counter(r.donor for r in got)
    assert len(count) == 7 and min(count.values()) > 140
    assert controls.random_donors(rows.filter("user_id = 'u1'"), users.limit(1), "row").count() == 0


def test_donors_of_all_users(spark):
    """Every query user gets a donor, never one with the same history; against a loop."""
    import math
    import random

    from stridewell.operators import controls

    rng = random.Random(3)
    seen = {f"u{k:02d}": [rng.choice(["a", "b", "c", None]) for _ in range(rng.choice([5, 6, 7, 20, 90]))] for k in range(40)}
    seen |= {"v1": ["a"] * 400, "v2": ["a"] * 401, "v3": [None] * 1500}
    shown = {u: ("same" if u in ("v1", "v2", "u01", "u02", "u03") else u) for u in seen}
    events = spark.createDataFrame([(u, c) for u, cs in seen.items() for c in cs], "user_id string, cat string")
    histories = spark.createDataFrame(list(shown.items()), "user_id string, history string")
    want = {}
    for u, mine in seen.items():
        ranked = []
        for v, other in seen.items():
            if u != v and shown[u] != shown[v]:
                x, y = (Counter(c for c in cs if c) for cs in (mine, other))
                size = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
                ratio = abs(math.log(len(other) / len(mine)))
                ranked.append((next(k for k, b in enumerate(controls.RATIOS) if ratio <= (math.log(b) if b < math.inf else b) + 1e-12), -round(sum(n * y[c] for c, n in x.items()) / size if size else 0.0, 12), round(ratio, 12), v))
        b, c, r, v = min(ranked)
        want[u] = (v, b, round(-c, 9), round(r, 9))
    for block in (512, 3):
        got = controls.matched_donors_of_all(events, events, histories, block=block).collect()
        assert {r.user_id: (r.donor, r.band, round(r.cosine, 9), round(r.ratio, 9)) for r in got} == want and len(got) == len(seen)


@pytest.mark.parametrize("fill", [False, True])
def test_unicity_of_all_users(spark, fill):
    """Every user and draw counts, against a loop over the same hashes."""
    import hashlib
    import random
    from statistics import median

    from stridewell.operators import privacy

    rng = random.Random(4)
    held = {f"u{k:03d}": set(rng.sample("abcdefgh", rng.randrange(1, 8))) for k in range(45)}
    shown = {u: set(sorted(v)[:5]) for u, v in held.items()}
    frame = lambda x: spark.createDataFrame([(u, i) for u, v in x.items() for i in v], "user_id string, item string")
    rows = {r.k: r for r in privacy.unicity_of_all(frame(shown), frame(held), "item", ks=(1, 3, 4), draws=7, fill=fill).collect()}
    for k in (1, 3, 4):
        n = []
        for u, vs in shown.items():
            for draw in range(7):
                order = sorted(vs, key=lambda v: (int(hashlib.md5(f"0|{draw}|{u}|{v}".encode()).hexdigest()[:8], 16), v))
                if fill or len(vs) >= k:
                    n.append(sum(set(order[:k]) <= other for other in held.values()))
        skipped = 0 if fill else sum(len(vs) < k for vs in shown.values())
        assert (rows[k].n_sets, rows[k].users_skipped, rows[k].median_support) == (len(n), skipped, median(n))
        assert abs(rows[k].unique_share - n.count(1) / len(n)) < 1e-8


def test_unicity_queries_take_all_users(spark):
    from stridewell.plans import choices

    asked = choices.Base(spark, FOLDER).novel.select("user_id").distinct().count()
    rows = entry.queries()["all_unicity_k"](spark, FOLDER).collect()
    assert sorted((r.pool, r.k) for r in rows) == sorted((p, k) for p in ("all", "20 or more users") for k in (1, 2, 3, 4))
    assert all(r.n_sets + 20 * r.users_skipped == 20 * asked for r in rows) and max(r.n_sets for r in rows) == 20 * asked
    assert {r.k for r in entry.queries()["all_category_unicity"](spark, FOLDER).collect()} == {3, 6, 10}


def test_paths_of_json_texts(spark):
    from stridewell.operators import checks

    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": "x"}'), (2, "[true, []]"), (3, "{broken"), (4, None), (5, "7")], "k int, j string")
    got = sorted((r.k, r.path, r.value) for r in checks.json_paths(df, "k", "j").collect() if r.value is not None)
    assert got == [(1, "a.b[0]", "1"), (1, "d", "x"), (2, "[0]", "true"), (5, "", "7")]


def test_timelines_of_full_blocks(spark):
    """Numbers and neighbours are the same however finely a full block is cut."""
    import random

    from stridewell.operators import timeline

    rng = random.Random(0)
    rows = [("hot" if k % 3 else f"u{k % 11}", rng.randrange(0, 400_000), f"i{rng.randrange(5)}", k) for k in range(900)]
    df = spark.createDataFrame(rows, "user_id string, t bigint, item string, seq bigint")
    want = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == u))
        for k, r in enumerate(mine):
            want[r[2]] = (k + 1, len(mine), mine[k - 1] if k else None)
    for block_s, task_rows in ((timeline.BLOCK_S, 20), (100_000, 7), (timeline.BLOCK_S, 10_000)):
        got = {r.seq: (r.rn, r.n, tuple(r.prev) if r.prev else None) for r in timeline.ordered(df, block_s=block_s, task_rows=task_rows).collect()}
        assert got == want


def test_training_rows_fit_their_budget(spark):
    from pyspark.sql import functions as F

    from stridewell.operators import recommend

    ids = lambda n: F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))
    row = lambda p, c, budget, least: spark.range(1).select(recommend.instance_ids(ids(p), ids(c), budget, least).alias("r")).first().r
    r = row(50, 2, 40, 32)
    assert r.ids == [*range(13, 51), 1, 2] and r.labels == [-100] * 38 + [1, 2]
    assert row(3, 2, 40, 32).labels == [-100] * 3 + [1, 2] and row(50, 10, 40, 32) is None


def test_composite_is_nobody(spark):
    from stridewell.operators import privacy

    visits = spark.createDataFrame([(f"u{k % 5}", f"i{k % 7}", "ab"[k % 2]) for k in range(40)], "user_id string, item string, cat string")
    held = {}
    for r in visits.collect():
        held.setdefault(r.user_id, set()).add(r["item"])
    rows = privacy.composite(visits, ["a", "b"], least_users=2).collect()
    assert all(not {r["item"] for r in rows} <= v for v in held.values()) or not rows
    assert len({r.user_id for r in rows}) == len(rows)


def test_checks_find_what_is_wrong(spark):
    from stridewell.operators import checks

    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (4, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "k int, v string")
    assert sorted((r.side, r.k) for r in checks.differences(a, b, ["k"]).collect()) == [("a", 2), ("b", 3)]
    c = spark.createDataFrame([(1, "x"), (2, "q"), (4, None)], "k int, v string")
    assert sorted(r.k for r in checks.misaligned(b, c, ["k"], ["v"]).collect()) == [2, 3]
    assert [r.k for r in checks.shared(a, spark.createDataFrame([(4,), (9,)], "k int"), "k").collect()] == [4]
    assert checks.differences(a, a, ["k"]).isEmpty()
    x = spark.createDataFrame([("a.b", "0.5"), ("a.c", "yes"), ("d", "1"), ("e", None)], "path string, value string")
    y = spark.createDataFrame([("a.b", "0.50000000001"), ("a.c", "no"), ("f", "1"), ("e", None)], "path string, value string")
    assert sorted(r.path for r in checks.value_differences(x, y, ["path"]).collect()) == ["a.c", "d", "f"]
