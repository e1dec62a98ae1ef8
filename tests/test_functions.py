"""Column functions on worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.functions import scoring as s
from stridewell.functions import text
from stridewell.operators import items, ranking

P4 = [0.1, 0.2, 0.3, 0.4]


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def arr(xs):
    return F.array(*(F.lit(x) for x in xs))


def test_probabilities(spark):
    p, q, e, ls = one(spark, s.softmax(arr([-1000.0, -1000.0])), s.softmax(arr([0.0, math.log(3.0)]), 2.0), s.entropy(arr([0.5, 0.5, 0.0])), s.log_softmax(arr([0.0, 0.0])))
    assert p == [0.5, 0.5]
    assert q[1] / q[0] == pytest.approx(math.sqrt(3))
    assert e == pytest.approx(math.log(2))
    assert ls[0] == pytest.approx(-math.log(2))


def test_places_and_ranks(spark):
    a, b, c, d, e = one(spark, s.argmax(arr([1.0, 3.0, 3.0])), s.argmin_null_last(F.array(F.lit(None).cast("double"), F.lit(2.0), F.lit(2.0))), s.rank_of(arr([1.0, 1.0, 1.0]), F.lit(2)), s.rank_of(arr([5.0, 1.0, 3.0]), F.lit(1)), s.argmax(F.array().cast("array<double>")))
    assert (a, b, c, d, e) == (1, 1, 1, 3, None)


def test_restricting(spark):
    x, y = one(spark, s.restricted(arr(P4), arr([True, False, False, True])), s.restricted(arr([0.0, 1.0]), arr([True, False])))
    assert x == pytest.approx([0.2, 0, 0, 0.8]) and y == [0.0, 1.0]


def test_questions(spark):
    menu = one(spark, s.questions(arr(P4), arr(["a", "b", "b", "a"])))
    assert [q.cat for q in menu] == ["a", "b"]
    assert menu[0].ig == pytest.approx(math.log(2)) and menu[0].evpi == pytest.approx(0.4 + 0.3 - 0.4)
    single = one(spark, s.questions(arr(P4), F.array(F.lit(None), F.lit("x"), F.lit(None), F.lit(None))))
    assert single[0].ig == pytest.approx(0.5004024, abs=1e-7)
    assert one(spark, s.questions(arr(P4), arr(["a"] * 4))) == []
    # equal information up to rounding: the first category wins
    assert one(spark, s.best_question(s.questions(arr(P4), arr(["b", "a", "a", "b"])), "ig")).cat == "a"
    assert one(spark, s.best_question(s.questions(arr(P4), arr(["a"] * 4)), "evpi")) is None


def test_folds(spark):
    rows = spark.createDataFrame([("alice",), ("bob",), ("carol",), ("dave",), ("7",)], "u string").select(s.fold_of(F.col("u"))).collect()
    assert [r[0] for r in rows] == [0, 1, 1, 0, 1]


def test_asking(spark):
    ask = lambda a, t, g: one(spark, s.should_ask(F.lit(a), F.lit(t).cast("double"), F.lit(g).cast("double")))
    assert [ask(True, None, None), ask(False, None, 1.0), ask(False, 0.5, None), ask(False, 0.5, 0.5), ask(False, 0.5, 0.4)] == [True, False, False, True, False]


def test_rank_metrics_of_four_rows(spark):
    rows = [("a", 0, 0, [-0.1, -2.0, -3.0, -4.0, -5.0]), ("a", 1, 0, [-0.5, -1.0, -3.0, -4.0, -5.0]), ("b", 4, 0, [-0.5, -1.0, -3.0, -4.0, -5.0]), ("b", 2, 2, [-3.0, -2.0, -0.2, -4.0, -5.0])]
    df = spark.createDataFrame([(k, k, "x", *r[1:], r[0]) for k, r in enumerate(rows)], "prediction_id int, decision_id int, arm string, answer_idx int, pick int, logprobs array<double>, user_id string")
    m = ranking.rank_metrics(df).first()
    assert (m.acc_at_1, m.acc_at_2, m.n) == (0.5, 0.75, 4)
    assert m.mrr == pytest.approx((1 + 0.5 + 0.2 + 1) / 4)
    assert {(r.user_id, r.acc) for r in ranking.user_accuracy(df).collect()} == {("a", 0.5), ("b", 0.5)}


def test_temperature_is_recovered(spark):
    import random

    rng = random.Random(0)
    rows = []
    for k in range(2000):
        z = [rng.gauss(0, 3) for _ in range(5)]
        w = [math.exp(x / 4.0) for x in z]
        rows.append((k, k, "x", rng.choices(range(5), w)[0], 0, z, f"u{k % 7}"))
    df = spark.createDataFrame(rows, "prediction_id int, decision_id int, arm string, answer_idx int, pick int, logprobs array<double>, user_id string")
    assert 3.2 < ranking.fit_temperature(df, "arm").first().temperature < 5.0


def test_ece(spark):
    bins = spark.createDataFrame([("x", 0.0, 3, 0.2, 0.3), ("x", 0.5, 7, 0.8, 0.6)], "arm string, lo double, n int, mean_conf double, accuracy double")
    assert ranking.ece(bins).first().ece == pytest.approx(0.17)


def test_sign_test_and_enumeration(spark):
    p = lambda a, b: one(spark, ranking.sign_test(F.lit(a), F.lit(b)))
    assert p(10, 0) == pytest.approx(2 / 1024)
    assert p(0, 0) == 1.0 and p(3, 3) == 1.0
    for a, b in ((1, 0), (12, 5), (40, 60), (700, 900)):
        assert p(a, b) == pytest.approx(min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)), rel=1e-9)
    means = ranking.exact_bootstrap([0.0, 1.0, 2.0])
    assert len(means) == 27 and sum(means) / 27 == pytest.approx(1.0)


def test_poisson_bootstrap_is_like_enumeration(spark):
    values = [0.1, 0.4, -0.2, 0.3, 0.0, 0.6]
    exact = ranking.exact_bootstrap(values)
    df = spark.createDataFrame([(f"u{k % 6}-{k}", values[k % 6]) for k in range(600)], "user_id string, d double")
    draws = ranking.poisson_bootstrap(df, "user_id", F.col("d"), F.lit(1.0), draws=400)
    ci = ranking.interval(draws).first()
    mean, sd = sum(values) / 6, (sum(v * v for v in values) / 6 - (sum(values) / 6) ** 2) ** 0.5
    assert ci.lo == pytest.approx(mean - 1.96 * sd / 600**0.5, abs=0.006) and ci.hi == pytest.approx(mean + 1.96 * sd / 600**0.5, abs=0.006)
    assert exact[0] < ci.lo < ci.hi < exact[-1]


def test_tokens(spark):
    cases = {"Audrey's the Café of No. 7": ["audrey", "café", "no"][:2], "R & B 2nd Street’s": ["2nd", "street"], "": [], "Naïve ÜBER-bar": ["naïve", "über", "bar"]}
    for x, want in cases.items():
        assert one(spark, text.tokens(F.lit(x))) == want


def test_choices(spark):
    cases = {"B": 1, " b) because": 1, "Based on A": 0, "the answer is C.": 2, "ABC": None, "": None, "\n\nD": 3, "x\nA": None, "F": None, "(e)": 4}
    for x, want in cases.items():
        assert one(spark, text.parse_choice(F.lit(x))) == want, x
    assert one(spark, text.parse_choice(F.lit("E"), 4)) is None and one(spark, text.parse_choice(F.lit(None).cast("string"))) is None


def test_cues(spark):
    lines = arr(["  A. x", "  B. y", "  C. z"])
    kms = F.array(F.lit(1.25), F.lit(None).cast("double"), F.lit(0.0))
    got = one(spark, text.add_cues(lines, kms))
    assert got == ["  A. x [1.2 km from the nearest place in their history]", "  B. y [distance unknown]", "  C. z [0.0 km from the nearest place in their history]"]
    assert one(spark, F.transform(arr(got), text.without_cue)) == ["  A. x", "  B. y", "  C. z"]
    with pytest.raises(Exception, match="already carries"):
        one(spark, text.add_cues(arr(got), kms))


def test_letter_logprobs(spark):
    top = F.from_json(F.lit('[{"token":" A","logprob":-1},{"token":"A","logprob":-2},{"token":"the","logprob":-0.1},{"token":"C ","logprob":-3}]'), "array<struct<token string, logprob double>>")
    assert one(spark, text.letter_logprobs(top)) == [-1.0, -30.0, -3.0, -30.0, -30.0]


def test_names_and_categories(spark):
    for x, want in {"Bean (Coffee Shop)": ("Bean", "Coffee Shop"), "Coffee Shop": ("", "Coffee Shop"), "Hub (Metro (S) Station)": ("Hub", "Metro (S) Station"), "A (S) (Metro)": ("A (S)", "Metro"), "odd)": ("", "odd)"), "": ("", "")}.items():
        assert tuple(one(spark, text.name_and_category(F.lit(x)))) == want
    pieces = lambda x: one(spark, text.outer_pieces(F.lit(x)))
    assert pieces("a (b, c), d, e (f)") == ["a (b, c)", "d", "e (f)"]
    assert pieces("") == [] and pieces("x) , (y, z") == ["x) ", "(y, z"]
    assert pieces("a (b (c, d), e), f,g, , h, ") == ["a (b (c, d), e)", "f,g", "", "h"]
    places = lambda x, *known: one(spark, text.history_places(F.lit(x), arr(list(known))))
    assert places("Joe, Inc (Bar), Park, Tail", "Park") == ["Joe, Inc (Bar)", "Park", "Tail"]
    assert places("A, B, C (Bar)", "Park") == ["A, B, C (Bar)"] and places("", "Park") == []


def test_prompt_round_trip(spark):
    hist, top, cands = ["Bean (Coffee Shop)", "Park", "Joe, Inc (Bar)"], ["Coffee Shop", "Park", "Bar"], ["X (Gym)", "Bar"]
    p = one(spark, text.render_prompt(arr(hist), arr(top), arr(cands)))
    for known in (None, ["Park"]):
        r = one(spark, text.parse_prompt(F.lit(p), known))
        assert [tuple(x) for x in r["history"]] == [("Bean", "Coffee Shop"), ("", "Park"), ("Joe, Inc", "Bar")]
        assert r["top"] == top and [tuple(x) for x in r["candidates"]] == [("X", "Gym"), ("", "Bar")]
    assert one(spark, text.parse_prompt(F.lit("nothing"))) is None and one(spark, text.parse_prompt(F.lit(None).cast("string"))) is None


def test_sentences_about_categories(spark):
    assert one(spark, text.question_text(F.lit("Italian Restaurant"))) == "Are you up for an Italian restaurant?"
    assert one(spark, text.question_text(F.lit("Health Care"))) == "Are you up for health care?"
    assert one(spark, text.reason_line(F.lit("Gym"), F.lit(1), F.lit(12))) == "You went to a gym once in your last 12 places."
    assert one(spark, text.reason_line(F.lit(None).cast("string"), F.lit(1), F.lit(12))) is None


def test_labels_and_bins(spark):
    lab = lambda c, n: one(spark, items.label(F.lit(c).cast("string"), F.lit(n).cast("string")))
    assert [lab("Bar", "Joe"), lab("Bar", None), lab(None, None), lab(None, "Joe")] == ["Joe (Bar)", "Bar", "Unknown", "Joe (Unknown)"]
    scores = spark.createDataFrame([(str(k), float(k)) for k in range(25)], "item string, score double")
    edges = items.bin_edges(scores)
    assert len(edges) == 4 and edges[0] == pytest.approx(4.8)
    assert one(spark, items.bin_of(F.lit(edges[1]), edges)) == 2
    assert sorted({r[0] for r in scores.select(items.bin_of(F.col("score"), edges)).collect()}) == [0, 1, 2, 3, 4]


def test_bootstrap_vectors_and_interval_conventions(spark):
    values = [0.1, 0.4, -0.2, 0.3, 0.0, 0.6]
    df = spark.createDataFrame([(f"u{k}", values[k % 6], "x" if k < 600 else "y") for k in range(900)], "user_id string, d double, g string").repartition(5)
    ci = {r.g: r for r in ranking.intervals(ranking.bootstrap_sums(df, "user_id", F.col("d"), F.lit(1.0), draws=2000, by=("g",)), by=("g",)).collect()}
    mean, sd = sum(values) / 6, (sum(v * v for v in values) / 6 - (sum(values) / 6) ** 2) ** 0.5
    for g, n in (("x", 600), ("y", 300)):
        assert ci[g].lo == pytest.approx(mean - 1.96 * sd / n**0.5, abs=0.006) and ci[g].hi == pytest.approx(mean + 1.96 * sd / n**0.5, abs=0.006)
        assert ci[g].lo <= ci[g].lo_at and ci[g].hi_before <= ci[g].hi_at
    draws = spark.createDataFrame([(float(k),) for k in range(1000)], "value double")
    one = ranking.intervals(draws).first()
    assert (one.lo, one.lo_at, one.hi_at, one.hi_before) == (pytest.approx(24.975), 25.0, 975.0, 974.0)
    again = ranking.bootstrap_sums(df.repartition(2), "user_id", F.col("d"), F.lit(1.0), draws=50, by=("g",)).orderBy("g", "draw").collect()
    first = ranking.bootstrap_sums(df, "user_id", F.col("d"), F.lit(1.0), draws=50, by=("g",)).orderBy("g", "draw").collect()
    assert [r.value for r in first] == pytest.approx([r.value for r in again])  # whatever the partitions
    assert ranking.bootstrap_sums(df.limit(0), "user_id", F.col("d"), F.lit(1.0)).count() == 0


def test_interpolated_values_of_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 101), ("c", 40)) for x in rng.normal(size=n).round(1)] + [("b", None)]
    got = {r.g: (r.m, r.q) for r in ranking.middle_values(spark.createDataFrame(rows, "g string, v double"), "v", "g", {"m": 0.5, "q": 0.9}).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9)))


def test_serving(spark):
    from stridewell.operators import serving

    assert one(spark, serving.ranking(F.array(*map(F.lit, [0.2, 0.5, 0.0, 0.2, 0.1])), F.array(F.lit(4)))) == [1, 0, 3]
    assert [one(spark, serving.ask_rate_text(F.lit(x).cast("double"))) for x in (None, 0.0, 0.01, 0.3132, 0.97, 1.0)] == ["Picks without asking"] * 2 + ["Asks less than once in 10 times", "Asks about 3 in 10 times", "Asks almost every time", "Asks before every pick"]
    assert one(spark, serving.number_word(F.lit(7))) == "seven" and one(spark, serving.number_word(F.lit(11))) == "11" and one(spark, serving.percent(F.lit(0.125))) == "13%"
    assert one(spark, serving.counted(F.lit(1), "place", "places")) == "1 place" and one(spark, serving.counted(F.lit(1234), "place", "places")) == "1,234 places"
    assert [one(spark, serving.verdict(F.lit(a), F.lit(b))) for a, b in ((0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1))] == ["better", "worse", "no difference shown"]
    assert [one(spark, serving.is_significant(F.lit(a), F.lit(b), F.lit(n))) for a, b, n in ((0.1, 0.2, 3), (0.1, 0.2, 2), (-0.1, 0.2, 9), (0.0, 0.0, 9))] == [True, None, False, False]


def flow(steps, n):
    out, current, accepted, mine = [], 0 if n else None, False, False
    for kind, at in steps:
        if accepted:
            continue
        if kind == "reject" and current is not None:
            out.append(current)
            current, mine = next((k for k in range(n) if k not in out), None), False
        elif kind == "select" and 0 <= at < n and at not in out:
            current, mine = at, at != 0
        elif kind == "accept" and current is not None:
            accepted = True
    return current, len(out), accepted, mine


def test_choice_flow(spark):
    from stridewell.operators import serving

    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        steps = [(str(rng.choice(["reject", "select", "accept", "look"], p=[0.5, 0.3, 0.1, 0.1])), int(rng.integers(-1, 6))) for _ in range(rng.integers(0, 12))]
        rows.append((k, steps, int(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "k int, steps array<struct<kind string, position int>>, n int")
    got = {r.k: tuple(r.s) for r in df.select("k", serving.choice_after(F.col("steps"), F.col("n")).alias("s")).collect()}
    assert got == {k: flow(steps, n) for k, steps, n in rows}


def test_quantile_of_an_array(spark):
    v = F.array(*map(F.lit, [3.0, 1.0, 2.0, 10.0]))
    assert [one(spark, s.quantile(v, q)) for q in (-1, 0, 0.5, 0.9, 2)] == [1.0, 1.0, 2.5, pytest.approx(7.9), 10.0]
    none = F.array().cast("array<double>")
    assert one(spark, s.quantile(none, 0.5)) == 0.0 and one(spark, s.quantile(none, 0.5, None)) is None
