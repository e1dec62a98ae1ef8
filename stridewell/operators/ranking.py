"""Accuracy, ranks, calibration, and the value of asking, over tables of predictions.

A prediction row has prediction_id, decision_id, arm, answer_idx, pick, logprobs, user_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from .items import global_rank
from .sampling import hash32, uniform

def n_rows() -> Column:
    return F.count(F.lit(1))
#: A loss is never counted as more than this.
LARGEST_LOSS = 690.7755278982137
#: Edges of the reliability bins; the last one closes above 1.
EDGES = (0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.01)


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 9)


def is_right(pick: str = "pick") -> Column:
    """A pick that is missing is wrong."""
    return F.coalesce(F.col(pick) == F.col("answer_idx"), F.lit(False))


def user_accuracy(preds: DataFrame, *by: str) -> DataFrame:
    return preds.groupBy(*by, "user_id").agg(n_rows().alias("n"), F.avg(is_right().cast("double")).alias("acc"))


def micro_macro(preds: DataFrame) -> DataFrame:
    """By arm: accuracy over decisions and over users, and the share without a pick."""
    u = preds.groupBy("arm", "user_id").agg(n_rows().alias("n"), F.sum(is_right().cast("int")).alias("hits"), F.count_if(F.col("pick").isNull()).alias("unparsed"))
    return u.groupBy("arm").agg(
        F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("hits") / F.col("n")), 9).alias("macro"), F.round(F.sum("unparsed") / F.sum("n"), 9).alias("unparsed")
    )


def rank_metrics(preds: DataFrame) -> DataFrame:
    r = preds.withColumn("r", s.rank_of(F.col("logprobs"), F.col("answer_idx")))
    return r.groupBy("arm").agg(n_rows().alias("n"), *(share(F.col("r") <= k).alias(f"acc_at_{k}") for k in (1, 2, 3)), F.round(F.avg(1 / F.col("r")), 9).alias("mrr"))


def with_probs(preds: DataFrame) -> DataFrame:
    return preds.withColumn("p", s.softmax(F.col("logprobs"))).withColumn("maxp", F.array_max("p")).withColumn("top", s.argmax(F.col("logprobs")))


def bin_index(c: Column) -> Column:
    out = F.lit(-1)
    for e in EDGES[:-1]:
        out = out + (c >= e).cast("int")
    return out


def reliability(preds: DataFrame) -> DataFrame:
    """By arm and bin of the largest probability (rounded to 9 digits): lo, n, mean_conf, accuracy; empty bins left out."""
    r = with_probs(preds).withColumn("c", F.round("maxp", 9)).withColumn("b", bin_index(F.col("c")))
    lo = F.element_at(F.array(*map(F.lit, EDGES[:-1])), F.col("b") + 1)
    return r.groupBy("arm", "b").agg(n_rows().alias("n"), F.avg("c").alias("mean_conf"), F.avg((F.col("top") == F.col("answer_idx")).cast("double")).alias("accuracy")).select("arm", lo.alias("lo"), "n", F.round("mean_conf", 7).alias("mean_conf"), F.round("accuracy", 9).alias("accuracy"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error by arm, from its reliability bins."""
    return bins.groupBy("arm").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("accuracy"))) / F.sum("n"), 7).alias("ece"))


def confidently_wrong(preds: DataFrame, levels=(0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    r = with_probs(preds).withColumn("wrong", F.col("top") != F.col("answer_idx"))
    one = r.groupBy("arm").agg(n_rows().alias("n"), *(F.count_if(F.col("wrong") & (F.round("maxp", 9) >= x)).alias(f"l{k}") for k, x in enumerate(levels)))
    rows = F.array(*(F.struct(F.lit(x).alias("level"), F.col(f"l{k}").alias("n_wrong")) for k, x in enumerate(levels)))
    return one.select("arm", "n", F.inline(rows)).select("arm", "level", "n_wrong", F.round(F.col("n_wrong") / F.col("n"), 9).alias("share"))


def temperature_nll(preds: DataFrame, *by: str, low: float = 0.25, high: float = 50.0, steps: int = 200) -> DataFrame:
    """Mean negative log-likelihood of the answers at each temperature of a log-spaced grid.

    Each task keeps one vector of sums, a value a temperature, for each of the few groups; the vectors are then added up.
    """
    grid = low * np.power(high / low, np.arange(steps) / (steps - 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        count: dict[tuple, int] = {}
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[2:]))) or [()] * batch.num_rows
            lists, answer = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(size) - size
            for k in np.unique(size):  # rows of k options together
                rows = np.flatnonzero((size == k) & (answer >= 0) & (answer < k))
                for at in range(0, len(rows), 2000):
                    r = rows[at : at + 2000]
                    z = flat[start[r][:, None] + np.arange(k)]
                    z = z - z.max(1, keepdims=True)
                    loss = np.log(np.exp(z[:, :, None] / grid).sum(1)) - z[np.arange(len(r)), answer[r]][:, None] / grid
                    loss = np.minimum(loss, LARGEST_LOSS)
                    mine = [keys[x] for x in r]
                    for key in set(mine):
                        pick = np.array([m == key for m in mine])
                        total[key] = total.get(key, 0) + loss[pick].sum(0)
                        count[key] = count.get(key, 0) + int(pick.sum())
        if total:
            ks = list(total)
            arrays = [pa.array([k[c] for k in ks], batch.schema.field(2 + c).type) for c in range(len(by))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([count[k] for k in ks], pa.int64()), pa.array([total[k].tolist() for k in ks], pa.list_(pa.float64()))], names=[*by, "_n", "_sums"])

    rows = preds.filter("logprobs is not null and answer_idx is not null and not exists(logprobs, x -> x is null)").select(F.col("logprobs").cast("array<double>").alias("_z"), F.col("answer_idx").cast("int").alias("_a"), *by)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[2:])
    parts = rows.mapInArrow(sums, f"{kinds + ', ' if kinds else ''}_n bigint, _sums array<double>")
    each = parts.select(*by, "_n", F.posexplode("_sums").alias("step", "_s"))
    temperature = F.lit(low) * F.pow(F.lit(high / low), F.col("step") / F.lit(steps - 1))
    return each.groupBy(*by, "step").agg((F.sum("_s") / F.sum("_n")).alias("nll")).withColumn("temperature", temperature)


def fit_temperature(preds: DataFrame, *by: str) -> DataFrame:
    """The grid's temperature with the smallest mean loss (to 9 digits), the lowest among equals."""
    best = temperature_nll(preds, *by).groupBy(*by).agg(F.min_by(F.struct("temperature", "nll"), F.struct(F.round("nll", 9), "step")).alias("b"))
    return best.select(*by, F.round("b.temperature", 9).alias("temperature"), F.round("b.nll", 7).alias("nll"))


def crossfit_temperature(preds: DataFrame) -> DataFrame:
    """Temperature to be used for each arm and fold of users: fitted on the other fold."""
    fit = fit_temperature(preds.withColumn("fold", s.fold_of(F.col("user_id"))), "arm", "fold")
    return fit.select("arm", (1 - F.col("fold")).cast("int").alias("fold"), "temperature", "nll")


def records(preds: DataFrame, cats: DataFrame) -> DataFrame:
    """Decision records: p, top, maxp; the question of the largest information gain, its gain in accuracy (never below 0),
    and the pick after a truthful answer. `cats` has decision_id and cats, the options' categories in order.
    """
    r = with_probs(preds).join(cats, "decision_id").withColumn("menu", s.questions(F.col("p"), F.col("cats")))
    r = r.withColumn("q", s.best_question(F.col("menu"), "ig"))
    truth = F.coalesce(F.get("cats", "answer_idx") == F.col("q.cat"), F.lit(False))
    side = F.transform("cats", lambda c: F.coalesce(c == F.col("q.cat"), F.lit(False)) == truth)
    after = F.when(F.col("q").isNotNull(), s.restricted(F.col("p"), side)).otherwise(F.col("p"))
    return r.withColumn("gain", F.greatest(F.lit(0.0), F.coalesce(F.col("q.evpi"), F.lit(0.0)))).withColumn("post", after).withColumn("pick_ask", s.argmax(F.transform("post", lambda x: F.round(x, 12))))


def ask_curve(recs: DataFrame, rates=tuple(k / 10 for k in range(11)), seed: int = 0) -> DataFrame:
    """Accuracy by arm when the share `rate` of the decisions is asked: those of most value, of least confidence, or any.

    Sorted in ranges over all arms; the places within an arm follow from where the arm begins.
    """
    triggers = F.array(
        F.struct(F.lit("value").alias("trigger"), F.round(-F.col("gain"), 9).alias("k")),
        F.struct(F.lit("confidence").alias("trigger"), F.round("maxp", 9).alias("k")),
        F.struct(F.lit("random").alias("trigger"), hash32(seed, "arm", "prediction_id").cast("double").alias("k")),
    )
    plain, asked = ((F.col(c) == F.col("answer_idx")).cast("int") for c in ("top", "pick_ask"))
    each = recs.select("arm", "prediction_id", plain.alias("plain"), asked.alias("asked"), F.inline(triggers))
    ranked = global_rank(each, ["arm", "trigger", "k", "prediction_id"])
    first = ranked.groupBy("arm", "trigger").agg(F.min("rank").alias("first"), n_rows().alias("n"))
    at = F.col("rank") - F.col("first")
    x = ranked.join(F.broadcast(first), ["arm", "trigger"])  # three rows an arm
    sums = x.groupBy("arm", "trigger").agg(*(F.avg(F.when(at < F.bround(F.lit(r) * F.col("n")), F.col("asked")).otherwise(F.col("plain")).cast("double")).alias(f"a{k}") for k, r in enumerate(rates)))
    rows = F.array(*(F.struct(F.lit(float(r)).alias("rate"), F.round(f"a{k}", 9).alias("accuracy")) for k, r in enumerate(rates)))
    return sums.select("arm", "trigger", F.inline(rows)).select("arm", "rate", "accuracy", "trigger")


def middle_values(rows: DataFrame, value: str, by: str, at: dict[str, float]) -> DataFrame:
    """`by` and, for each name in `at`, the quantile interpolated linearly, from ranks in sorted ranges: no group is one
    task's work. Nulls take no part; `by` has few values.
    """
    ranked = global_rank(rows.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v")), [by, "_v"])
    span = ranked.groupBy(by).agg(F.min("rank").alias("_first"), n_rows().alias("_n"))
    x = ranked.join(F.broadcast(span), by).withColumn("_r", F.col("rank") - F.col("_first"))
    aggs = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("_n") - 1)
        aggs += [F.max(F.when(F.col("_r") == F.floor(place), F.col("_v"))).alias(f"{name}_a"), F.max(F.when(F.col("_r") == F.ceil(place), F.col("_v"))).alias(f"{name}_b"), F.max(place - F.floor(place)).alias(f"{name}_w")]
    y = x.groupBy(by).agg(*aggs)
    return y.select(by, *((F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_w")).alias(n) for n in at))


def poisson_bootstrap(rows: DataFrame, unit: str, top: Column, below: Column, draws: int = 1000, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Draws of sum(top) / sum(below) with each unit weighted by a Poisson(1) number fixed by seed, draw and unit.

    No resampled table is built or joined: a unit's weights are computed where its row is. A draw in which every weight is
    0 has a null value.
    """
    import math

    u = rows.groupBy(*by, unit).agg(F.sum(top).alias("_a"), F.sum(below).alias("_b"))
    x = u.withColumn("draw", F.explode(F.expr(f"sequence(0, {draws - 1})")))
    v = uniform(seed, "draw", unit)
    w, total = F.lit(0), 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        w = w + (v >= total).cast("int")
    x = x.withColumn("_w", w)
    return x.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("_a")), F.sum(F.col("_w") * F.col("_b"))).alias("value"))


def bootstrap_sums(rows: DataFrame, unit: str, top: Column, below: Column, draws: int = 4000, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """The draws of `poisson_bootstrap` for many units: the weights come from a 64-bit hash of unit and draw.

    Each task adds up one vector of `draws` sums a group, and the vectors are added up: no row is made for a unit and draw.
    """
    units = rows.groupBy(*by, unit).agg(F.sum(top).cast("double").alias("_a"), F.sum(below).cast("double").alias("_b")).select(F.xxhash64(F.lit(seed), F.col(unit).cast("string")).alias("_h"), "_a", "_b", *by)
    cumulative = np.cumsum([np.exp(-1.0) / _factorial(k) for k in range(20)])
    salt = (np.arange(draws, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint64)
            a, b = (np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in (1, 2))
            keys = list(zip(*(c.to_pylist() for c in batch.columns[3:]))) or [()] * batch.num_rows
            for key in set(keys):
                mine = np.flatnonzero([k == key for k in keys])
                both = held.setdefault(key, np.zeros((2, draws)))
                for at in range(0, len(mine), 256):
                    r = mine[at : at + 256]
                    x = h[r][:, None] ^ salt
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                    x ^= x >> np.uint64(31)
                    w = np.searchsorted(cumulative, (x >> np.uint64(11)) / 2.0**53, "right").astype(float)
                    both += np.stack([a[r] @ w, b[r] @ w])
        if held:
            ks = list(held)
            arrays = [pa.array([k[c] for k in ks], batch.schema.field(3 + c).type) for c in range(len(by))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([held[k][c].tolist() for k in ks], pa.list_(pa.float64())) for c in (0, 1))], names=[*by, "_as", "_bs"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in units.dtypes[3:])
    parts = units.mapInArrow(sums, f"{kinds + ', ' if kinds else ''}_as array<double>, _bs array<double>")
    each = parts.select(*by, F.posexplode(F.arrays_zip("_as", "_bs")).alias("draw", "_x"))
    return each.groupBy(*by, "draw").agg(F.try_divide(F.sum("_x._as"), F.sum("_x._bs")).alias("value"))


def _factorial(k: int) -> float:
    return float(np.prod(np.arange(1, k + 1))) if k else 1.0


def intervals(draws: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The 95 % interval of the draws by three conventions: linear between draws (lo, hi), the draw at floor(q n)
    (lo_at, hi_at), and the same with the upper one a place lower (hi_before). A few thousand draws a group.
    """
    v = F.array_sort(F.collect_list("value"))
    at = lambda q, less=0: F.get("_v", F.greatest(F.lit(0), F.least(F.size("_v") - 1, F.floor(F.lit(q) * F.size("_v")).cast("int") - less)))
    x = draws.groupBy(*by).agg(v.alias("_v"), F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"))
    return x.select(*by, "lo", "hi", at(0.025).alias("lo_at"), at(0.975).alias("hi_at"), at(0.975, 1).alias("hi_before"))


def interval(draws: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return draws.groupBy(*by).agg(F.round(F.percentile("value", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("value", F.lit(0.975)), 9).alias("hi"))


def exact_bootstrap(values: list[float]) -> list[float]:
    """All n^n resampled means of a few values, in order."""
    from itertools import product

    n = len(values)
    if n > 7:
        raise ValueError("enumeration is for at most 7 values")
    return sorted(sum(c) / n for c in product(values, repeat=n))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p of a fair coin that fell `wins` and `losses` times; 1 without any.

    The tail is its largest term, by logarithms, times the sum of the terms' ratios to it, each a fraction of the one before.
    """
    few, many = F.least(wins, losses).cast("bigint"), F.greatest(wins, losses).cast("bigint")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        # i-th factor of the binomial coefficient, and the next smaller term's ratio
        term = a["term"] * (few - i + 1) / (many + i)
        return F.struct((a["log"] + F.log((many + i) / i)).alias("log"), term.alias("term"), (a["sum"] + term).alias("sum"))

    steps = F.when(few > 0, F.sequence(F.lit(1).cast("bigint"), few)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step, lambda a: F.exp(a["log"] - (few + many) * F.log(F.lit(2.0))) * a["sum"])
    return F.least(F.lit(1.0), 2 * tail)


def select_arm(table: DataFrame, most_ece: float = 0.06, tie: float = 0.01) -> DataFrame:
    """Of the arms with ece at most `most_ece`, the simplest (smallest order) within `tie` of the best value."""
    ok = table.filter(F.col("ece") <= most_ece)
    best = ok.agg(F.max("value").alias("_best"))
    return ok.crossJoin(F.broadcast(best)).filter(F.col("value") > F.col("_best") - tie).orderBy("simplicity").limit(1).drop("_best")
