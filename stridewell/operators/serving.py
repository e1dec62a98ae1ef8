"""What an application shows of a prediction: ranked options, match rates of similar picks, wording, and the choice a
person makes among them; and reports that hold an evaluation against its limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words for small counts and the sentences about how often a question is asked.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NEVER_ASKS, ALWAYS_ASKS = "Picks without asking", "Asks before every pick"
SELDOM_ASKS, MOSTLY_ASKS = "Asks less than once in 10 times", "Asks almost every time"
#: Predictions that a bin needs before its match rate is told.
LEAST_IN_BIN = 30


def ranking(p: Column, out: Column | None = None) -> Column:
    """Places of the options from the likeliest to the least (to 12 digits), the first of equals first; without those of
    probability 0 and those in the array `out`.
    """
    placed = F.transform(p, lambda x, i: F.struct((-F.round(x, 12)).alias("neg"), i.cast("int").alias("idx")))
    left = F.filter(placed, lambda x: x["neg"] < 0)
    if out is not None:
        left = F.filter(left, lambda x: ~F.coalesce(F.array_contains(out, x["idx"]), F.lit(False)))
    return F.transform(F.array_sort(left), lambda x: x["idx"])


def equal_bins(preds: DataFrame, n_bins: int = 10, by: str = "arm") -> DataFrame:
    """`by`, bin, lo, n, mean_conf, accuracy over equal bins of the largest probability `c`; the last bin is closed.
    At most n_bins rows a value of `by`.
    """
    b = preds.withColumn("bin", bin_number(F.col("c"), n_bins))
    return b.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_conf"), F.avg((F.col("top") == F.col("answer_idx")).cast("double")).alias("accuracy")).withColumn("lo", F.col("bin") / F.lit(n_bins))


def bin_number(c: Column, n_bins: int = 10) -> Column:
    return F.least(F.lit(n_bins - 1), F.floor(F.round(c * n_bins, 9)).cast("int"))


def with_match_rate(preds: DataFrame, bins: DataFrame, n_bins: int = 10, least: int = LEAST_IN_BIN, by: str = "arm") -> DataFrame:
    """Add n_similar and match_rate, the accuracy of the bin that `c` falls into; null where it has fewer than `least`."""
    side = bins.select(by, "bin", F.col("n").alias("n_similar"), F.col("accuracy").alias("_a"))
    x = preds.withColumn("bin", bin_number(F.col("c"), n_bins)).join(F.broadcast(side), [by, "bin"], "left")  # ten rows a value of `by`
    return x.withColumn("match_rate", F.when(F.col("n_similar") >= least, F.col("_a"))).drop("_a", "bin")


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("int")


def number_word(n: Column) -> Column:
    words = F.array(*map(F.lit, NUMBER_WORDS))
    return F.when((n >= 0) & (n <= 10), F.get(words, n.cast("int"))).otherwise(n.cast("string"))


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def counted(n: Column, one: str, many: str) -> Column:
    """'1 place', '3 places', with thousands apart."""
    return F.concat_ws(" ", F.format_number(n, 0), F.when(n == 1, one).otherwise(many))


def ask_rate_text(rate: Column) -> Column:
    n = half_up(rate * 10)
    some = F.when(n <= 0, SELDOM_ASKS).when(n >= 10, MOSTLY_ASKS).otherwise(F.concat(F.lit("Asks about "), n.cast("string"), F.lit(" in 10 times")))
    return F.when(F.coalesce(rate > 0, F.lit(False)), F.when(rate >= 1, ALWAYS_ASKS).otherwise(some)).otherwise(NEVER_ASKS)


def choice_after(events: Column, n_options: Column) -> Column:
    """(current, n_rejected, accepted, by_user) after a person's steps on ranked options, from 0 as the pick.

    `events` is an array of (kind, position) in order: 'reject' puts the current option out and takes the first one still
    in play; 'select' makes an option in play current; 'accept' ends it. What is impossible changes nothing; current is
    null when all are out.
    """
    start = F.struct(F.when(n_options > 0, F.lit(0)).alias("current"), F.array().cast("array<int>").alias("out"), F.lit(False).alias("accepted"), F.lit(False).alias("by_user"))
    every = F.when(n_options > 0, F.sequence(F.lit(0), (n_options - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, e: Column) -> Column:
        active = ~s["accepted"]
        rejects = active & (e["kind"] == "reject") & s["current"].isNotNull()
        gone = F.array_append(s["out"], s["current"])
        selects = active & (e["kind"] == "select") & F.coalesce((e["position"] >= 0) & (e["position"] < n_options) & ~F.array_contains(s["out"], e["position"]), F.lit(False))
        accepts = active & (e["kind"] == "accept") & s["current"].isNotNull()
        current = F.when(rejects, F.get(F.array_except(every, gone), F.lit(0))).when(selects, e["position"]).otherwise(s["current"])
        by_user = F.when(rejects, F.lit(False)).when(selects, e["position"] != 0).otherwise(s["by_user"])
        return F.struct(current.cast("int").alias("current"), F.when(rejects, gone).otherwise(s["out"]).alias("out"), (s["accepted"] | accepts).alias("accepted"), by_user.alias("by_user"))

    return F.aggregate(events, start, step, lambda s: F.struct(s["current"].alias("current"), F.size(s["out"]).alias("n_rejected"), s["accepted"].alias("accepted"), s["by_user"].alias("by_user")))


def verdict(lo: Column, hi: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(lo > 0, "better").when(hi < 0, "worse").when(lo.isNotNull() & hi.isNotNull(), "no difference shown")


def is_significant(lo: Column, hi: Column, n_units: Column, least: int = 3) -> Column:
    """Whether both ends lie on one side of 0 and apart; null with fewer than `least` units."""
    return F.when(n_units >= least, ((lo > 0) == (hi > 0)) & (lo != hi))


def against_limits(report: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """constraint, value, target, state of the one row of `report`: 'met' or 'not met' by (op, bound), where op is 'at most'
    or 'at least'.
    """
    rows = [
        F.struct(
            F.lit(name).alias("constraint"), F.col(name).cast("double").alias("value"), F.lit(f"{op} {bound:g}").alias("target"),
            F.when((F.col(name) <= bound) if op == "at most" else (F.col(name) >= bound), "met").otherwise("not met").alias("state"),
        )
        for name, (op, bound) in limits.items()
    ]
    return report.select(F.inline(F.array(*rows)))


def gaps_between(scrapes: DataFrame, most_s: int, by: list[str], t: str = "t") -> DataFrame:
    """`by`, t, silent_s where a series' next scrape comes more than `most_s` seconds after the one at t."""
    nxt = F.lead(t).over(Window.partitionBy(*by).orderBy(t))
    return scrapes.withColumn("silent_s", nxt - F.col(t)).filter(F.col("silent_s") > most_s).select(*by, t, "silent_s")
