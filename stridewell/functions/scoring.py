"""Column functions on arrays of log-probabilities and probabilities. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(lp: Column, temperature: float | Column = 1.0) -> Column:
    """Probabilities of an array of log-probabilities, shifted by the largest so that nothing overflows."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    e = F.transform(lp, lambda x: F.exp((x - F.array_max(lp)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def log_softmax(lp: Column) -> Column:
    m = F.array_max(lp)
    total = F.log(F.aggregate(lp, F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    return F.transform(lp, lambda x: x - m - total)


def entropy(p: Column) -> Column:
    """In nats; 0 ln 0 is 0."""
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.log(x))


def argmax(a: Column) -> Column:
    """0-based place of the largest element, the first of equals; null for an empty array."""
    at = F.array_position(a, F.array_max(a))
    return F.when(at > 0, (at - 1).cast("int"))


def argmin_null_last(a: Column) -> Column:
    """0-based place of the smallest element; nulls count as infinite, the first of equals wins."""
    b = F.transform(a, lambda x: F.coalesce(x, F.lit(float("inf"))))
    at = F.array_position(b, F.array_min(b))
    return F.when(at > 0, (at - 1).cast("int"))


def rank_of(scores: Column, idx: Column) -> Column:
    """1 + the number of strictly larger scores than that at `idx` (0-based)."""
    mine = F.get(scores, idx)
    return 1 + F.size(F.filter(scores, lambda x: x > mine))


def restricted(p: Column, inside: Column) -> Column:
    """p renormalised over the places where the boolean array `inside` is true; p itself where that has no mass."""
    cut = F.zip_with(p, inside, lambda x, i: F.when(i, x).otherwise(F.lit(0.0)))
    mass = F.aggregate(cut, F.lit(0.0), lambda a, x: a + x)
    return F.when(mass > 0, F.transform(cut, lambda x: x / mass)).otherwise(p)


def questions(p: Column, cats: Column) -> Column:
    """For each category of the options (one per place in `cats`): cat, py, ig, evpi of asking whether it is the one.

    Categories that no option or every option has are no question. ig is the entropy of the answer; evpi is the gain in
    the largest probability, expected over the answer.
    """
    n = F.size(p)

    def ask(c):
        hit = F.transform(cats, lambda x: F.coalesce(x == c, F.lit(False)))
        yes = F.zip_with(p, hit, lambda x, h: F.when(h, x).otherwise(F.lit(0.0)))
        no = F.zip_with(p, hit, lambda x, h: F.when(h, F.lit(0.0)).otherwise(x))
        py = F.aggregate(yes, F.lit(0.0), lambda a, x: a + x)
        ig = -(py * F.log(py) + (1 - py) * F.log(1 - py))
        return F.struct(c.alias("cat"), py.alias("py"), ig.alias("ig"), (F.array_max(yes) + F.array_max(no) - F.array_max(p)).alias("evpi"), F.size(F.filter(hit, lambda h: h)).alias("n_yes"))

    menu = F.array_sort(F.array_distinct(F.filter(cats, lambda c: c.isNotNull())))
    return F.filter(F.transform(menu, ask), lambda q: (q["py"] > 0) & (q["py"] < 1) & (q["n_yes"] < n))


def best_question(menu: Column, by: str) -> Column:
    """The question with the largest `by` (to 12 digits), the first category in order among equals; null where none."""
    ranked = F.transform(menu, lambda q: F.struct((-F.round(q[by], 12)).alias("s"), q["cat"].alias("cat"), q["py"].alias("py"), q["ig"].alias("ig"), q["evpi"].alias("evpi")))
    return F.array_min(ranked)


def fold_of(user: Column) -> Column:
    """0 or 1: the parity of the SHA-256 of the id."""
    return (F.conv(F.right(F.sha2(user.cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def quantile(values: Column, q: float, empty: float | None = 0.0) -> Column:
    """Quantile of an array, interpolated linearly between its sorted values; q is kept within 0 and 1. `empty` for an
    empty array; nulls take no part.
    """
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = F.lit(min(1.0, max(0.0, q))) * (F.size(v) - 1)
    low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
    return F.when(F.size(v) > 0, low + (high - low) * (at - F.floor(at))).otherwise(F.lit(empty).cast("double"))


def should_ask(ask_all: Column, tau: Column, gain: Column) -> Column:
    return ask_all | F.coalesce(gain >= tau, F.lit(False))


def confidence_label(p: Column) -> Column:
    return F.when(p >= 0.6, "high").when(p >= 0.4, "medium").otherwise("low")
