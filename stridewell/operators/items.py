"""Item tables: metadata, places, popularity bands, genericness bins, period profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored


def metadata(events: DataFrame) -> DataFrame:
    """item, cat, name of the last event (by seq) that has either."""
    return events.filter("cat is not null or name is not null").groupBy("item").agg(F.max_by(F.struct("cat", "name"), "seq").alias("m")).select("item", "m.cat", "m.name")


def coordinates(events: DataFrame) -> DataFrame:
    """item, lat, lon of the first event (by seq) that has both."""
    return events.filter("lat is not null and lon is not null").groupBy("item").agg(F.min_by("lat", "seq").alias("lat"), F.min_by("lon", "seq").alias("lon"))


def global_rank(df: DataFrame, order: list[str], rank: str = "rank", add_up: str | None = None) -> DataFrame:
    """Add `rank` (0, 1, ...) in the total order `order`, and `rows`; with `add_up`, also the sum of that column before
    the row (`before`) and over all (`total`). Sorted in ranges: no task sees more than its range.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    rows = ranged.withColumn("_p", F.shiftrightunsigned(place, 33)).withColumn("_i", place.bitwiseAND(F.lit((1 << 33) - 1)))
    parts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *([F.sum(add_up).alias("_s")] if add_up else []))
    line = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    every = Window.partitionBy()
    cols = [F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_at"), F.sum("_n").over(every).alias("rows")]
    if add_up:
        cols += [F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_sum"), F.sum("_s").over(every).alias("total")]
    out = rows.join(F.broadcast(parts.select("_p", *cols)), "_p").withColumn(rank, F.col("_i") + F.col("_at"))
    if add_up:
        inner = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(add_up).over(inner), F.lit(0)) + F.col("_sum")).drop("_sum")
    return out.drop("_p", "_i", "_at")


def most_frequent(events: DataFrame, n: int | None = 2000) -> DataFrame:
    """item, n, rank of the n items with the most events, ties by id; all of them without n."""
    counts = events.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("neg", -F.col("n"))
    return global_rank(counts.orderBy("neg", "item").limit(n) if n else counts, ["neg", "item"])


def bands(pop: DataFrame, universe: DataFrame, n_bands: int = 20) -> DataFrame:
    """item, pop, band of every item of `universe`: equal-count bands of the order (pop, item), leftovers in the lower ones."""
    all_items = universe.select("item").distinct().join(pop, "item", "left").select("item", F.coalesce("pop", F.lit(0)).alias("pop"))
    ranked = global_rank(all_items, ["pop", "item"], add_up="pop")
    return ranked.select("item", "pop", F.least(F.lit(n_bands - 1), F.floor(F.col("rank") * n_bands / F.col("rows"))).cast("int").alias("band"), "rank", (F.col("before") + F.col("rank")).alias("w_from"))


def bin_edges(scores: DataFrame, n: int = 5) -> list[float]:
    """The n - 1 inner edges of n equal-count bins, interpolated linearly, from ranks in sorted ranges."""
    ranked = global_rank(scores.filter("score is not null").select(F.col("score").cast("double").alias("score")), ["score"])
    place = lambda k: F.lit(k / n) * (F.col("rows") - 1)
    at = [F.max(F.when(F.col("rank") == side(place(k)), F.col("score"))) for k in range(1, n) for side in (F.floor, F.ceil)]
    got = ranked.agg(F.max("rows"), *at).first()
    if not got[0]:
        return []
    out = []
    for k in range(1, n):
        low, high = got[2 * k - 1], got[2 * k]
        share = k / n * (got[0] - 1)
        out.append(low + (high - low) * (share - int(share)))
    return out


def bin_of(score: Column, edges: list[float]) -> Column:
    """Number of edges at or below the score: a score on an edge goes up."""
    out = F.lit(0)
    for e in edges:
        out = out + (score >= F.lit(e)).cast("int")
    return out


def period(t: Column, year: int = 2017) -> Column:
    """1 from the start of `year` on, else 0."""
    import calendar

    return (t >= calendar.timegm((year, 1, 1, 0, 0, 0))).cast("int")


def period_profile(events: DataFrame, parts: DataFrame, year: int = 2017) -> DataFrame:
    """item, pre0, pre1 (any event before the cut in the period), act0, act1 (any event of anybody in it)."""
    p = period(F.col("t"), year)
    act = events.groupBy("item").agg(F.max(p == 0).alias("act0"), F.max(p == 1).alias("act1"))
    pre = parts.filter("not held").groupBy("item").agg(F.max(p == 0).alias("pre0"), F.max(p == 1).alias("pre1"))
    return act.join(pre, "item", "left").select("item", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("pre0", "pre1", "act0", "act1")))


def label(cat: Column, name: Column) -> Column:
    """'name (cat)', the category alone, or 'Unknown'."""
    c = F.coalesce(cat, F.lit("Unknown"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" ("), c, F.lit(")"))).otherwise(c)
