"""Multiple-choice questions: matched decoys for held-out decisions.

A decision is (user_id, rn, t, item): the true item and its place in the user's timeline. Decoys are drawn without
replacement with weights, from a stretch of the items' popularity order. The items' weights lie end to end on one line;
a draw is a point on the decision's stretch of it, found by an equi-join on small buckets of the line. Draws that hit
the true item, the user's history or an item already drawn are rejected, so the work is the number of draws and not
decisions times pool. Decisions for which the draws don't give enough get their pool enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from .items import global_rank
from .sampling import race_key, sample_keys, uniform

KEY = ["user_id", "rn"]
DRAWS = 40


def cohort(novel: DataFrame, n_users: int = 300, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """The decisions of n_users users drawn uniformly, after leaving out those in `exclude` (user_id)."""
    users = novel.select("user_id").distinct()
    if exclude is not None:
        users = users.join(exclude.select("user_id").distinct(), "user_id", "left_anti")
    chosen = sample_keys(users, "user_id", n_users, seed)
    return novel.join(chosen, "user_id", "left_semi")


def band_table(bands: DataFrame) -> DataFrame:
    """band, n_items, w_lo, w_hi: each band's stretch of the weight line (weight pop + 1). At most as many rows as bands."""
    return bands.groupBy("band").agg(F.count(F.lit(1)).alias("n_items"), F.min("w_from").alias("w_lo"), F.max(F.col("w_from") + F.col("pop") + 1).alias("w_hi"))


def decoy_width(decided: DataFrame, past: DataFrame, bands: DataFrame, k: int = 5, n_bands: int = 20) -> DataFrame:
    """Add band, and width: the smallest w so that the bands within w of the true item's hold k - 1 possible decoys.

    Null where all bands together don't. Items of the history and the true item are no decoys. Closed form, from the
    bands' sizes and the history's counts per band; no pool is built.
    """
    taken = past.join(bands.select("item", "band"), "item").groupBy("user_id", "band").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "c"))).alias("_taken"))
    sizes = band_table(bands).agg(F.map_from_entries(F.collect_list(F.struct("band", "n_items"))).alias("_sizes"))
    d = decided.join(bands.select("item", "band"), "item").join(taken, "user_id", "left").crossJoin(F.broadcast(sizes))
    is_past = past.select("user_id", "item", F.lit(True).alias("_old"))
    d = d.join(is_past, ["user_id", "item"], "left")
    free = f"""transform(sequence(0, {n_bands - 1}), j -> coalesce(_sizes[j], 0L) - coalesce(_taken[j], 0L) - (case when j = band and _old is null then 1L else 0L end))"""
    d = d.withColumn("_free", F.expr(free))
    reach = f"""transform(sequence(0, {n_bands - 1}), w -> aggregate(slice(_free, greatest(1, band - w + 1), least({n_bands - 1}, band + w) - greatest(0, band - w) + 1), 0L, (a, x) -> a + x) >= {k - 1})"""
    at = F.expr(f"array_position({reach}, true)")
    return d.withColumn("width", F.when(at > 0, (at - 1).cast("int"))).drop("_free", "_taken", "_sizes", "_old")


def stretch_of_bands(decided: DataFrame, bands: DataFrame, n_bands: int = 20) -> DataFrame:
    """Add lo and hi, the stretch of the weight line that the bands within `width` of `band` cover."""
    t = band_table(bands)
    low, high = t.select(F.col("band").alias("_a"), F.col("w_lo").alias("lo")), t.select(F.col("band").alias("_z"), F.col("w_hi").alias("hi"))
    d = decided.withColumn("_a", F.greatest(F.lit(0), F.col("band") - F.col("width"))).withColumn("_z", F.least(F.lit(n_bands - 1), F.col("band") + F.col("width")))
    return d.join(F.broadcast(low), "_a").join(F.broadcast(high), "_z").drop("_a", "_z")


def draw_decoys(decided: DataFrame, line: DataFrame, past: DataFrame | None, n: int = 4, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """KEY columns, item (decoy), nth (0-based): up to n different decoys a decision, in the order drawn.

    `decided` has KEY, item (true), and lo, hi or else `spans`, an array of stretches (lo, hi); `line` has item, w_from and
    w (whole numbers, end to end from 0). Where the line also has label, the decoys have different labels, none of them
    the decision's `own`.
    """
    width = bucket_width(line)
    many, labels = "spans" in decided.columns, ["label"] if "label" in line.columns else []
    ends = ["spans"] if many else ["lo", "hi"]
    d = stored(decided.select(*KEY, F.col("item").alias("_true"), *ends, *(["own"] if labels else [])).filter("size(spans) > 0" if many else "hi > lo"))
    cells = line.select("item", "w_from", "w", *labels, F.explode(F.expr(f"sequence(w_from div {width}, (w_from + w - 1) div {width})")).alias("_b"))
    length = F.expr("aggregate(spans, 0L, (a, s) -> a + s.hi - s.lo)") if many else F.col("hi") - F.col("lo")
    # the offset is walked off along the stretches
    place = F.expr("aggregate(spans, struct(_off as o, -1L as p), (a, s) -> case when a.p >= 0 then a when a.o < s.hi - s.lo then struct(a.o as o, s.lo + a.o as p) else struct(a.o - (s.hi - s.lo) as o, -1L as p) end).p") if many else F.col("lo") + F.col("_off")

    def tried(d: DataFrame, upto: int) -> DataFrame:
        points = d.withColumn("j", F.explode(F.expr(f"sequence(0, {upto - 1})"))).withColumn("_off", F.floor(uniform(seed, *KEY, "j") * length)).withColumn("pos", place).drop(*ends, "_off")
        points = points.withColumn("_b", F.expr(f"pos div {width}"))
        hits = points.join(cells, "_b").filter("pos >= w_from and pos < w_from + w and item <> _true").filter("label <> own" if labels else "true").select(*KEY, "item", "j", *labels)
        if past is not None:
            hits = hits.join(past.select("user_id", "item"), ["user_id", "item"], "left_anti")
        if labels:
            hits = hits.groupBy(*KEY, "label").agg(F.min(F.struct("j", "item")).alias("b")).select(*KEY, "b.item", "b.j")
        else:
            hits = hits.groupBy(*KEY, "item").agg(F.min("j").alias("j"))
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("j")) - 1  # at most `draws` rows a decision
        return stored(hits.withColumn("nth", nth).filter(F.col("nth") < n).select(*KEY, "item", "nth"))

    def settled(good: DataFrame) -> DataFrame:
        return good.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= n)

    # most decisions are settled by the first few draws; the others repeat these and go on
    first = min(2 * n, draws)
    good = tried(d, first)
    full = settled(good)
    out, short = good.join(full, KEY, "left_semi"), d.join(full, KEY, "left_anti")
    if draws > first:
        good = tried(short, draws)
        full = settled(good)
        out, short = out.unionByName(good.join(full, KEY, "left_semi")), short.join(full, KEY, "left_anti")
    if many:
        short = short.withColumn("s", F.explode("spans")).select(*KEY, "_true", *(["own"] if labels else []), "s.lo", "s.hi")
    pool = pool_of_stretch(short, line, past, width)
    return out.unionByName((race_by_label if labels else race)(pool, n, seed, F.col("w")))


def bucket_width(line: DataFrame, items: int = 16) -> int:
    """Width of a bucket of a weight line that holds about so many items."""
    size = line.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    return max(1, -(-(size.w or 1) * items // max(1, size.n)))


def pool_of_spans(decided: DataFrame, line: DataFrame, past: DataFrame | None) -> DataFrame:
    """KEY, item, w and, where the line has it, label: every possible decoy of decisions with `spans` (and own), for draws
    that need the whole pool. A row a decision and decoy, joined on small buckets of the line.
    """
    labels = ["own"] if "label" in line.columns else []
    one = decided.withColumn("s", F.explode("spans")).select(*KEY, F.col("item").alias("_true"), *labels, "s.lo", "s.hi")
    return pool_of_stretch(one, line, past, bucket_width(line, 256))


def pool_of_stretch(decided: DataFrame, line: DataFrame, past: DataFrame | None, width: int) -> DataFrame:
    """Every possible decoy of the (few) decisions given: KEY, item, w and, where the line has it, label. An equi-join on
    the buckets of the line, each item in the one where it begins.
    """
    labels = ["label"] if "label" in line.columns else []
    spread = decided.withColumn("_b", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    span = line.select("item", "w_from", "w", *labels, F.expr(f"w_from div {width}").alias("_b"))
    pool = spread.join(span, "_b").filter("w_from >= lo and w_from < hi and item <> _true").filter("label <> own" if labels else "true").select(*KEY, "item", "w", *labels)
    return pool.join(past.select("user_id", "item"), ["user_id", "item"], "left_anti").select(*KEY, "item", "w", *labels) if past is not None else pool


def weight_line(side: DataFrame, order: list[str]) -> DataFrame:
    """`side` (item, pop, ...) with w = pop + 1 and w_from: the weights end to end in the given order."""
    return stored(global_rank(side.withColumn("w", F.col("pop") + 1), [*order, "item"], add_up="w").withColumnRenamed("before", "w_from").drop("rank", "rows", "total"))


def _cells(line: DataFrame, cell: Column) -> DataFrame:
    """One row with _cells, a map of cell to (lo, hi, n_items) of its stretch. Cells are few: bands times bins or classes."""
    t = line.groupBy(cell.alias("_k")).agg(F.min("w_from").alias("lo"), F.max(F.col("w_from") + F.col("w")).alias("hi"), F.count(F.lit(1)).alias("n"))
    return t.agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("lo", "hi", "n")))).alias("_cells"))


def generic_spans(decided: DataFrame, past: DataFrame, line: DataFrame, least: int = 4, n_bands: int = 20, n_bins: int = 5) -> DataFrame:
    """Add g_width and spans of the pools of `generic_pool`, without building them.

    `decided` has band and width; `line` is a weight line in the order (g, band) with these columns. The counts of free
    items come from the sizes of the cells (g, band) and the history's counts in them.
    """
    cell = F.col("g") * n_bands + F.col("band")
    taken = past.select("user_id", "item").join(line.select("item", cell.alias("_k")), "item").groupBy("user_id", "_k").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "c"))).alias("_taken"))
    d = decided.join(line.select("item", F.col("g").alias("_g")), "item").join(taken, "user_id", "left").crossJoin(F.broadcast(_cells(line, cell)))
    d = d.join(past.select("user_id", "item", F.lit(True).alias("_old")), ["user_id", "item"], "left")
    near = f"sequence(greatest(0, band - width), least({n_bands - 1}, band + width))"
    free = f"""transform(sequence(0, {n_bins - 1}), g -> aggregate({near}, 0L, (a, j) -> a + coalesce(_cells[g * {n_bands} + j].n, 0L) - coalesce(_taken[g * {n_bands} + j], 0L)) - (case when g = _g and _old is null then 1L else 0L end))"""
    d = d.withColumn("_free", F.expr(free))
    reach = f"transform(sequence(0, {n_bins - 2}), p -> aggregate(slice(_free, greatest(1, _g - p + 1), least({n_bins - 1}, _g + p) - greatest(0, _g - p) + 1), 0L, (a, x) -> a + x) >= {least})"
    at = F.expr(f"array_position({reach}, true)").cast("int")
    d = d.withColumn("g_width", F.when(at > 0, at - 1).otherwise(F.lit(n_bins - 1)))
    own = f"transform(sequence(greatest(0, _g - g_width), least({n_bins - 1}, _g + g_width)), g -> transform({near}, j -> _cells[g * {n_bands} + j]))"
    spans = f"filter(transform({own}, x -> struct(array_min(transform(x, y -> y.lo)) as lo, array_max(transform(x, y -> y.hi)) as hi)), s -> s.lo is not null)"
    return d.withColumn("spans", F.expr(spans)).drop("_taken", "_cells", "_free", "_old", "_g")


def period_line(bands: DataFrame, profile: DataFrame, labels: DataFrame) -> DataFrame:
    """The weight line of (class, band), an item being in one class for each period in which it is active.

    The class is the item's profile before the cut and the period: those that a decision may draw from are one class.
    """
    side = bands.select("item", "pop", "band").join(profile, "item").join(labels, "item")
    acts = F.filter(F.array(F.when(F.col("act0"), 0), F.when(F.col("act1"), 1)), lambda x: x.isNotNull())
    return weight_line(side.withColumn("_per", F.explode(acts)).select("item", "pop", "band", "label", _class(F.col("_per")).alias("cls")), ["cls", "band"])


def _class(per: Column) -> Column:
    return F.col("pre0").cast("int") * 4 + F.col("pre1").cast("int") * 2 + per


def period_spans(decided: DataFrame, past: DataFrame, bands: DataFrame, profile: DataFrame, labels: DataFrame, line: DataFrame, k: int = 5, n_bands: int = 20) -> DataFrame:
    """`decided` (KEY, item, per) with own (label), p_width, n_labels (within it) and spans of the pools of `period_pool`.

    p_width is null where all bands together have too few labels. Closed form: labels by their least distance in bands,
    corrected for the labels of which the user's history has some items, by the distance of what is left of them.
    """
    by_label = stored(line.groupBy("cls", "label", "band").agg(F.count(F.lit(1)).alias("n")))
    every = by_label.groupBy("cls", "label").agg(F.collect_list("band").alias("_all"))
    near = lambda bands, b: F.array_min(F.transform(bands, lambda x: F.abs(x - b)))
    b0 = F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("_b")
    sizes = every.select("cls", "_all", b0).groupBy("cls", "_b", near("_all", F.col("_b")).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("cls", "_b").agg(F.map_from_entries(F.collect_list(F.struct("m", "c"))).alias("_n"))
    mine = bands.select("item", F.col("band").alias("_b")).join(profile, "item").join(labels, "item")
    d = decided.select(*KEY, "item", "per").join(mine, "item").select(*KEY, "item", "_b", F.col("label").alias("own"), _class(F.col("per")).cast("int").alias("cls"))
    d = stored(d)
    taken = past.select("user_id", "item").join(line.select("item", "cls", "label", "band"), "item").groupBy("user_id", "cls", "label", "band").agg(F.count(F.lit(1)).alias("c"))
    met = taken.select("user_id", "cls", "label").distinct().join(by_label, ["cls", "label"]).join(taken, ["user_id", "cls", "label", "band"], "left")
    met = stored(met.groupBy("user_id", "cls", "label").agg(F.collect_list("band").alias("_all"), F.collect_list(F.when(F.col("n") > F.coalesce("c", F.lit(0)), F.col("band"))).alias("_left")))
    change = F.explode(F.array(F.struct(near("_all", F.col("_b")).alias("m"), F.lit(-1).alias("v")), F.struct(near("_left", F.col("_b")).alias("m"), F.lit(1).alias("v"))))
    less = d.select("user_id", "cls", "_b").distinct().join(met, ["user_id", "cls"]).select("user_id", "cls", "_b", change.alias("x")).filter("x.m is not null").groupBy("user_id", "cls", "_b", "x.m").agg(F.sum("x.v").alias("v"))
    less = less.groupBy("user_id", "cls", "_b").agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("_d"))
    x = d.join(sizes, ["cls", "_b"]).join(less, ["user_id", "cls", "_b"], "left")
    x = x.join(every.withColumnRenamed("label", "own"), ["cls", "own"], "left").join(met.select("user_id", "cls", F.col("label").alias("own"), "_left", F.lit(True).alias("_met")), ["user_id", "cls", "own"], "left")
    x = x.withColumn("_m", near(F.when(F.col("_met"), F.col("_left")).otherwise(F.col("_all")), F.col("_b")))
    free = f"transform(sequence(0, {n_bands - 1}), w -> aggregate(sequence(0, w), 0L, (a, m) -> a + coalesce(_n[m], 0L) + coalesce(_d[m], 0L)) - (case when _m <= w then 1L else 0L end))"
    x = x.withColumn("_free", F.expr(free))
    at = F.expr(f"array_position(transform(_free, n -> n >= {k - 1}), true)").cast("int")
    x = x.withColumn("p_width", F.when(at > 0, at - 1)).withColumn("n_labels", F.expr("case when p_width is not null then _free[p_width] end"))
    x = x.crossJoin(F.broadcast(_cells(line, F.col("cls") * n_bands + F.col("band"))))
    own = f"transform(sequence(greatest(0, _b - p_width), least({n_bands - 1}, _b + p_width)), j -> _cells[cls * {n_bands} + j])"
    spans = F.expr(f"case when p_width is not null then array(struct(array_min(transform({own}, y -> y.lo)) as lo, array_max(transform({own}, y -> y.hi)) as hi)) end")
    return x.withColumn("spans", spans).select(*KEY, "item", "own", "p_width", "n_labels", "spans")


def race(pool: DataFrame, n: int, seed: int, weight: Column) -> DataFrame:
    """Weighted draw of n from each decision's pool: the n smallest exponential clocks."""
    r = pool.withColumn("_key", race_key(seed, weight, *KEY, "item"))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("_key", "item")) - 1
    return r.withColumn("nth", nth).filter(F.col("nth") < n).select(*KEY, "item", "nth")


def shuffled(decided: DataFrame, decoys: DataFrame, n: int = 4, seed: int = 0) -> DataFrame:
    """KEY, idx (0-based place in a seeded order), item, is_true: the options of the decisions that have all n decoys."""
    decoys = stored(decoys)
    full = decoys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == n).drop("_c")
    both = decided.select(*KEY, "item", F.lit(True).alias("is_true")).unionByName(decoys.select(*KEY, "item", F.lit(False).alias("is_true"))).join(full, KEY, "left_semi")
    mix = F.md5(F.concat_ws("|", F.lit(str(seed)), *KEY, F.lit("shuffle"), "item"))
    return both.withColumn("idx", F.row_number().over(Window.partitionBy(*KEY).orderBy(mix, "item")) - 1).select(*KEY, "idx", "item", "is_true")


def generic_pool(decided: DataFrame, past: DataFrame, bands: DataFrame, bins: DataFrame, least: int = 4) -> DataFrame:
    """KEY, item, pop, g_width: decoys of the popularity stretch whose genericness bin is within g_width of the true item's,
    g_width being the smallest that leaves `least`; the whole stretch where none does. For a cohort of bounded size.
    """
    spread = decided.withColumn("_j", F.explode(F.expr("sequence(greatest(0, band - width), least(19, band + width))")))
    pool = spread.select(*KEY, F.col("item").alias("_true"), "_j").join(bands.select("item", "pop", F.col("band").alias("_j")), "_j").filter("item <> _true")
    pool = pool.join(past.select("user_id", "item"), ["user_id", "item"], "left_anti")
    pool = pool.join(bins.select("item", "g"), "item").join(bins.select(F.col("item").alias("_true"), F.col("g").alias("_g")), "_true").withColumn("apart", F.abs(F.col("g") - F.col("_g")))
    at = pool.groupBy(*KEY).agg(*(F.count_if(F.col("apart") <= p).alias(f"n{p}") for p in range(5)))
    width = F.coalesce(*(F.when(F.col(f"n{p}") >= least, F.lit(p)) for p in range(4)), F.lit(4))
    return pool.join(at.select(*KEY, width.alias("g_width")), KEY).filter("apart <= g_width").select(*KEY, "item", "pop", "g_width")


def period_pool(decided: DataFrame, past: DataFrame, bands: DataFrame, profile: DataFrame, labels: DataFrame, k: int = 5, n_bands: int = 20) -> DataFrame:
    """KEY, item, pop, label, p_width: decoys with the true item's period profile that were active in the decision's period.

    p_width is the smallest distance in bands that leaves k - 1 different labels other than the true item's; decisions
    without one have no rows. `decided` has KEY, item, per (0 or 1); `labels` has item, label. For a cohort.
    The stretch widens in rounds, and only decisions that are still short take part in the next.
    """
    side = bands.select("item", "pop", "band").join(profile, "item").join(labels, "item")
    mine = side.select("item", F.col("band").alias("_b"), F.col("label").alias("_l"), F.struct("pre0", "pre1").alias("_p"))
    d = decided.select(*KEY, "item", "per").join(mine, "item").withColumnRenamed("item", "_true")
    w = Window.partitionBy(*KEY).orderBy("m")
    out, reach = None, 1
    while True:
        near = d.withColumn("band", F.explode(F.expr(f"sequence(greatest(0, _b - {reach}), least({n_bands - 1}, _b + {reach}))")))
        pool = near.join(side, "band").filter("pre0 = _p.pre0 and pre1 = _p.pre1 and item <> _true and case when per = 0 then act0 else act1 end and label <> _l")
        pool = pool.join(past.select("user_id", "item"), ["user_id", "item"], "left_anti").withColumn("apart", F.abs(F.col("band") - F.col("_b")))
        width = pool.groupBy(*KEY, "label").agg(F.min("apart").alias("m")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k - 1).select(*KEY, F.col("m").alias("p_width"))
        got = pool.join(width, KEY).filter("apart <= p_width").select(*KEY, "item", "pop", "label", "p_width")
        out = got if out is None else out.unionByName(got)
        if reach >= n_bands - 1:
            return out
        d = d.join(width, KEY, "left_anti")
        reach = n_bands - 1


def race_by_label(pool: DataFrame, n: int, seed: int, weight: Column) -> DataFrame:
    """Weighted draw of n items with different labels: per label the smallest clock, then the n smallest labels."""
    r = pool.withColumn("_key", race_key(seed, weight, *KEY, "item"))
    best = r.groupBy(*KEY, "label").agg(F.min(F.struct("_key", "item")).alias("b")).select(*KEY, F.col("b.item").alias("item"), F.col("b._key").alias("_key"))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("_key", "item")) - 1
    return best.withColumn("nth", nth).filter(F.col("nth") < n).select(*KEY, "item", "nth")


def answer_positions(options: DataFrame, k: int = 5) -> DataFrame:
    """idx, n, share, z of the true option's place, and z's largest size is a check of the shuffle."""
    c = options.filter("is_true").groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_all"))
    z = (F.col("n") - F.col("_all") / k) / F.sqrt(F.col("_all") * (1 / k) * (1 - 1 / k))
    return c.crossJoin(F.broadcast(total)).select("idx", "n", F.round(F.col("n") / F.col("_all"), 9).alias("share"), F.round(z, 9).alias("z"))
