"""Question sets built from the check-ins under the five decoy conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..operators import items, questions, sampling, timeline
from ..operators.build import Builder, training_instances
from ..sources.events import events
from .sql import BANDS, LINES, Y2017, hash32, uniform

QUERIES, SQL = {}, {}
N_USERS, SEED, K = 300, 0, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Base:
    """The shared inputs of the conditions for the novel decisions of a cohort: timeline parts, history, bands. Each is
    computed when a query first needs it.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.events = events(spark, d)
        self._b = Builder(self.events, k=K, seed=SEED, n_users=N_USERS, kind="novel")

    parts = property(lambda self: self._b.parts)
    past = property(lambda self: timeline.seen_before(self.parts))
    novel = property(lambda self: timeline.held_out(self.parts).filter("is_novel").select("user_id", "rn", "t", "item"))
    bands = property(lambda self: self._b.bands)
    cohort = property(lambda self: self._b.decisions)
    cohort_past = property(lambda self: self._b.past)

    def wide(self) -> DataFrame:
        return self._b.wide

    def popmatched(self) -> DataFrame:
        return self._b.decoys


def _cohort(spark: SparkSession, d: str, condition: str) -> Builder:
    """The novel decisions of a cohort."""
    e = events(spark, d)
    return Builder(e, condition, K, SEED, n_users=N_USERS, kind="novel", scores=_scores(e) if condition == "textmatched" else None)


def _all(spark: SparkSession, d: str, condition: str = "popmatched") -> Builder:
    """Every held-out decision, new places and revisits, of all people with enough events."""
    e = events(spark, d)
    return Builder(e, condition, K, SEED, scores=_scores(e) if condition == "textmatched" else None)


_COHORT = f"""chosen as (select user_id from (select distinct user_id from held where is_novel) order by md5('{SEED}|' || user_id), user_id limit {N_USERS}),
cohort as (select user_id, rn, t, item from held where is_novel and user_id in (select user_id from chosen)),
old as (select * from past where user_id in (select user_id from chosen))"""

_WIDTH = f"""{BANDS}, {_COHORT},
taken as (select o.user_id, b.band, count(*) c from old o join bands b on o.item = b.item group by 1, 2),
sizes as (select band, count(*) n_items, min(w_from) w_lo, max(w_from + pop + 1) w_hi from bands group by 1),
free as (select d.user_id, d.rn, b.band b, s.band j, s.n_items - coalesce(t.c, 0) - cast(s.band = b.band as int) n
  from cohort d join bands b on d.item = b.item cross join sizes s left join taken t on t.user_id = d.user_id and t.band = s.band),
reach as (select user_id, rn, w, sum(n) filter (abs(j - b) <= w) n from free cross join (select unnest(generate_series(0, 19)) w) group by 1, 2, 3),
widths as (select d.user_id, d.rn, d.t, d.item, b.band, (select min(w) from reach r where r.user_id = d.user_id and r.rn = d.rn and r.n >= {K - 1}) width from cohort d join bands b on d.item = b.item)"""


def _draws(decided: str, line: str, past: str | None) -> str:
    """Decoys by rejection of weighted draws from [lo, hi) of a weight line, and by the race where they don't suffice."""
    not_past = lambda x: f"and not exists (select 1 from {past} o where o.user_id = {x}.user_id and o.item = {x}.item)" if past else ""
    return f"""points as (select user_id, rn, item true_item, j, lo + cast(floor({uniform(f"'{SEED}'", 'user_id', 'cast(rn as varchar)', 'cast(j as varchar)')} * (hi - lo)) as bigint) pos
  from {decided} cross join (select unnest(generate_series(0, 39)) j)),
hits as (select p.user_id, p.rn, l.item, min(p.j) j from points p asof join (select * from {line}) l on p.pos >= l.w_from where l.item <> p.true_item group by 1, 2, 3),
good as (select * from (select h.*, row_number() over (partition by user_id, rn order by j) - 1 nth from hits h where true {not_past('h')}) where nth < {K - 1}),
short as (select * from {decided} d where (select count(*) from good g where g.user_id = d.user_id and g.rn = d.rn) < {K - 1}),
rest as (select * from (select user_id, rn, item, row_number() over (partition by user_id, rn order by key, item) - 1 nth from (
  select s.user_id, s.rn, l.item, -ln({uniform(f"'{SEED}'", 's.user_id', 'cast(s.rn as varchar)', 'l.item')}) / l.w as key from short s join {line} l on l.w_from >= s.lo and l.w_from < s.hi and l.item <> s.item) q where true {not_past('q')}) where nth < {K - 1}),
decoys as (select user_id, rn, item, nth from good where (user_id, rn) not in (select user_id, rn from short) union all select user_id, rn, item, nth from rest)"""


_SHUFFLED = f"""options as (select user_id, rn, row_number() over (partition by user_id, rn order by md5('{SEED}|' || user_id || '|' || rn || '|shuffle|' || item), item) - 1 idx, item, is_true
  from (select user_id, rn, item, true is_true from cohort union all select user_id, rn, item, false from decoys)
  where (user_id, rn) in (select user_id, rn from decoys group by 1, 2 having count(*) = {K - 1}))"""

_POPMATCHED = f"""{_WIDTH},
stretch as (select w.*, a.w_lo lo, z.w_hi hi from widths w join sizes a on a.band = greatest(0, w.band - w.width) join sizes z on z.band = least(19, w.band + w.width) where w.width is not null),
weights as (select item, w_from, pop + 1 w from bands),
{_draws('stretch', 'weights', 'old')}, {_SHUFFLED}"""


@query(f"with {LINES}, {_COHORT} select user_id from chosen")
def cohort_sample(spark, d):
    novel = timeline.held_out(timeline.split(timeline.ordered(events(spark, d)))).filter("is_novel")
    return sampling.sample_keys(novel, "user_id", N_USERS, SEED)


@query(
    f"""with {LINES}, {_COHORT}, second as (select user_id from (select distinct user_id from held where is_novel and user_id not in (select user_id from chosen)) order by md5('20260920|' || user_id), user_id limit {N_USERS})
    select 'first' as cohort, user_id from chosen union all select 'second', user_id from second"""
)
def disjoint_cohorts(spark, d):
    """Two cohorts, the second drawn from the users that the first left."""
    novel = stored(timeline.held_out(timeline.split(timeline.ordered(events(spark, d)))).filter("is_novel").select("user_id").distinct())
    first = stored(sampling.sample_keys(novel, "user_id", N_USERS, SEED))
    second = sampling.sample_keys(novel.join(first, "user_id", "left_anti"), "user_id", N_USERS, 20260920)
    return first.select(F.lit("first").alias("cohort"), "user_id").unionByName(second.select(F.lit("second").alias("cohort"), "user_id"))


@query(f"with {_WIDTH} select user_id, rn, band, width from widths")
def decoy_width(spark, d):
    return Base(spark, d).wide().select("user_id", "rn", "band", "width")


@query(f"with {_POPMATCHED} select user_id, rn, item, nth from decoys")
def popmatched_decoys(spark, d):
    """Decoys in the order in which they were drawn, with weight popularity + 1."""
    return Base(spark, d).popmatched()


@query(f"with {_POPMATCHED} select * from options")
def popmatched_options(spark, d):
    b = Base(spark, d)
    return questions.shuffled(b.cohort, b.popmatched())


@query(f"with {_POPMATCHED} select idx, count(*) n, round(count(*) / sum(count(*)) over (), 9) as share, round((count(*) - sum(count(*)) over () / 5) / sqrt(sum(count(*)) over () * 0.2 * 0.8), 9) z from options where is_true group by idx")
def answer_position(spark, d):
    b = Base(spark, d)
    return questions.answer_positions(questions.shuffled(b.cohort, b.popmatched()))


_TOP = """top_items as (select item, count(*) n, row_number() over (order by count(*) desc, item) - 1 w_from from ev group by item),
weights as (select item, w_from, 1 w from top_items where w_from < 2000),
stretch as (select c.*, 0 lo, (select count(*) from weights) hi from cohort c)"""


@query(f"with {LINES}, {_COHORT}, {_TOP} select item, n, w_from as rank from top_items where w_from < 2000")
def popular_top_items(spark, d):
    return items.most_frequent(events(spark, d)).select("item", "n", "rank")


def _uniform_options(b: Base, ranked: DataFrame) -> DataFrame:
    line = ranked.select("item", F.col("rank").alias("w_from"), F.lit(1).cast("bigint").alias("w"))
    n = line.count()
    ready = b.cohort.withColumn("lo", F.lit(0).cast("bigint")).withColumn("hi", F.lit(n).cast("bigint"))
    return questions.shuffled(b.cohort, questions.draw_decoys(ready, line, None, K - 1, SEED))


@query(f"with {LINES}, {_COHORT}, {_TOP}, {_draws('stretch', 'weights', None)}, {_SHUFFLED} select * from options")
def popular_options(spark, d):
    """Decoys drawn evenly from the 2,000 most frequent items; items of the history may be among them."""
    b = Base(spark, d)
    return _uniform_options(b, items.most_frequent(b.events))


@query(
    f"""with {LINES}, {_COHORT}, weights as (select item, row_number() over (order by item) - 1 w_from, 1 w from (select distinct item from ev)),
    stretch as (select c.*, 0 lo, (select count(*) from weights) hi from cohort c), {_draws('stretch', 'weights', None)}, {_SHUFFLED} select * from options"""
)
def random_options(spark, d):
    b = Base(spark, d)
    return _uniform_options(b, items.global_rank(b.events.select("item").distinct(), ["item"]))


def _scores(e: DataFrame) -> DataFrame:
    """Stand-in for an outside table of genericness scores: fixed by the item's hash."""
    return e.select("item").distinct().withColumn("score", F.round(sampling.uniform(SEED, "item"), 6))


_GENERIC = f"""scores as (select item, round({uniform(f"'{SEED}'", 'item')}, 6) score from (select distinct item from ev)),
edges as (select quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) e from scores),
bins as (select item, score, cast(len(list_filter(e, lambda x: x <= score)) as int) g from scores cross join edges)"""


@query(f"with {LINES}, {_GENERIC} select item, score, g from bins")
def genericness_bins(spark, d):
    s = _scores(events(spark, d))
    return s.withColumn("g", items.bin_of(F.col("score"), items.bin_edges(s)))


_TEXTMATCHED = f"""{_WIDTH}, {_GENERIC},
pool as (select w.user_id, w.rn, x.item, x.pop, abs(gx.g - gt.g) apart from widths w join bands x on abs(x.band - w.band) <= w.width and x.item <> w.item
  join bins gx on gx.item = x.item join bins gt on gt.item = w.item where not exists (select 1 from old o where o.user_id = w.user_id and o.item = x.item)),
g_widths as (select user_id, rn, case when count(*) filter (where apart <= 0) >= 4 then 0 when count(*) filter (where apart <= 1) >= 4 then 1 when count(*) filter (where apart <= 2) >= 4 then 2 when count(*) filter (where apart <= 3) >= 4 then 3 else 4 end g_width from pool group by 1, 2),
keyed as (select p.user_id, p.rn, p.item, g_width, -ln({uniform(f"'{SEED}'", 'p.user_id', 'cast(p.rn as varchar)', 'p.item')}) / (pop + 1) as key from pool p join g_widths g on g.user_id = p.user_id and g.rn = p.rn where apart <= g_width),
decoys as (select * from (select user_id, rn, item, row_number() over (partition by user_id, rn order by key, item) - 1 nth from keyed) where nth < 4), {_SHUFFLED}"""


@query(f"with {_TEXTMATCHED} select * from options")
def textmatched_options(spark, d):
    b = _cohort(spark, d, "textmatched")
    pool = questions.pool_of_spans(b.generic[0], b.generic[1].select("item", "w_from", "w"), b.past)
    return questions.shuffled(b.decisions, questions.race(pool, K - 1, SEED, F.col("w")))


_PERIOD = f"""{_WIDTH},
profile as (select e.item, coalesce(bool_or(not held and e.t < {Y2017}), false) pre0, coalesce(bool_or(not held and e.t >= {Y2017}), false) pre1, bool_or(e.t < {Y2017}) act0, bool_or(e.t >= {Y2017}) act1
  from ev e left join parts p on e.seq = p.seq group by e.item),
meta as (select item, arg_max(coalesce(cat, ''), seq) cat, arg_max(coalesce(name, ''), seq) as name from ev where cat is not null or name is not null group by item),
labels as (select i.item, case when coalesce(name, '') <> '' then name || ' (' || coalesce(nullif(cat, ''), 'Unknown') || ')' else coalesce(nullif(cat, ''), 'Unknown') end as label
    from (select distinct item from ev) i left join meta m on i.item = m.item),
side as (select b.item, b.pop, b.band, p.pre0, p.pre1, p.act0, p.act1, l.label from bands b join profile p on b.item = p.item join labels l on b.item = l.item),
pool as (select d.user_id, d.rn, x.item, x.pop, x.label, abs(x.band - m.band) apart from cohort d join side m on d.item = m.item
  join side x on x.pre0 = m.pre0 and x.pre1 = m.pre1 and x.item <> d.item and x.label <> m.label and case when d.t < {Y2017} then x.act0 else x.act1 end
  where not exists (select 1 from old o where o.user_id = d.user_id and o.item = x.item)),
p_widths as (select user_id, rn, m p_width from (select *, row_number() over (partition by user_id, rn order by m) r from (select user_id, rn, label, min(apart) m from pool group by 1, 2, 3)) where r = 4),
keyed as (select p.user_id, p.rn, p.item, p.label, p_width, -ln({uniform(f"'{SEED}'", 'p.user_id', 'cast(p.rn as varchar)', 'p.item')}) / (pop + 1) as key from pool p join p_widths g on g.user_id = p.user_id and g.rn = p.rn where apart <= p_width),
best as (select user_id, rn, label, arg_min(item, (key, item)) item, min(key) as key from keyed group by 1, 2, 3),
decoys as (select * from (select user_id, rn, item, row_number() over (partition by user_id, rn order by key, item) - 1 nth from best) where nth < 4), {_SHUFFLED}"""


@query(f"with {_PERIOD} select * from options")
def popmatched_period_options(spark, d):
    """Decoys with the true item's period profile, active in the decision's period, all with different labels."""
    b = _cohort(spark, d, "popmatched_period")
    spans = b.period[0].filter("p_width is not null")
    pool = questions.pool_of_spans(spans, b.period[1].select("item", "w_from", "w", "label"), b.past)
    return questions.shuffled(b.decisions, questions.race_by_label(pool, K - 1, SEED, F.col("w")))


@query(
    f"""with {_PERIOD}, {_GENERIC},
    g_pool as (select w.user_id, w.rn, abs(gx.g - gt.g) apart from widths w join bands x on abs(x.band - w.band) <= w.width and x.item <> w.item
      join bins gx on gx.item = x.item join bins gt on gt.item = w.item where not exists (select 1 from old o where o.user_id = w.user_id and o.item = x.item)),
    g_short as (select user_id, rn from g_pool group by 1, 2 having count(*) filter (where apart <= 0) < 4)
    select 'popmatched' as condition, (select count(*) from cohort) n_rows, (select count(*) filter (where width > 0) from widths) n_fallback, (select count(*) filter (where width is null) from widths) n_dropped
    union all select 'textmatched', (select count(*) from cohort), (select count(*) from g_short), (select count(*) filter (where width is null) from widths)
    union all select 'popmatched_period', (select count(*) from cohort), (select count(*) filter (where p_width > 0) from p_widths), (select count(*) from cohort) - (select count(*) from p_widths)"""
)
def fallback_stats(spark, d):
    """How many decisions had to widen their pool, and how many were dropped for want of decoys."""
    return _stats(spark, d, _cohort)


def _stats(spark: SparkSession, d: str, start) -> DataFrame:
    out = None
    for condition in ("popmatched", "textmatched", "popmatched_period"):
        one = start(spark, d, condition).stats()
        out = one if out is None else out.unionByName(one)
    return out


# --- every held-out decision of every eligible user -----------------------------------------------------------------

_ALL = "cohort as (select user_id, rn, t, item from held), old as (select * from past)"
#: A revisited true item is among the history's items already.
_TRUE, _TRUE_ONCE = "cast(s.band = b.band as int)", "cast(s.band = b.band and (d.user_id, d.item) not in (select user_id, item from old) as int)"


def whole(name: str, sql: bool = True):
    """Register a query over all decisions as all_<name>; its SQL is that of the cohort's query without the cohort."""

    def add(f):
        QUERIES[f"all_{name}"] = f
        if sql:
            SQL[f"all_{name}"] = SQL[name].replace(_COHORT, _ALL).replace(_TRUE, _TRUE_ONCE)
        return f

    return add


@whole("decoy_width")
def all_decoy_width(spark, d):
    return _all(spark, d).wide.select("user_id", "rn", "band", "width")


@whole("popmatched_decoys")
def all_popmatched_decoys(spark, d):
    return _all(spark, d).decoys


@whole("popmatched_options")
def all_popmatched_options(spark, d):
    return _all(spark, d).options


@whole("answer_position")
def all_answer_position(spark, d):
    return questions.answer_positions(_all(spark, d).options)


@whole("popular_options")
def all_popular_options(spark, d):
    return _all(spark, d, "popular").options


@whole("random_options")
def all_random_options(spark, d):
    return _all(spark, d, "random").options


@whole("textmatched_options", sql=False)
def all_textmatched_options(spark, d):
    """Drawn from the weight line of (bin, band) instead of enumerated pools: the same distribution, other draws."""
    return _all(spark, d, "textmatched").options


@whole("popmatched_period_options", sql=False)
def all_popmatched_period_options(spark, d):
    """Drawn from the weight line of (class, band) instead of enumerated pools: the same distribution, other draws."""
    return _all(spark, d, "popmatched_period").options


@whole("fallback_stats")
def all_fallback_stats(spark, d):
    """How many of all held-out decisions had to widen their pool or were dropped, from the widths alone."""
    return _stats(spark, d, _all)


_WALK = """walk as (select user_id, item, min(rn) rn, arg_min(t, rn) t from parts where not held group by 1, 2 having min(rn) > 1),
cohort as (select user_id, rn, t, item from (select *, row_number() over (partition by user_id order by {h}, rn) k from walk) where k <= 20), old as (select * from past)""".format(h=hash32(f"'{SEED}'", "user_id", "cast(rn as varchar)"))


@query(
    f"""with {_POPMATCHED.replace(_COHORT, _WALK).replace(_TRUE, _TRUE_ONCE)} select o.user_id, o.rn, cast(o.rn - 1 as bigint) n_history, string_agg(o.item, '|' order by o.idx) options, max(o.item) filter (where is_true) target, ' ' || max(chr(65 + cast(o.idx as int))) filter (where is_true) completion from options o group by 1, 2"""
)
def sft_instances(spark, d):
    """Training questions of every person: options and the letter of the right one, from first visits before the cut."""
    _, options = training_instances(events(spark, d), k=K, seed=SEED)
    one = options.groupBy("user_id", "rn").agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("o"), F.max(F.when(F.col("is_true"), F.struct("item", "idx"))).alias("t"))  # five options
    letter = F.char(65 + F.col("t.idx"))
    return one.select("user_id", "rn", (F.col("rn") - 1).cast("bigint").alias("n_history"), F.array_join("o.item", "|").alias("options"), F.col("t.item").alias("target"), F.concat(F.lit(" "), letter).alias("completion"))
