"""Simple rules over the decisions' options, donors, privacy, training instances, recommenders and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import norm_id, stored
from ..functions.text import distance_cue
from ..operators.checks import run_checks
from ..operators import controls, items, nearby, privacy, sampling, timeline
from ..sources import events as src
from ..sources.tables import table
from .sql import DECISIONS, EVENTS, LINES, PREDICTIONS, Y2017, hash32, norm

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n_rows() -> Column:
    return F.count(F.lit(1))


def _options(spark: SparkSession, d: str) -> DataFrame:
    return src.options(src.decisions(spark, d))


def _picks(scored: DataFrame, score: str) -> DataFrame:
    """decision_id, user_id, ok: whether the option of the largest score (nulls last, first of equals) is the true one."""
    best = scored.groupBy("decision_id", "user_id").agg(F.max_by("is_true", F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col("idx"))).alias("ok"))
    return best


def _accuracy(picks: DataFrame) -> DataFrame:
    u = picks.groupBy("user_id").agg(n_rows().alias("n"), F.sum(F.col("ok").cast("int")).alias("hits"))
    return u.agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("hits") / F.col("n")), 9).alias("macro"))


def _accuracy_sql(score: str, source: str) -> str:
    return f"""best as (select decision_id, user_id, arg_max(is_true, (coalesce({score}, '-infinity'::double), -idx)) ok from {source} group by 1, 2),
    us as (select user_id, count(*) n, sum(ok::int) hits from best group by 1) select cast(sum(n) as bigint) n, round(sum(hits) / sum(n), 9) micro, round(avg(hits / n), 9) macro from us"""


# --- distance --------------------------------------------------------------------------------------------------------

_HAV = "case when {a}.lat is not null and {b}.lat is not null then 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) end"
_PLACES = "spots as (select item, arg_min(lat, seq) lat, arg_min(lon, seq) lon from ev where lat is not null and lon is not null group by item)"
_NEAREST = f"""{EVENTS}, {DECISIONS}, {_PLACES},
past as (select distinct decision_id, h item from (select decision_id, unnest(history) h from dec where user_id is not null) where h is not null),
near as (select o.decision_id, o.user_id, o.idx, o.is_true, round(min({_HAV.format(a='a', b='b')}), 6) km from opt o left join spots a on o.item = a.item left join past p on p.decision_id = o.decision_id left join spots b on b.item = p.item group by 1, 2, 3, 4)"""


def nearest_km(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, user_id, idx, is_true, km: distance of each option to the nearest place of the decision's history."""
    spots = items.coordinates(src.events(spark, d))
    dec = src.decisions(spark, d)
    past = dec.filter("user_id is not null").select("decision_id", F.explode(F.array_distinct("history")).alias("item")).join(spots, "item").select("decision_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    o = src.options(dec).join(spots, "item", "left").join(past, "decision_id", "left")
    km = nearby.haversine_km(F.col("lat"), F.col("lon"), F.col("h_lat"), F.col("h_lon"))
    return o.groupBy("decision_id", "user_id", "idx", "is_true").agg(F.round(F.min(km), 6).alias("km"))


@query(f"with {_NEAREST} select decision_id, idx, km from near")
def nearest_history_km(spark, d):
    return nearest_km(spark, d).select("decision_id", "idx", "km")


@query(f"with {_NEAREST}, scored as (select *, -km score from near), {_accuracy_sql('score', 'scored')}")
def nearest_rule_accuracy(spark, d):
    """Accuracy of always taking the option nearest to the history."""
    return _accuracy(_picks(nearest_km(spark, d).withColumn("score", -F.col("km")), "score"))


@query(f"with {_NEAREST} select is_true, count(*) n, count(km) n_located, round(avg(km), 5) mean_km, round(median(km), 6) median_km, quantile_cont(km, 0.9) p90_km from near group by 1")
def distance_answer_vs_decoys(spark, d):
    return nearest_km(spark, d).groupBy("is_true").agg(n_rows().alias("n"), F.count("km").alias("n_located"), F.round(F.avg("km"), 5).alias("mean_km"), F.round(F.median("km"), 6).alias("median_km"), F.percentile("km", F.lit(0.9)).alias("p90_km"))


@query(f"with {_NEAREST} select decision_id, idx, case when km is null then ' [distance unknown]' else ' [' || format('{{:.1f}}', round_even(km, 1)) || ' km from the nearest place in their history]' end cue from near")
def distance_cues(spark, d):
    """The text that tells an option's distance, rounded half to even."""
    return nearest_km(spark, d).select("decision_id", "idx", distance_cue(F.col("km")).alias("cue"))


@query(
    f"""with {EVENTS}, {_PLACES}, line as (select user_id, seq, item, lag(item) over (partition by user_id order by t, item, seq) p from ev)
    select l.seq, round({_HAV.format(a='a', b='b')}, 6) km from line l join spots a on l.p = a.item join spots b on l.item = b.item"""
)
def haversine_pairs(spark, d):
    """Distance between the places of each event and the one before it."""
    e = src.events(spark, d)
    spots = items.coordinates(e)
    a, b = (spots.select(F.col("item").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lon").alias(f"{x}_lon")) for x in ("x", "y"))
    line = timeline.ordered(e).filter("prev is not null").select("seq", F.col("prev.item").alias("x"), F.col("item").alias("y"))
    return line.join(a, "x").join(b, "y").select("seq", F.round(nearby.haversine_km(F.col("x_lat"), F.col("x_lon"), F.col("y_lat"), F.col("y_lon")), 6).alias("km"))


# --- popularity, habit, chance ------------------------------------------------------------------------------------------

_POP = f"{EVENTS}, {DECISIONS}, counts as (select item, count(*) c from ev group by item), scored as (select o.*, coalesce(c, 0)::double score from opt o left join counts n on o.item = n.item)"


def _popular(spark: SparkSession, d: str) -> DataFrame:
    counts = src.events(spark, d).groupBy("item").agg(n_rows().alias("c"))
    return _options(spark, d).join(counts, "item", "left").withColumn("score", F.coalesce("c", F.lit(0)).cast("double")).drop("c")


@query(f"with {_POP}, {_accuracy_sql('score', 'scored')}")
def popularity_rule_accuracy(spark, d):
    return _accuracy(_picks(_popular(spark, d), "score"))


@query(
    f"""with {_POP}, m as (select *, max(score) over (partition by decision_id) best from scored),
    x as (select decision_id, sum((score = best and is_true)::int) / sum((score = best)::int) e from m group by 1) select count(*) n, round(avg(e), 9) expected from x"""
)
def tie_expected_accuracy(spark, d):
    """Accuracy of the popularity rule if ties are broken by chance."""
    o = _popular(spark, d)
    best = o.groupBy("decision_id").agg(F.max("score").alias("best"))
    tied = o.join(best, "decision_id").filter("score = best").groupBy("decision_id").agg(F.avg(F.col("is_true").cast("double")).alias("e"))
    return tied.agg(n_rows().alias("n"), F.round(F.avg("e"), 9).alias("expected"))


_HIST = f"""{DECISIONS}, steps as (select decision_id, i, history[i] item from (select decision_id, history, unnest(generate_series(1, len(history))) i from dec where user_id is not null) where history[i] is not null),
own as (select decision_id, item, count(*) c, max(i) latest from steps group by 1, 2)"""


def _own(spark: SparkSession, d: str) -> DataFrame:
    steps = src.decisions(spark, d).filter("user_id is not null").select("decision_id", F.posexplode("history").alias("i", "item")).filter("item is not null")
    return steps.groupBy("decision_id", "item").agg(n_rows().alias("c"), (F.max("i") + 1).alias("latest"))


@query(
    f"""with {_HIST}, scored as (select o.*, coalesce(c, 0)::double freq, coalesce(latest, 0)::double latest from opt o left join own h on o.decision_id = h.decision_id and o.item = h.item),
    best as (select decision_id, arg_max(is_true, (freq, -idx)) by_freq, arg_max(is_true, (latest, -idx)) by_recency, max((is_true and freq > 0)::int) in_history, max((is_true and idx = {hash32("'0'", 'cast(decision_id as varchar)')} % n_opts)::int) by_chance
      from (select *, count(*) over (partition by decision_id) n_opts from scored) group by 1)
    select count(*) n, round(avg(by_freq::int), 9) personal_freq, round(avg(by_recency::int), 9) personal_recent, round(avg(in_history), 9) true_in_history, round(avg(by_chance), 9) random from best"""
)
def personal_baselines(spark, d):
    """Accuracy of one's own most frequent and most recent option, of chance, and how often the truth was visited before."""
    o = _options(spark, d).join(_own(spark, d), ["decision_id", "item"], "left").withColumn("freq", F.coalesce("c", F.lit(0))).withColumn("late", F.coalesce("latest", F.lit(0)))
    n = o.groupBy("decision_id").agg(n_rows().alias("n_opts"), *(F.max_by("is_true", F.struct(x, -F.col("idx"))).alias(x) for x in ("freq", "late")), F.max((F.col("is_true") & (F.col("freq") > 0)).cast("int")).alias("in_history"), F.max(F.when(F.col("is_true"), F.col("idx"))).alias("true_idx"))
    chance = F.coalesce((F.col("true_idx") == F.pmod(sampling.hash32(0, "decision_id"), F.col("n_opts"))).cast("int"), F.lit(0))
    return n.agg(n_rows().alias("n"), *(F.round(F.avg(F.col(x).cast("int")), 9).alias(y) for x, y in (("freq", "personal_freq"), ("late", "personal_recent"), ("in_history", "true_in_history"))), F.round(F.avg(chance), 9).alias("random"))


@query(
    f"""with {EVENTS}, {_HIST}, meta as (select item, nullif(arg_max(coalesce(cat, ''), seq), '') cat from ev where cat is not null or name is not null group by item),
    hc as (select s.decision_id, m.cat, count(*) c from steps s join meta m on s.item = m.item where m.cat is not null group by 1, 2),
    scored as (select o.*, coalesce(h.c, 0)::double score from opt o left join meta m on o.item = m.item left join hc h on h.decision_id = o.decision_id and h.cat = m.cat), {_accuracy_sql('score', 'scored')}"""
)
def category_heuristic_accuracy(spark, d):
    """Accuracy of taking the option whose category is most frequent in the history."""
    meta = items.metadata(src.events(spark, d)).filter("cat is not null").select("item", "cat")
    hc = _own(spark, d).join(meta, "item").groupBy("decision_id", "cat").agg(F.sum("c").alias("score"))
    o = _options(spark, d).join(meta, "item", "left").join(hc, ["decision_id", "cat"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("double"))
    return _accuracy(_picks(o, "score"))


_ACTIVE = f"""{EVENTS}, {DECISIONS}, act as (select item, bool_or(t < {Y2017}) act0, bool_or(t >= {Y2017}) act1 from ev group by item),
slots as (select o.decision_id, o.idx, o.is_true, case when d.t < {Y2017} then 'early' else 'late' end period, coalesce(case when d.t < {Y2017} then act0 else act1 end, false) active
  from opt o join dec d on o.decision_id = d.decision_id left join act a on a.item = o.item where d.t is not null)"""


def _slots(spark: SparkSession, d: str) -> DataFrame:
    p = items.period(F.col("t"))
    act = src.events(spark, d).groupBy("item").agg(F.max(p == 0).alias("act0"), F.max(p == 1).alias("act1"))
    dec = src.decisions(spark, d).filter("t is not null")
    o = src.options(dec).join(dec.select("decision_id", p.alias("per")), "decision_id").join(act, "item", "left")
    return o.select("decision_id", "idx", "is_true", F.when(F.col("per") == 0, "early").otherwise("late").alias("period"), F.coalesce(F.when(F.col("per") == 0, F.col("act0")).otherwise(F.col("act1")), F.lit(False)).alias("active"))


@query(
    f"""with {_ACTIVE}, x as (select decision_id, case when sum(active::int) = 0 then 1 / count(*) else sum((active and is_true)::int) / sum(active::int) end e from slots group by 1)
    select count(*) n, round(avg(e), 9) expected from x"""
)
def period_rule_expected_accuracy(spark, d):
    """Expected accuracy of a random choice among the options active in the decision's period."""
    a = F.sum(F.col("active").cast("int"))
    x = _slots(spark, d).groupBy("decision_id").agg(F.when(a == 0, 1 / n_rows()).otherwise(F.sum((F.col("active") & F.col("is_true")).cast("int")) / a).alias("e"))
    return x.agg(n_rows().alias("n"), F.round(F.avg("e"), 9).alias("expected"))


@query(
    f"""with {_ACTIVE}, r as (select decision_id, period, count(*) n_slots, count(*) filter (where not active) n_off from slots group by 1, 2)
    select coalesce(period, 'all') period, count(*) n_rows, count(*) filter (where n_off > 0) n_rows_off, cast(sum(n_slots) as bigint) n_slots, cast(sum(n_off) as bigint) n_off, round(sum(n_off) / sum(n_slots), 9) share_off from r group by rollup (period)"""
)
def off_period_rollup(spark, d):
    """Options not active in the decision's period, by period and in all."""
    r = _slots(spark, d).groupBy("decision_id", "period").agg(n_rows().alias("n_slots"), F.count_if(~F.col("active")).alias("n_off"))
    return r.rollup("period").agg(n_rows().alias("n_rows"), F.count_if(F.col("n_off") > 0).alias("n_rows_off"), F.sum("n_slots").alias("n_slots"), F.sum("n_off").alias("n_off"), F.round(F.sum("n_off") / F.sum("n_slots"), 9).alias("share_off")).withColumn("period", F.coalesce("period", F.lit("all")))


@query(
    f"""with {DECISIONS} select count(*) n, count(*) filter (where user_id is null) no_user, count(*) filter (where len(coalesce(candidates, [])) <> k) wrong_number, count(*) filter (where len(list_distinct(list_filter(candidates, lambda c: c is not null))) < len(list_filter(candidates, lambda c: c is not null))) repeated,
    count(*) filter (where len(list_filter(candidates, lambda c: c is null)) > 0) with_missing, count(*) filter (where answer_idx is null) no_answer, count(*) filter (where candidates[answer_idx + 1] <> true_item) wrong_answer, count(*) filter (where list_contains(history, true_item)) true_in_history from dec"""
)
def label_quality(spark, d):
    """Counts of malformed decisions."""
    x = src.decisions(spark, d)
    there = F.filter("candidates", lambda c: c.isNotNull())
    return x.agg(
        n_rows().alias("n"), F.count_if(F.col("user_id").isNull()).alias("no_user"), F.count_if(F.coalesce(F.size("candidates"), F.lit(0)) != F.col("k")).alias("wrong_number"),
        F.count_if(F.size(F.array_distinct(there)) < F.size(there)).alias("repeated"), F.count_if(F.size(F.filter("candidates", lambda c: c.isNull())) > 0).alias("with_missing"),
        F.count_if(F.col("answer_idx").isNull()).alias("no_answer"), F.count_if(F.get("candidates", "answer_idx") != F.col("true_item")).alias("wrong_answer"), F.count_if(F.array_contains("history", F.col("true_item"))).alias("true_in_history"),
    )


@query(
    f"""with {DECISIONS}, x as (select count(*) c from dec where user_id is not null and t is not null and true_item is not null group by user_id, t, true_item) select count(*) n_distinct, cast(sum(c - 1) as bigint) n_repeated, max(c) most from x"""
)
def repeated_decisions(spark, d):
    x = src.decisions(spark, d).dropna(subset=["user_id", "t", "true_item"]).groupBy("user_id", "t", "true_item").agg(n_rows().alias("c"))
    return x.agg(n_rows().alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_repeated"), F.max("c").alias("most"))


# --- donors ---------------------------------------------------------------------------------------------------------

@query(
    f"""with {DECISIONS}, users as (select user_id donor, row_number() over (order by user_id) - 1 rank, count(*) over () n from (select distinct user_id from dec where user_id is not null)),
    j as (select d.decision_id, d.user_id, u.rank, {hash32("'0'", 'cast(d.decision_id as varchar)')} % (u.n - 1) j from dec d join users u on d.user_id = u.donor where u.n > 1)
    select j.decision_id, j.user_id, u.donor from j join users u on u.rank = j.j + (j.j >= j.rank)::int"""
)
def random_donor(spark, d):
    """For every decision some other user, whose history could stand in."""
    dec = src.decisions(spark, d).filter("user_id is not null").select("decision_id", "user_id")
    return controls.random_donors(dec, dec, "decision_id")


_QUERY_USERS = "queries as (select user_id from (select distinct user_id from ev) order by md5('0|' || user_id), user_id limit 100)"


def _query_users(e: DataFrame) -> DataFrame:
    return sampling.sample_keys(e, "user_id", 100, 0)


_COSINE = f"""{EVENTS}, {_QUERY_USERS}, vec as (select user_id, cat, count(*) n from ev where cat is not null group by 1, 2), norms as (select user_id, sqrt(sum(n * n)::double) norm from vec group by 1),
cosines as (select a.user_id, b.user_id donor, sum(a.n * b.n) / (max(x.norm) * max(y.norm)) cosine from vec a join vec b on a.cat = b.cat and a.user_id <> b.user_id join norms x on x.user_id = a.user_id join norms y on y.user_id = b.user_id
  where a.user_id in (select user_id from queries) group by 1, 2)"""


@query(f"with {_COSINE} select user_id, donor, round(cosine, 9) cosine from cosines")
def user_category_cosine(spark, d):
    """Similarity of a sample of 100 users to all others that share a category."""
    e = src.events(spark, d)
    return controls.cosines(controls.category_vectors(e), _query_users(e)).select("user_id", "donor", F.round("cosine", 9).alias("cosine"))


@query(
    f"""with {_COSINE}, lens as (select user_id, count(*) len from ev group by 1),
    pairs as (select a.user_id, b.user_id donor, round(abs(ln(b.len / a.len)), 12) ratio, abs(ln(b.len / a.len)) r from lens a join lens b on a.user_id <> b.user_id where a.user_id in (select user_id from queries)),
    banded as (select p.*, case when r <= ln(1.25) + 1e-12 then 0 when r <= ln(1.5) + 1e-12 then 1 when r <= ln(2) + 1e-12 then 2 when r <= ln(4) + 1e-12 then 3 else 4 end band, round(coalesce(c.cosine, 0), 12) cosine from pairs p left join cosines c on c.user_id = p.user_id and c.donor = p.donor),
    best as (select *, row_number() over (partition by user_id order by band, -cosine, ratio, donor) k from banded)
    select user_id, donor, band, round(cosine, 9) cosine, round(ratio, 9) ratio from best where k = 1"""
)
def matched_donor(spark, d):
    """For a sample of 100 users the most similar other user of about the same length of history."""
    e = src.events(spark, d)
    return controls.matched_donors(e, _query_users(e)).select("user_id", "donor", "band", F.round("cosine", 9).alias("cosine"), F.round("ratio", 9).alias("ratio"))


@query()
def all_matched_donor(spark, d):
    """A donor for every user with decisions, other than users whose last 30 places read the same."""
    e = src.events(spark, d)
    names = e.select("item").distinct().join(items.metadata(e), "item", "left").select("item", items.label(F.col("cat"), F.col("name")).alias("label"))
    last = timeline.ordered(e.select("seq", "user_id", "t", "item")).filter("rn > n - 30").join(names, "item")
    shown = last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]), ", ").alias("history"))
    queries = src.decisions(spark, d).filter("user_id is not null").select("user_id")
    return controls.matched_donors_of_all(e, queries, shown).select("user_id", "donor", "band", F.round("cosine", 9).alias("cosine"), F.round("ratio", 9).alias("ratio"))


# --- privacy ----------------------------------------------------------------------------------------------------------

def _unicity_sql(value: str) -> str:
    rows = []
    for k in (1, 2, 3):
        rows.append(
            f"""select {k} as k, count(*) n_sets, round(avg((n = 1)::int), 9) unique_share, quantile_cont(n, 0.5) median_support from (
            select s.user_id, s.draw, (select count(*) from (select h.user_id from held h where list_contains(s.vs, h.v) group by 1 having count(*) = {k})) n from
            (select user_id, draw, list(v) vs from ranked where k <= {k} group by 1, 2 having count(*) = {k}) s)"""
        )
    return f"""with {EVENTS}, held as (select distinct user_id, {value} v from ev where {value} is not null),
    chosen as (select user_id from (select distinct user_id from held) order by md5('0|' || user_id), user_id limit 30),
    ranked as (select user_id, draw, v, row_number() over (partition by user_id, draw order by {hash32("'0'", 'cast(draw as varchar)', 'user_id', 'v')}, v) k
      from held cross join (select unnest(generate_series(0, 4)) draw) where user_id in (select user_id from chosen)) {' union all '.join(rows)}"""


@query(_unicity_sql("item"))
def unicity_k(spark, d):
    """How often k random items of a user are nobody else's."""
    return privacy.unicity(src.events(spark, d).select("user_id", "item"), "item", ks=(1, 2, 3), draws=5, n_users=30)


@query(_unicity_sql("cat"))
def category_unicity(spark, d):
    return privacy.unicity(src.events(spark, d).filter("cat is not null").select("user_id", "cat"), "cat", ks=(1, 2, 3), draws=5, n_users=30)


def _shown(e: DataFrame) -> DataFrame:
    """user_id, item of the last 30 events before the cut of every user with novel decisions, whose questions show them."""
    parts = timeline.split(timeline.ordered(e.select("seq", "user_id", "t", "item")))
    each = parts.groupBy("user_id", "item").agg(F.min("rn").alias("first"), F.max(F.when(~F.col("held"), F.col("rn"))).alias("last"), F.max("cut").alias("cut"))
    # at most 30 items a user
    users = each.groupBy("user_id").agg(F.max(F.col("first") > F.col("cut")).alias("asked"), F.collect_list(F.when(F.col("last") > F.col("cut") - 30, F.col("item"))).alias("items"))
    return users.filter("asked").select("user_id", F.explode("items").alias("item"))


@query()
def all_unicity_k(spark, d):
    """How often k random shown items are one user's only: all asked users, all items and those of 20 or more users."""
    e = src.events(spark, d)
    return privacy.unicity_of_pools(_shown(e), e.select("user_id", "item"), "item", {"all": 1, "20 or more users": 20}).select("pool", "k", "n_sets", "users_skipped", "unique_share", "median_support")


@query()
def all_category_unicity(spark, d):
    """The same for 3, 6 and 10 shown categories, or all where a user has fewer."""
    e = src.events(spark, d)
    cats = stored(items.metadata(e).filter("cat is not null").select("item", "cat"))
    shown = _shown(e).join(cats, "item").select("user_id", "cat")
    held = e.select("user_id", "item").distinct().join(cats, "item").select("user_id", "cat")
    return privacy.unicity_of_all(shown, held, "cat", ks=(3, 6, 10), fill=True)


@query(
    f"""with {DECISIONS}, {EVENTS}, held as (select distinct user_id, item from ev), want as (select decision_id, list_distinct(list_filter(history[-3:], lambda x: x is not null)) vs from dec where user_id is not null and len(history) > 0),
    each as (select decision_id, unnest(vs) item, len(vs) n from want), hit as (select e.decision_id, h.user_id from each e join held h on e.item = h.item group by 1, 2 having count(*) = max(e.n))
    select w.decision_id, count(h.user_id) n_users from want w left join hit h on w.decision_id = h.decision_id where len(vs) > 0 group by 1"""
)
def posting_support(spark, d):
    """Number of users whose events include the last three items of a decision's history."""
    last = F.filter(F.slice("history", F.greatest(F.lit(1), F.size("history") - 2), F.lit(3)), lambda x: x.isNotNull())
    want = src.decisions(spark, d).filter("user_id is not null and size(history) > 0").select("decision_id", F.array_distinct(last).alias("vs")).filter("size(vs) > 0")
    n = privacy.set_support(want.select(F.col("decision_id").alias("set_id"), F.explode("vs").alias("item")), src.events(spark, d).select("user_id", "item"), "item")
    return want.select("decision_id").join(n.withColumnRenamed("set_id", "decision_id"), "decision_id", "left").select("decision_id", F.coalesce("n_users", F.lit(0)).alias("n_users"))


@query(
    f"""with {EVENTS}, p as (select {norm('cat')} cat from categories where is_private), m as (select seq, case when cat in (select cat from p) then 'Private place' else cat end cat, case when cat in (select cat from p) then null else name end as name, case when cat in (select cat from p) then null else lat end lat from ev)
    select coalesce(cat, '?') cat, count(*) n, count(name) n_named, count(lat) n_located from m group by 1"""
)
def masked_categories(spark, d):
    """What is left of each category when private places are masked."""
    private = table(spark, d, "categories").filter("is_private").select(norm_id("cat").alias("cat"), F.lit(True).alias("private"))
    e = privacy.masked(src.events(spark, d).join(private, "cat", "left"), F.col("private"))
    return e.groupBy(F.coalesce("cat", F.lit("?")).alias("cat")).agg(n_rows().alias("n"), F.count("name").alias("n_named"), F.count("lat").alias("n_located"))


@query(f"with {EVENTS} select user_id, 'Person ' || row_number() over (order by user_id) pseudonym from (select distinct user_id from ev)")
def pseudonyms(spark, d):
    ranked = items.global_rank(src.events(spark, d).select("user_id").distinct(), ["user_id"])
    return ranked.select("user_id", F.concat(F.lit("Person "), (F.col("rank") + 1).cast("string")).alias("pseudonym"))


# --- training instances and recommenders ---------------------------------------------------------------------------------

_WALK = f"{LINES}, walk as (select user_id, item, min(rn) rn from parts where not held group by 1, 2 having min(rn) > 1)"


def _walk(spark: SparkSession, d: str) -> DataFrame:
    parts = timeline.split(timeline.ordered(src.events(spark, d)))
    return timeline.first_visits(parts.filter("not held")).filter("first_rn > 1").select("user_id", "item", F.col("first_rn").alias("rn"))


@query(f"with {_WALK} select user_id, rn, item from (select *, row_number() over (partition by user_id order by {hash32(chr(39) + '0' + chr(39), 'user_id', 'cast(rn as varchar)')}, rn) k from walk) where k <= 20")
def sft_capped(spark, d):
    """At most 20 training instances a user, a random subset."""
    w = _walk(spark, d).withColumn("h", sampling.hash32(0, "user_id", "rn"))
    return sampling.take_per_group(w, ["user_id"], 20, [F.col("h"), F.col("rn")]).select("user_id", "rn", "item")


@query(f"with {_WALK} select (select count(*) from walk) n_instances, (select count(*) from walk w where exists (select 1 from held h where h.is_novel and h.user_id = w.user_id and h.item = w.item)) n_collisions")
def leakage_collisions(spark, d):
    """Training targets that are also held-out answers of the same user: must be none."""
    parts = timeline.split(timeline.ordered(src.events(spark, d)))
    answers = timeline.held_out(parts).filter("is_novel").select("user_id", "item").distinct()
    w = timeline.first_visits(parts.filter("not held")).filter("first_rn > 1")
    return w.join(answers.withColumn("hit", F.lit(True)), ["user_id", "item"], "left").agg(n_rows().alias("n_instances"), F.count("hit").alias("n_collisions"))


@query(
    f"""with {LINES}, u as (select user_id, row_number() over (order by md5('7|' || user_id), user_id) k, count(*) over () n from (select distinct user_id from parts))
    select user_id, case when k <= greatest(1, floor(n * 0.15)) then 'validation' else 'train' end split from u"""
)
def user_val_split(spark, d):
    """Users shuffled by their hash; the first 15 % validate."""
    u = src.events(spark, d).groupBy("user_id").agg(n_rows().alias("n")).filter("n >= 20").select("user_id", F.md5(F.concat(F.lit("7|"), "user_id")).alias("h"))
    r = items.global_rank(u, ["h", "user_id"])
    return r.select("user_id", F.when(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("rows") * 0.15)), "validation").otherwise("train").alias("split"))


@query(f"with {_WALK}, known as (select distinct item from parts where not held), {DECISIONS} select is_true, count(*) n, round(avg((k.item is null)::int), 9) share_unknown from opt o left join known k on o.item = k.item group by 1")
def oov_rate(spark, d):
    """Share of options that the training part doesn't know."""
    parts = timeline.split(timeline.ordered(src.events(spark, d)))
    known = parts.filter("not held").select("item").distinct().withColumn("known", F.lit(True))
    return _options(spark, d).join(known, "item", "left").groupBy("is_true").agg(n_rows().alias("n"), F.round(F.avg(F.col("known").isNull().cast("int")), 9).alias("share_unknown"))


@query(
    f"""with {DECISIONS}, vecs as (select vec_id, embedding from embeddings), size as (select count(*) n from vecs),
    keyed as (select o.decision_id, o.idx, o.user_id, {hash32("'item'", 'o.item')} % (select n from size) i, {hash32("'user'", 'o.user_id')} % (select n from size) u from opt o)
    select k.decision_id, k.idx, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) score from keyed k join vecs a on a.vec_id = k.u join vecs b on b.vec_id = k.i"""
)
def fpmc_scores(spark, d):
    """Dot product of a user's and an option's vector, the vectors looked up by hash."""
    vecs = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = vecs.count()
    o = _options(spark, d).select("decision_id", "idx", F.pmod(sampling.hash32("item", "item"), F.lit(n)).alias("i"), F.pmod(sampling.hash32("user", "user_id"), F.lit(n)).alias("u"))
    j = o.join(vecs.select(F.col("vec_id").alias("u"), F.col("v").alias("a")), "u").join(vecs.select(F.col("vec_id").alias("i"), F.col("v").alias("b")), "i")
    return j.select("decision_id", "idx", F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s_, x: s_ + x), 6).alias("score"))


@query(
    f"""with {LINES}, pairs as (select user_id, item, lead(item) over (partition by user_id order by rn) nxt from parts where not held), trans as (select item, nxt, count(*) c from pairs where nxt is not null group by 1, 2),
    {DECISIONS}, lastly as (select decision_id, history[-1] last_item from dec where user_id is not null and len(history) > 0),
    scored as (select o.*, coalesce(t.c, 0)::double score from opt o left join lastly l on l.decision_id = o.decision_id left join trans t on t.item = l.last_item and t.nxt = o.item), {_accuracy_sql('score', 'scored')}"""
)
def markov_rule_accuracy(spark, d):
    """Accuracy of taking the option that most often follows the last item, counted before the cut."""
    parts = timeline.split(timeline.ordered(src.events(spark, d))).filter("not held and prev is not null")
    trans = parts.groupBy(F.col("prev.item").alias("last_item"), "item").agg(n_rows().alias("score"))
    last = src.decisions(spark, d).filter("user_id is not null and size(history) > 0").select("decision_id", F.element_at("history", -1).alias("last_item"))
    o = _options(spark, d).join(last, "decision_id", "left").join(trans, ["last_item", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("double"))
    return _accuracy(_picks(o, "score"))


@query(f"with {EVENTS}, u as (select count(*) n from ev group by user_id), s as (select list(n order by n) a from u) select a[1 + least(len(a) - 1, floor(0.1 * len(a))::int)] p10, a[1 + least(len(a) - 1, floor(0.5 * len(a))::int)] p50, a[1 + least(len(a) - 1, floor(0.9 * len(a))::int)] p90 from s")
def nearest_rank_quantiles(spark, d):
    """Quantiles that are values of the data: the one at floor(q n) of the sorted list."""
    u = src.events(spark, d).groupBy("user_id").agg(n_rows().alias("n"))
    r = items.global_rank(u, ["n", "user_id"])
    at = lambda q: F.max(F.when(F.col("rank") == F.least(F.col("rows") - 1, F.floor(F.lit(q) * F.col("rows"))), F.col("n")))
    return r.agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


# --- checks: each gives violations ------------------------------------------------------------------------------------------

@query(
    f"""with {LINES}, {DECISIONS}, {PREDICTIONS} select 'cut after start' as check_name, count(*) n_violations from parts where held and rn <= cut union all
    select 'novel and revisits sum up', count(*) from (select user_id from held group by 1 having count(*) filter (where is_novel) + count(*) filter (where not is_novel) <> count(*)) union all
    select 'prediction without decision', count(*) from predictions p where not exists (select 1 from decisions d where d.decision_id = p.decision_id) union all
    select 'answers differ', count(*) from pred p join dec d on p.decision_id = d.decision_id where p.answer_idx <> d.answer_idx union all
    select 'probabilities not five', count(*) from pred where len(logprobs) <> 5"""
)
def checks(spark, d):
    """Numbers of rows that break an invariant."""
    return run_checks(spark, d)
