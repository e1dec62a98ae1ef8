"""Timelines, the split in time, item tables, and data quality of the check-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import norm_id, stored
from ..operators import items, profile, timeline
from ..sources.events import events
from ..sources.tables import table
from .sql import BANDS, EVENTS, LINES, Y2017, norm

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return timeline.split(timeline.ordered(events(spark, d)))


def _kept_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same as narrow rows and kept, for queries that use them twice."""
    return stored(_parts(spark, d).select("seq", "user_id", "t", "item", "rn", "held"))


@query(f"with {LINES} select user_id, count(*) n from line group by user_id having count(*) >= 20")
def eligible_users(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query(f"with {LINES} select user_id, min(n) n, count(*) filter (where not held) n_pre, count(*) filter (where held) n_held from parts group by user_id")
def temporal_split(spark, d):
    return _parts(spark, d).groupBy("user_id").agg(F.min("n").alias("n"), F.count_if(~F.col("held")).alias("n_pre"), F.count_if("held").alias("n_held"))


@query(
    f"""with {LINES}, ends as (select user_id, max(t) filter (not held) last_pre, min(t) filter (held) first_held, count(distinct t >= {Y2017}) n_periods from parts group by user_id)
    select *, (first_held - last_pre) // 86400 gap_days, (first_held - last_pre) // 86400 > 365 long_gap from ends"""
)
def split_gap_days(spark, d):
    """Whole days between the last event before the cut and the first after it."""
    p = _parts(spark, d).groupBy("user_id").agg(
        F.max(F.when(~F.col("held"), F.col("t"))).alias("last_pre"), F.min(F.when(F.col("held"), F.col("t"))).alias("first_held"),
        (F.max(items.period(F.col("t"))) - F.min(items.period(F.col("t"))) + 1).cast("bigint").alias("n_periods"),
    )
    days = F.floor((F.col("first_held") - F.col("last_pre")) / 86400)
    return p.withColumn("gap_days", days).withColumn("long_gap", days > 365)


@query(f"with {LINES} select item, pop from popularity")
def pre_cut_popularity(spark, d):
    return timeline.popularity(_parts(spark, d))


@query(f"with {LINES} select user_id, rn, t, item, row_number() over (partition by user_id order by rn) decision_no from held where is_novel")
def novel_decisions(spark, d):
    novel = stored(timeline.held_out(_kept_parts(spark, d)).filter("is_novel"))
    return timeline.ordered(novel.select("user_id", "t", "item", "seq", F.col("rn").alias("at"))).select("user_id", F.col("at").alias("rn"), "t", "item", F.col("rn").alias("decision_no"))


@query(f"with {LINES} select user_id, count(*) n_pooled, count(*) filter (where is_novel) n_novel, count(*) filter (where not is_novel) n_revisit from held group by user_id")
def revisit_partition(spark, d):
    return timeline.held_out(_kept_parts(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pooled"), F.count_if("is_novel").alias("n_novel"), F.count_if(~F.col("is_novel")).alias("n_revisit"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return items.bands(timeline.popularity(_parts(spark, d)), events(spark, d))


@query(f"with {BANDS} select item, pop, band from bands")
def popularity_bands(spark, d):
    return _bands(spark, d).select("item", "pop", "band")


@query(f"with {BANDS} select band, count(*) n_items, min(pop) min_pop, max(pop) max_pop, cast(sum(pop + 1) as bigint) weight from bands group by band")
def band_sizes(spark, d):
    return _bands(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n_items"), F.min("pop").alias("min_pop"), F.max("pop").alias("max_pop"), F.sum(F.col("pop") + 1).alias("weight"))


_PROFILE = f"""{LINES},
profile as (select e.item, coalesce(bool_or(not held and e.t < {Y2017}), false) pre0, coalesce(bool_or(not held and e.t >= {Y2017}), false) pre1, bool_or(e.t < {Y2017}) act0, bool_or(e.t >= {Y2017}) act1
  from ev e left join parts p on e.seq = p.seq group by e.item)"""


@query(f"with {_PROFILE} select * from profile")
def period_profile(spark, d):
    """In which of two periods an item had events before the cut, and at all."""
    return items.period_profile(events(spark, d), _parts(spark, d))


@query(f"with {EVENTS} select item, arg_max(coalesce(cat, ''), seq) cat, arg_max(coalesce(name, ''), seq) as name from ev where cat is not null or name is not null group by item")
def item_metadata_last_wins(spark, d):
    return items.metadata(events(spark, d)).select("item", F.coalesce("cat", F.lit("")).alias("cat"), F.coalesce("name", F.lit("")).alias("name"))


@query(f"with {EVENTS} select item, arg_min(lat, seq) lat, arg_min(lon, seq) lon from ev where lat is not null and lon is not null group by item")
def coordinates_first_wins(spark, d):
    return items.coordinates(events(spark, d))


@query(
    f"""with {EVENTS}, meta as (select item, arg_max(coalesce(cat, ''), seq) cat, arg_max(coalesce(name, ''), seq) as name from ev where cat is not null or name is not null group by item)
    select i.item, case when coalesce(name, '') <> '' then name || ' (' || coalesce(nullif(cat, ''), 'Unknown') || ')' else coalesce(nullif(cat, ''), 'Unknown') end as label
    from (select distinct item from ev) i left join meta m on i.item = m.item"""
)
def render_labels(spark, d):
    e = events(spark, d)
    return e.select("item").distinct().join(items.metadata(e), "item", "left").select("item", items.label(F.col("cat"), F.col("name")).alias("label"))


@query(f"with {LINES} select user_id, rn - cut + 30 as pos, item from parts where not held and rn > cut - 30")
def last30_history(spark, d):
    """The 30 most recent events before the cut; pos 30 is the latest."""
    return _parts(spark, d).filter("not held and rn > cut - 30").select("user_id", (F.col("rn") - F.col("cut") + 30).alias("pos"), "item")


@query(
    f"""with {LINES}, w as (select user_id, coalesce(cat, '?') cat, count(*) n, min(rn) first_rn from parts where not held and rn > cut - 30 group by 1, 2)
    select user_id, cat, n, place from (select *, row_number() over (partition by user_id order by n desc, first_rn) place from w) where place <= 6"""
)
def top6_categories(spark, d):
    """Most frequent categories of the last 30 events before the cut, ties by first occurrence."""
    w = _parts(spark, d).filter("not held and rn > cut - 30").groupBy("user_id", F.coalesce("cat", F.lit("?")).alias("cat")).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first_rn"))
    return w.withColumn("place", place).filter("place <= 6").select("user_id", "cat", "n", "place")


@query(f"with {LINES} select user_id, item, min(rn) first_rn, max(rn) last_rn, count(*) visits from line group by 1, 2")
def first_and_last_visits(spark, d):
    return timeline.first_visits(timeline.ordered(events(spark, d)))


@query(
    f"""with {LINES}, nxt as (select user_id, item, lead(item) over (partition by user_id order by rn) next_item from parts where not held)
    select item, next_item, count(*) n from nxt where next_item is not null group by 1, 2"""
)
def next_pairs(spark, d):
    """How often one item directly follows another before the cut."""
    p = _parts(spark, d).filter("not held and prev is not null")
    return p.groupBy(F.col("prev.item").alias("item"), F.col("item").alias("next_item")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {LINES}, seen as (select item, user_id, rn from parts where not held),
    firsts as (select item, min((user_id, rn)) first_at from seen group by item)
    select item, row_number() over (order by first_at) + 1 as id from firsts union all select '<pad>', 0 union all select '<unk>', 1"""
)
def vocab_ids(spark, d):
    """Ids of the items in the order in which users, sorted, first have them; 0 pads, 1 is unknown."""
    p = _parts(spark, d).filter("not held").groupBy("item").agg(F.min(F.struct("user_id", "rn")).alias("at")).select("item", F.col("at.user_id").alias("u"), F.col("at.rn").alias("r"))
    fixed = spark.createDataFrame([("<pad>", 0), ("<unk>", 1)], "item string, id bigint")
    return items.global_rank(p, ["u", "r"]).select("item", (F.col("rank") + 2).alias("id")).unionByName(fixed)


@query(
    f"""with {LINES}, firsts as (select user_id, item, t, rn, row_number() over (partition by user_id, item order by rn) k from parts where not held)
    select user_id, rn, item, rn - 1 as history_len from firsts where k = 1 and rn > 1"""
)
def sft_positions(spark, d):
    """Positions of the walk through the history at which an item is new: training instances with everything before as history."""
    first = timeline.first_visits(_parts(spark, d).filter("not held"))
    return first.filter("first_rn > 1").select("user_id", F.col("first_rn").alias("rn"), "item", (F.col("first_rn") - 1).alias("history_len"))


# --- data quality ----------------------------------------------------------------------------------------------------

_RAW = ("seq", "user_id", "ts", "item", "cat", "lat", "lon", "venue_name")


@query(" union all ".join(f"select '{c}' as column_name, count(*) n_rows, count(*) - count({c}) n_null, round((count(*) - count({c})) / count(*), 9) share_null from checkins" for c in _RAW))
def profile_missing(spark, d):
    return profile.missing(table(spark, d, "checkins"))


@query(" union all ".join(f"select '{c}' as column_name, count({c}) n_present, count(distinct {c}) n_distinct from checkins" for c in _RAW if c not in ("lat", "lon")))
def profile_schema(spark, d):
    return profile.schema(table(spark, d, "checkins").drop("lat", "lon")).drop("kind")


@query(f"with {EVENTS} select count(*) n_events, count(distinct user_id) n_users, count(distinct item) n_items, min(t) first_t, max(t) last_t from ev")
def totals(spark, d):
    e = events(spark, d)
    return e.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item").alias("n_items"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(
    f"""with {EVENTS}, x as (select count(*) c from ev group by user_id, t, item, cat, name, lat, lon), y as (select count(*) c from ev group by user_id, t, item)
    select 'all columns' as by_columns, cast(sum(c - 1) as bigint) n_extra from x union all select 'user, time, item', cast(sum(c - 1) as bigint) from y"""
)
def duplicates(spark, d):
    """Extra copies of rows: equal in everything but arrival, and equal in user, time and item."""
    e = events(spark, d)
    return profile.extra_copies(e.drop("seq"), "all columns").unionByName(profile.extra_copies(e.select("user_id", "t", "item"), "user, time, item"))


@query(
    f"""with {LINES}, x as (select item, t, lag(item) over o p, lag(t) over o pt from line window o as (partition by user_id order by t, item, seq))
    select count(p) n_pairs, count(*) filter (where item = p) n_same_item, count(*) filter (where t - pt < 60) n_under_minute, count(*) filter (where item = p and t - pt < 60) n_both from x"""
)
def consecutive_gaps(spark, d):
    line = timeline.ordered(events(spark, d)).filter("prev is not null")
    same, quick = F.col("item") == F.col("prev.item"), F.col("t") - F.col("prev.t") < 60
    return line.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(same).alias("n_same_item"), F.count_if(quick).alias("n_under_minute"), F.count_if(same & quick).alias("n_both"))


@query(
    f"""with {LINES}, u as (select user_id, count(*) n, row_number() over (order by count(*) desc, user_id) r, count(*) over () n_users from ev group by user_id)
    select (select count(*) from ev) n_events, (select count(*) from u) n_users, (select count(distinct user_id) from parts) n_eligible, (select count(*) from parts) n_eligible_events,
    (select count(*) from held) n_held, (select count(*) filter (where is_novel) from held) n_novel,
    (select round(sum(n) / (select count(*) from ev), 9) from u where r <= floor(n_users / 10)) top_decile_share"""
)
def funnel(spark, d):
    """From all events to novel decisions, and the share of events of the most active tenth of users."""
    e = events(spark, d)
    per_user = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = items.global_rank(per_user.withColumn("neg", -F.col("n")), ["neg", "user_id"])
    users = ranked.agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("n") >= 20).alias("n_eligible"), F.sum(F.when(F.col("n") >= 20, F.col("n"))).alias("n_eligible_events"), F.sum(F.when(F.col("rank") < F.floor(F.col("rows") / 10), F.col("n"))).alias("top"))
    held = timeline.held_out(_kept_parts(spark, d)).agg(F.count(F.lit(1)).alias("n_held"), F.count_if("is_novel").alias("n_novel"))
    return users.crossJoin(F.broadcast(held)).select("n_events", "n_users", "n_eligible", "n_eligible_events", "n_held", "n_novel", F.round(F.col("top") / F.col("n_events"), 9).alias("top_decile_share"))


@query(f"with {EVENTS} select cat, count(*) n, round(count(*) / sum(count(*)) over (), 9) as share from ev where cat is not null group by cat order by n desc, cat limit 20")
def value_counts_share(spark, d):
    """The 20 most frequent categories with their share of the rows that have one."""
    return profile.value_counts(events(spark, d), "cat", 20)


@query(
    f"""with {EVENTS}, u as (select count(*) n from ev group by user_id)
    select count(*) n_users, round(avg(n), 9) mean, round(stddev_samp(n), 9) sd, min(n) least, quantile_cont(n, 0.1) p10, quantile_cont(n, 0.5) p50, quantile_cont(n, 0.9) p90, max(n) most from u"""
)
def describe_events_per_user(spark, d):
    return profile.describe(events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n", "n_users")


@query(f"with {EVENTS}, u as (select user_id, string_agg(distinct p, '+' order by p) combo from (select user_id, case when t >= {Y2017} then 'late' else 'early' end p from ev) group by user_id) select combo, count(*) n_users from u group by combo")
def users_by_period_combo(spark, d):
    e = events(spark, d).withColumn("p", F.when(items.period(F.col("t")) == 1, "late").otherwise("early"))
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("p")), "+").alias("combo")).groupBy("combo").agg(F.count(F.lit(1)).alias("n_users"))


@query(f"with {EVENTS} select case when t >= {Y2017} then 'late' else 'early' end period, count(*) n_events, count(distinct user_id) n_users, count(distinct item) n_items, min(t) first_t, max(t) last_t from ev group by 1")
def period_overview(spark, d):
    e = events(spark, d).withColumn("period", F.when(items.period(F.col("t")) == 1, "late").otherwise("early"))
    return e.groupBy("period").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item").alias("n_items"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"with {EVENTS} select item, count(distinct user_id) n_users from ev group by item having count(distinct user_id) >= 20")
def venue_support_20(spark, d):
    return profile.support(events(spark, d)).filter("n_users >= 20")


@query(f"with {EVENTS} select count(*) n_items from (select item from ev group by item having count(distinct user_id) = 2)")
def items_of_two_users(spark, d):
    return profile.support(events(spark, d)).agg(F.count_if(F.col("n_users") == 2).alias("n_items"))


@query(
    f"""with {EVENTS}, b as (select *, lat between -35 and 65 and lon between -120 and 150 inside from ev where lat is not null and lon is not null)
    select count(*) n_located, count(*) filter (where not inside) n_outside, round(count(*) filter (where not inside) / count(*), 9) share_outside, count(distinct item) filter (not inside) items_outside from b"""
)
def outside_box(spark, d):
    """Events with coordinates outside a box, and their items."""
    b = events(spark, d).filter("lat is not null and lon is not null").withColumn("inside", F.col("lat").between(-35, 65) & F.col("lon").between(-120, 150))
    return b.agg(F.count(F.lit(1)).alias("n_located"), F.count_if(~F.col("inside")).alias("n_outside"), F.round(F.try_divide(F.count_if(~F.col("inside")), F.count(F.lit(1))), 9).alias("share_outside"), F.count_distinct(F.when(~F.col("inside"), F.col("item"))).alias("items_outside"))


@query(
    f"""with {EVENTS}, p as (select {norm('cat')} cat, is_private from categories)
    select coalesce(cast(is_private as varchar), 'unknown') private, count(*) n_events, count(*) filter (where name is null) n_unnamed, count(*) filter (where lat is null) n_unlocated from ev left join p on ev.cat = p.cat group by 1"""
)
def private_and_unnamed(spark, d):
    private = table(spark, d, "categories").select(norm_id("cat").alias("cat"), "is_private")
    e = events(spark, d).join(private, "cat", "left")
    return e.groupBy(F.coalesce(F.col("is_private").cast("string"), F.lit("unknown")).alias("private")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("name").isNull()).alias("n_unnamed"), F.count_if(F.col("lat").isNull()).alias("n_unlocated"))


@query(f"with {EVENTS} select round(round(lat / 0.0045) * 0.0045, 6) + 0.0 lat, round(round(lon / 0.006) * 0.006, 6) + 0.0 lon, count(*) n, count(distinct cat) n_cats from ev where lat is not null and lon is not null group by 1, 2")
def grid_snapping(spark, d):
    """Visits per cell of a grid of about 500 m."""
    snap = lambda c, s: F.round(F.round(F.col(c) / s) * s, 6)
    e = events(spark, d).filter("lat is not null and lon is not null")
    return e.groupBy(snap("lat", 0.0045).alias("lat"), snap("lon", 0.006).alias("lon")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cat").alias("n_cats"))


@query(
    f"""with {EVENTS}, c as (select user_id, cat, count(*) n from ev where cat is not null group by 1, 2), q as (select *, row_number() over (partition by user_id order by n desc, cat) place from c)
    select user_id, cat, n, place from q where place <= 5"""
)
def history_summary(spark, d):
    """The five most frequent categories of each user, ties by name."""
    c = events(spark, d).filter("cat is not null").groupBy("user_id", "cat").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "cat"))).filter("place <= 5")


@query(
    f"""with {EVENTS}, one as (select arg_min(cat, seq) cat, item from ev where cat is not null group by item),
    q as (select cat, item, row_number() over (partition by cat order by item) k from one) select cat, item, k from q where k <= 3 order by k, cat limit 20"""
)
def round_robin(spark, d):
    """Twenty items taken in turn from the categories: each one's first, then each one's second."""
    one = events(spark, d).filter("cat is not null").groupBy("item").agg(F.min_by("cat", "seq").alias("cat"))
    k = F.row_number().over(Window.partitionBy("cat").orderBy("item"))
    return one.withColumn("k", k).filter("k <= 3").orderBy("k", "cat").limit(20).select("cat", "item", "k")
