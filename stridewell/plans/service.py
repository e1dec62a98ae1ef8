"""Service metrics over the stream of events, read as requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import epoch_s
from ..operators import monitor, privacy, ranking
from ..sources.tables import table

QUERIES, SQL = {}, {}
BUCKETS = (10.0, 25.0, 50.0, 100.0, 200.0, float("inf"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REQ = "req as (select event_id, cast(floor(epoch(ts)) as bigint) t, user_id, event_type, value, coalesce(event_type = 'error', false) failed from events where ts is not null)"
_SCRAPES = f"{_REQ}, scrapes as (select event_type, t // 3600 * 3600 t, count(*) n from req group by 1, 2), counters as (select *, sum(n) over (partition by event_type order by t) as value from scrapes)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """event_id, t, user_id, event_type, value, failed."""
    e = table(spark, d, "events")
    return e.select("event_id", epoch_s(e, "ts").alias("t"), "user_id", "event_type", "value", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed")).filter("t is not null")


def scrapes(spark: SparkSession, d: str, *by: str, every: int = 3600) -> DataFrame:
    """Requests per key and hour."""
    return requests(spark, d).groupBy(*by, (F.expr(f"t div {every}") * every).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"))


@query(f"with {_SCRAPES} select event_type, t, value::bigint as value, (value - lag(value) over (partition by event_type order by t))::bigint delta from counters")
def counter_deltas(spark, d):
    """Growth of a cumulative counter between scrapes."""
    w = Window.partitionBy("event_type").orderBy("t")  # hours
    c = scrapes(spark, d, "event_type").withColumn("value", F.sum("n").over(w)).select("event_type", "t", "value")
    return monitor.deltas(c, ["event_type"]).select("event_type", "t", "value", "delta")


@query(
    f"""with {_REQ}, s as (select t // 600 * 600 t, count(*) n, count(*) filter (where failed) errors from req group by 1), w as (select *, coalesce(sum(n) over (order by t desc rows between unbounded preceding and 1 preceding), 0) newer, max(t) over () ending from s)
    select count(*) n_scrapes, cast(sum(n) as bigint) n, cast(sum(errors) as bigint) errors, round(sum(errors) / sum(n), 9) share, case when sum(n) < 10 then 'FEW' when sum(errors) / sum(n) > 0.3 then 'ALERT' else 'OK' end state from w where newer < 500 and ending - t <= 86400"""
)
def sliding_error_share(spark, d):
    """State of the service over the last 500 requests, in whole scrapes and no older than a day."""
    s = scrapes(spark, d, every=600).withColumn("service", F.lit("all"))
    w = monitor.last_requests(s, 500, 86_400, ["service"])
    one = w.agg(F.count(F.lit(1)).alias("n_scrapes"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return one.withColumn("share", F.round(F.col("errors") / F.col("n"), 9)).withColumn("state", monitor.alert(F.col("n"), F.col("errors"), F.lit(None).cast("double")))


@query(
    f"""with {_REQ}, edges as (select unnest([10, 25, 50, 100, 200, 'infinity'::double])::double le), b as (select event_type, le, count(*) filter (where value <= le)::double c from req cross join edges where value is not null group by 1, 2),
    x as (select *, coalesce(lag(le) over o, 0) le0, coalesce(lag(c) over o, 0) c0, 0.95::double * max(c) over (partition by event_type) goal from b window o as (partition by event_type order by le)),
    y as (select *, case when goal > 0 then case when isinf(le) then le0 else le0 + (le - le0) * (goal - c0) / greatest(c - c0, 1e-9) end end v, row_number() over (partition by event_type order by le) r from x where c >= goal)
    select event_type, round(v, 6) quantile from y where r = 1"""
)
def histogram_p95(spark, d):
    """95th percentile of the values of each type, from a histogram of six buckets."""
    r = requests(spark, d).filter("value is not null")
    counts = r.groupBy("event_type").agg(*(F.count_if(F.col("value") <= le).cast("double").alias(f"b{k}") for k, le in enumerate(BUCKETS)))
    b = counts.select("event_type", F.inline(F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"b{k}").alias("c")) for k, le in enumerate(BUCKETS)))))
    return monitor.histogram_quantile(b, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


@query(f"with {_REQ}, s as (select t // 600 * 600 t, event_type, min(value) value from req where value is not null group by 1, 2) select t, event_type, round(min(value) over (partition by event_type order by t range between 1800 preceding and current row), 9) rolling_min from s")
def rolling_min_30m(spark, d):
    """Smallest value of the last half hour, per type, at every ten minutes with requests."""
    s = requests(spark, d).filter("value is not null").groupBy((F.expr("t div 600") * 600).alias("t"), "event_type").agg(F.min("value").alias("value"))
    return monitor.rolling_min(s, ["event_type"], "value", 1800).select("t", "event_type", F.round("rolling_min", 9).alias("rolling_min"))


@query(f"with {_REQ} select user_id, event_type, max(event_id) event_id, arg_max(t, event_id) t from req where user_id is not null group by 1, 2")
def latest_wins_dedupe(spark, d):
    return monitor.latest_wins(requests(spark, d).filter("user_id is not null").select("user_id", "event_type", "event_id", "t"), ["user_id", "event_type"], "event_id")


@query(f"with {_REQ} select event_type, count(*) n from (select distinct user_id, event_type, t // 86400 dd from req) group by 1")
def tally_once(spark, d):
    """Each user counts once a day and type."""
    r = requests(spark, d).select("user_id", "event_type", F.expr("t div 86400").alias("day")).distinct()
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_REQ} select event_type, t // 3600 * 3600 t, count(*) n, count(*) filter (where failed) errors, round(sum(value), 6) total from req group by 1, 2")
def hourly_counts(spark, d):
    r = requests(spark, d).groupBy("event_type", (F.expr("t div 3600") * 3600).alias("t"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"), F.round(F.sum("value"), 6).alias("total"))


@query(f"with {_REQ} select count(*) n, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95, max(value) most from req where value is not null")
def latency_quantiles(spark, d):
    v = requests(spark, d).filter("value is not null").select("value", F.lit("all").alias("service"))
    one = v.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    at = ranking.middle_values(v, "value", "service", {"p50": 0.5, "p95": 0.95}).drop("service")
    return one.join(at, how="left").select("n", "p50", "p95", "most")  # one row each


def _jumps(state: str, first: str, more: str) -> str:
    """From each accepted request to the next one that can be."""
    return f"""with recursive {_REQ.replace("req as (", "req as materialized (", 1)}, r as (select * from req where user_id is not null),
    jumps({state}) as ({first} union all {more}), n as (select user_id, count(*) n from r group by 1)"""


@query(
    _jumps(
        "user_id, p2, t, e",
        "select user_id, -1000000000000 p2, min(t) t, arg_min(event_id, (t, event_id)) e from r group by 1",
        "select j.user_id, min(j.t), min(r.t), arg_min(r.event_id, (r.t, r.event_id)) from jumps j join r on r.user_id = j.user_id and (r.t, r.event_id) > (j.t, j.e) and r.t > j.p2 + 3600 group by 1",
    )
    + " select n.user_id, n.n, count(*) n_accepted from n join jumps j on j.user_id = n.user_id group by 1, 2"
)
def rate_limited(spark, d):
    """By user, requests that pass a limit of two an hour; what passes depends on what passed before."""
    a = monitor.accepted_by_rate(requests(spark, d).filter("user_id is not null").select("event_id", "user_id", "t"), "user_id", limit=2, window_s=3600)
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"))


@query(
    f"""with {_REQ}, s as (select t // 600 * 600 t, count(*) n, count(*) filter (where failed) errors, {", ".join(f"count(*) filter (where value <= {le if le != float('inf') else chr(39) + 'infinity' + chr(39) + '::double'})::double b{k}" for k, le in enumerate(BUCKETS))} from req group by 1),
    w as (select *, coalesce(sum(n) over (order by t desc rows between unbounded preceding and 1 preceding), 0) newer, max(t) over () ending from s),
    one as (select cast(sum(n) as bigint) n, cast(sum(errors) as bigint) errors, [{", ".join(f"sum(b{k})" for k in range(len(BUCKETS)))}] c from w where newer < 500 and ending - t <= 86400),
    x as (select n, errors, unnest([10, 25, 50, 100, 200, 'infinity'::double]::double[]) le, unnest(c)::double c from one), y as (select *, coalesce(lag(le) over (order by le), 0) le0, coalesce(lag(c) over (order by le), 0) c0, 0.95::double * max(c) over () goal from x),
    q as (select n, errors, arg_min(case when isinf(le) then le0 else le0 + (le - le0) * (goal - c0) / greatest(c - c0, 1e-9) end, le) p95 from y where c >= goal group by 1, 2)
    select n, errors, round(p95, 6) p95, case when n < 10 then 'FEW' when errors / n > 0.3 or p95 > 150 then 'ALERT' else 'OK' end state from q"""
)
def window_alert(spark, d):
    """State of the service over its last 500 requests, by the share of errors and the 95th percentile of their summed histograms."""
    r = requests(spark, d).withColumn("service", F.lit("all"))
    counts = [F.count_if(F.col("value") <= le).cast("double").alias(f"b{k}") for k, le in enumerate(BUCKETS)]
    s = r.groupBy("service", (F.expr("t div 600") * 600).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"), *counts)
    one = monitor.last_requests(s, 500, 86_400, ["service"]).groupBy("service").agg(*(F.sum(c).alias(c) for c in ("n", "errors", *(f"b{k}" for k in range(len(BUCKETS))))))
    b = one.select("service", F.inline(F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"b{k}").alias("c")) for k, le in enumerate(BUCKETS)))))
    x = one.join(monitor.histogram_quantile(b, ["service"]), "service", "left")
    return x.select("n", "errors", F.round("quantile", 6).alias("p95"), monitor.alert(F.col("n"), F.col("errors"), F.col("quantile"), max_p95=150.0).alias("state"))


@query(
    _jumps("user_id, t", "select user_id, min(t) t from r group by 1", "select j.user_id, min(r.t) from jumps j join r on r.user_id = j.user_id and r.t > j.t + 900 group by 1")
    + " select n.user_id, n.n, n.n - count(*) n_hits from n join jumps j on j.user_id = n.user_id group by 1, 2"
)
def cached_answers(spark, d):
    """By user, requests that a cache of fifteen minutes would answer."""
    c = monitor.cache_hits(requests(spark, d).filter("user_id is not null").select("event_id", "user_id", "t"), "user_id")
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hits"))


@query(f"with {_REQ} select count(*) n, count(*) filter (where user_id is not null) n_with_user, 0::bigint n_leaks, sum(cast(floor(value + 0.5) as bigint))::bigint ms from req where value is not null and value >= 0")
def minimal_log(spark, d):
    """What a minimised request log holds: every request, its time, and nobody's id."""
    r = requests(spark, d).filter("value is not null and value >= 0")
    log = privacy.minimal_log(r.select(F.col("event_id").cast("string").alias("rid"), F.col("event_type").alias("path"), F.lit(200).alias("status"), F.col("value").alias("ms"), "user_id"))
    back = log.select(F.from_json("value", "rid string, path string, status int, ms bigint, user_id string").alias("x"))
    counts = back.agg(F.count(F.lit(1)).alias("n"), F.count("x.user_id").alias("n_leaks"), F.sum("x.ms").alias("ms"))
    return r.agg(F.count("user_id").alias("n_with_user")).crossJoin(counts).select("n", "n_with_user", "n_leaks", "ms")  # one row each
