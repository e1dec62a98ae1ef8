"""Every reader over files of its layout, written from the test tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import ensure_checkpoint_dir, epoch_s
from ..operators import ranking
from ..operators.nearby import is_located
from ..sources import events as src
from ..sources import readers
from ..sources.tables import table
from .sql import CHECKINS, DECISIONS, EVENTS, PREDICTIONS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A folder that executors share, for files of one layout; what a run before left there is overwritten."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/files/{name}"


def _text(lines: DataFrame, path: str, **options) -> str:
    lines.write.mode("overwrite").options(**options).text(path)
    return path


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """user, s (seconds), item, cat, lat, lon, name of the check-ins whose ids hold no tab."""
    c = table(spark, d, "checkins")
    bare = [~F.col(x).contains("\t") for x in ("user_id", "item", "cat")]
    return c.filter(bare[0] & bare[1] & F.coalesce(bare[2], F.lit(True))).select("user_id", epoch_s(c, "ts").alias("s"), "item", F.coalesce("cat", F.lit("")).alias("cat"), "lat", "lon", F.coalesce("venue_name", F.lit("")).alias("name")).filter("s is not null")


_VISITS = "v as (select user_id, cast(floor(epoch(ts)) as bigint) s, item, coalesce(cat, '') cat, lat, lon, coalesce(venue_name, '') as name from checkins where ts is not null and strpos(user_id, chr(9)) = 0 and strpos(item, chr(9)) = 0 and strpos(coalesce(cat, ''), chr(9)) = 0)"


def _utc() -> Column:
    """The clock time in UTC of `s`, whatever the session's zone."""
    return F.to_utc_timestamp(F.timestamp_seconds("s"), F.current_timezone())


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("s", epoch_s(df, "ts")).drop("ts")


@query(f"with {_VISITS} select user_id as user, s, item, cat, round(lat, 6) lat, count(*) n from v group by all")
def read_tab8(spark, d):
    v = _visits(spark, d)
    stamp = F.date_format(_utc(), "EEE MMM dd HH:mm:ss '+0000' yyyy")
    line = F.concat_ws("\t", "user_id", "item", F.lit("c"), "cat", F.coalesce(F.col("lat").cast("string"), F.lit("")), F.coalesce(F.col("lon").cast("string"), F.lit("")), F.lit("0"), stamp)
    e = _seconds(readers.read_tab8(spark, _text(v.select(line), _folder(spark, "tab8"))))
    return e.groupBy("user", "s", "item", "cat", F.round("lat", 6).alias("lat")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_VISITS} select user_id as user, s, item, round(lon, 6) lon, count(*) n from v group by all")
def read_tab5_gzip(spark, d):
    iso = F.date_format(_utc(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws("\t", "user_id", iso, F.coalesce(F.col("lat").cast("string"), F.lit("")), F.coalesce(F.col("lon").cast("string"), F.lit("")), "item")
    e = _seconds(readers.read_tab5(spark, _text(_visits(spark, d).select(line), _folder(spark, "tab5"), compression="gzip")))
    return e.groupBy("user", "s", "item", F.round("lon", 6).alias("lon")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_VISITS} select count(*) n, count(distinct nullif(user_id, '')) n_users, count(distinct nullif(item, '')) n_items, sum(s)::bigint total_s, count(nullif(cat, '')) n_cat, count(nullif(name, '')) n_named from v")
def read_steps_csv(spark, d):
    iso = F.date_format(_utc(), "yyyy-MM-dd HH:mm:ss")
    path = _folder(spark, "steps")
    rows = _visits(spark, d).select("user_id", F.col("item").alias("venue_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "name", F.col("cat").alias("venue_category"), iso.alias("timestamp"))
    rows.write.mode("overwrite").options(quoteAll="true", escape="\"", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path, header=True)
    e = _seconds(readers.resolve(spark, "steps_csv", path))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("n_users"), F.count_distinct("item").alias("n_items"), F.sum("s").alias("total_s"), F.count("cat").alias("n_cat"), F.count("name").alias("n_named"))


@query(f"with {CHECKINS} select seq % 1000 as user, 946684800 + (seq % 75) * 86400 + (seq % 48) * 1800 s, (seq % 200) || '_' || (seq % 190) item, count(*) n from checkin_rows group by all")
def read_grid_csv(spark, d):
    path = _folder(spark, "grid")
    m = lambda k: (F.col("seq") % k).cast("int")
    table(spark, d, "checkins").select(m(1000).alias("uid"), m(75).alias("d"), m(48).alias("t"), m(200).alias("x"), m(190).alias("y")).write.mode("overwrite").csv(path, header=True)
    return _seconds(readers.read_grid_csv(spark, path)).groupBy(F.col("user").cast("bigint").alias("user"), "s", "item").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id as user, k, answer_idx, count(*) n from decisions where user_id is not null group by all")
def read_question_lines(spark, d):
    path = _folder(spark, "questions")
    rows = table(spark, d, "decisions").filter("user_id is not null").select(F.lit("towns").alias("ds"), F.col("user_id").alias("user"), "k", "answer_idx", F.lit("Which?").alias("prompt"), "decision_id")
    readers.write_jsonl(rows, path, ["decision_id"], exclusive=False)
    return readers.read_jsonl(spark, path, readers.QUESTION).groupBy("user", "k", "answer_idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EVENTS} select item, count(*)::double score from ev group by 1")
def read_score_map(spark, d):
    """One JSON object of all items' scores. Such a file is one value; it is for tables of a bounded size."""
    counts = src.events(spark, d).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("score"))
    one = counts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("item", "score"))).alias("scores"))).alias("value"))
    return readers.read_object_map(spark, _text(one.coalesce(1), _folder(spark, "scores")))


@query(f"with {PREDICTIONS} select user_id as user, arm, cast(decision_id % 3 as int) seed, 'test' split, count(*) n, round(sum(logprobs[1]), 6) total from pred group by all")
def read_score_folders(spark, d):
    root = _folder(spark, "arms")
    p = src.predictions(spark, d).select(F.col("user_id").alias("user"), "answer_idx", F.col("logprobs").alias("scores"), "arm", (F.col("decision_id") % 3).cast("int").alias("seed"))
    # files of three arms times three seeds, moved to the layout's names
    p.write.mode("overwrite").partitionBy("arm", "seed").json(f"{root}-raw")
    _lay_out(spark, f"{root}-raw", root)
    r = readers.read_score_folders(spark, root)
    return r.groupBy("user", "arm", "seed", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("scores")[0]), 6).alias("total"))


def _lay_out(spark: SparkSession, raw: str, root: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(root), True)
    for arm in fs.listStatus(path(raw)):
        if not arm.isDirectory():
            continue
        for seed in fs.listStatus(arm.getPath()):
            to = f"{root}/{arm.getPath().getName().removeprefix('arm=')}/s{seed.getPath().getName().removeprefix('seed=')}"
            fs.mkdirs(path(to))
            for k, f in enumerate(x for x in fs.listStatus(seed.getPath()) if x.getPath().getName().endswith(".json")):
                fs.rename(f.getPath(), path(f"{to}/scores_{k}_test.jsonl"))


@query("with r as (select event_type, count(*)::double c, count(value)::double v from events where event_type is not null group by 1) select 'requests_total' metric, event_type kind, c as value from r union all select 'values_total', event_type, v from r")
def read_metric_page(spark, d):
    r = table(spark, d, "events").filter("event_type is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("c"), F.count("value").alias("v"))
    line = lambda name, c: F.concat(F.lit(name + '{kind="'), "event_type", F.lit('"} '), F.col(c).cast("string"))
    lines = r.select(F.explode(F.array(F.lit("# HELP requests_total Requests."), line("requests_total", "c"), line("values_total", "v"))).alias("value"))
    page = spark.read.text(_text(lines, _folder(spark, "metrics")))
    return readers.read_metric_lines(page).select("metric", F.col("labels")["kind"].alias("kind"), "value")


@query("select event_type endpoint, count(*) n, round(sum(value), 5) ms from events where event_type is not null group by 1")
def read_log(spark, d):
    """A log of JSON lines among others that are no objects."""
    e = table(spark, d, "events").filter("event_type is not null")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("rid"), F.col("event_type").alias("endpoint"), F.lit(200).alias("status"), F.col("value").alias("ms")))
    lines = e.select(F.explode(F.array(line, F.concat(F.lit("started "), F.col("event_id").cast("string")))).alias("value"))
    log = readers.read_log_lines(spark.read.text(_text(lines, _folder(spark, "log"))))
    return log.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms"), 5).alias("ms"))


@query("with p as (select floor(lat * 10)::bigint y, floor(lon * 10)::bigint x, count(*) n from checkins where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0) group by 1, 2) select y || ':' || x as name, ring, case ring when 0 then 5 else 4 end::int n_points from p cross join (select unnest([0, 1])::int ring)")
def read_outline_file(spark, d):
    """A GeoJSON collection of an outline with a hole for every tenth of a degree with check-ins; one value, of a bounded size."""
    c = table(spark, d, "checkins").filter(is_located(F.col("lat"), F.col("lon"))).select(F.floor(F.col("lat") * 10).alias("y"), F.floor(F.col("lon") * 10).alias("x")).distinct()
    at = lambda dx, dy: F.array((F.col("x") + dx) / 10, (F.col("y") + dy) / 10)
    rings = F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)), F.array(at(0.4, 0.4), at(0.6, 0.4), at(0.5, 0.6), at(0.4, 0.4)))
    feature = F.struct(F.struct(F.concat_ws(":", "y", "x").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    one = c.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    r = readers.read_outlines(spark, _text(one.coalesce(1), _folder(spark, "outlines")))
    return r.select("name", "ring", F.size("points").alias("n_points"))


@query(f"with {PREDICTIONS} select arm, round(avg(coalesce(pick = answer_idx, false)::int), 9) mean from pred group by 1")
def read_summaries(spark, d):
    """Means written down in a nested summary and read back."""
    m = src.predictions(spark, d).groupBy("arm").agg(ranking.share(ranking.is_right()).alias("mean"))
    entry = F.struct(F.col("arm").alias("k"), F.struct(F.struct("mean").alias("Hit@1")).alias("v"))
    one = m.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("value"))  # as many entries as arms
    path = _text(one.coalesce(1), _folder(spark, "summary"))
    arms = [r.arm for r in m.select("arm").collect()]
    out = None
    for arm in sorted(arms):
        r = readers.read_summary(spark, path, arm).select(F.lit(arm).alias("arm"), "mean")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"with {DECISIONS} select decision_id, k from dec where user_id is not null order by decision_id limit 100")
def scan_limit(spark, d):
    """The first hundred rows of a scan, in the file's order."""
    rows = src.decisions(spark, d).filter("user_id is not null").select("decision_id", "k")
    return readers.limited(rows, 100, "decision_id")
