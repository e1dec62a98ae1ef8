"""Problems 3, 4 and 5: nearby venues, sessions, features per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, nearby, regions
from ..operators.sessions import sessions
from ..sources.tables import table
from .sql import CHECKINS, norm

RADIUS_KM = 0.080
GAP_S = 14_400
#: 2018-01-01 00:00:00 to 2018-07-01 00:00:00
HALF_YEAR = (1_514_764_800, 1_530_403_200)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearby.venues_near_candidates(table(spark, d, "checkins"), table(spark, d, "decisions"), RADIUS_KM).select("item_a", "item_b")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For each venue with others close by: how many, and the distance of the closest in metres."""
    pairs = nearby.venues_near_candidates(table(spark, d, "checkins"), table(spark, d, "decisions"), RADIUS_KM)
    both = pairs.select(F.explode(F.array("item_a", "item_b")).alias("item"), "km")
    return both.groupBy("item").agg(F.count(F.lit(1)).alias("n_near"), F.round(F.min("km") * 1000, 3).alias("nearest_m"))


#: Outlines in thousandths of a degree around a point: a ring with bays, and a hole in it.
_RING = ((40, 0), (20, 15), (25, 40), (0, 20), (-35, 38), (-20, 5), (-42, -6), (-18, -22), (-12, -45), (6, -20), (33, -36), (22, -10))
_HOLE = ((10, 0), (0, 9), (-8, 0), (0, -11))


def town_regions(spark: SparkSession, d: str) -> DataFrame:
    """region, rings: an outline with a hole in every tenth of a degree square that has venues, as GeoJSON has them ([lon, lat])."""
    places = nearby.first_places(table(spark, d, "checkins"))
    squares = places.select(F.floor(F.col("lat") * 10).alias("y"), F.floor(F.col("lon") * 10).alias("x")).distinct()
    ring = lambda points: F.array(*(F.array((F.col("x") + F.lit(0.5 + dx / 100)) / 10, (F.col("y") + F.lit(0.5 + dy / 100)) / 10) for dx, dy in points))
    return squares.select(F.concat_ws(":", "y", "x").alias("region"), F.array(ring(_RING), ring(_HOLE)).alias("rings"))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region that contains each venue, of those that lie in one."""
    return regions.containing_regions(nearby.first_places(table(spark, d, "checkins")), town_regions(spark, d), levels=(10, 13, 16))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "checkins"), gap_s=GAP_S).select("user_id", "start_s", "end_s")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "checkins"), gap_s=GAP_S)


def event_types(spark: SparkSession, d: str) -> list[str]:
    """The listed categories and any others that check-ins have, so that none of them ends up among (other)."""
    return features.type_dictionary(table(spark, d, "categories").select("cat").unionByName(table(spark, d, "checkins").select("cat")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    types = event_types(spark, d)
    vectors = features.sparse_vectors(table(spark, d, "checkins"), types, distinct_by=("item",), between=HALF_YEAR)
    return features.entries(vectors, types).filter("n >= 3").select("user_id", "cat")


def p5_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Over all time, in long form: different check-ins, rows delivered, last time."""
    types = event_types(spark, d)
    vectors = features.sparse_vectors(table(spark, d, "checkins"), types, distinct_by=("item",))
    return features.entries(vectors, types)


def all_p5_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same with check-ins without an item, which count in total and last time only."""
    types = event_types(spark, d)
    vectors = features.sparse_vectors(table(spark, d, "checkins"), types, distinct_by=("item",), keep_unidentified=True)
    return features.entries(vectors, types)


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per account, with three columns per category; check-ins without an item count in total and last time."""
    types = event_types(spark, d)
    return features.expand(features.sparse_vectors(table(spark, d, "checkins"), types, distinct_by=("item",), keep_unidentified=True), types)


QUERIES = {f.__name__: f for f in (p3_found, p3_neighbours, p3_regions, p4_found, p4_sessions, p5_found, p5_vectors, all_p5_vectors, p5_features)}

_PLACES = f"""{CHECKINS},
places as (
  select item, arg_min(lat, seq) lat, arg_min(lon, seq) lon from checkin_rows
  where item is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)
    and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)
  group by item),
asked as (select distinct {norm('c')} item from (select unnest(candidates) c from decisions)),
spots as (select p.*, a.item is not null asked, cast(floor(p.lat / 0.001) as bigint) band from places p left join asked a on p.item = a.item),
pairs as (
  select least(a.item, b.item) item_a, greatest(a.item, b.item) item_b,
    2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) km
  from spots a join (select *, unnest([band - 1, band, band + 1]) near from spots) b on a.band = b.near
  where a.item < b.item and (a.asked or b.asked)),
near_pairs as (select * from pairs where km <= 0.080)"""

_SESSIONS = f"""{CHECKINS},
marked as (select user_id, t, seq, coalesce(cast(t - lag(t) over (partition by user_id order by t, seq) > 14400 as int), 1) fresh from checkin_rows where user_id is not null and t is not null),
counted as (select user_id, t, sum(fresh) over (partition by user_id order by t, seq rows unbounded preceding) k from marked),
sessions as (select user_id, min(t) start_s, max(t) end_s, max(t) - min(t) duration_s, count(*) n_events from counted group by user_id, k)"""

_VISITS = f"{CHECKINS}, visits as (select user_id, cat, t, item, count(*) n from checkin_rows where user_id is not null and cat is not null and t is not null and item is not null group by all)"



def _ring_sql(points: tuple) -> str:
    """Edges (x1, y1, x2, y2) of a ring around the middle of a square, in sides of it from its corner."""
    return ", ".join(f"({0.5 + a / 100!r}, {0.5 + b / 100!r}, {0.5 + c / 100!r}, {0.5 + e / 100!r})" for (a, b), (c, e) in zip(points, (*points[1:], points[0])))


_REGIONS = f"""{_PLACES.split("asked as")[0].rstrip().rstrip(",")},
squares as (select distinct floor(lat * 10)::bigint y, floor(lon * 10)::bigint x from places),
outline(x1, y1, x2, y2) as (values {_ring_sql(_RING)}, {_ring_sql(_HOLE)}),
edges as (select y, x, (x + x1) / 10 x1, (y + y1) / 10 y1, (x + x2) / 10 x2, (y + y2) / 10 y2 from squares cross join outline),
crossed as (select p.item, e.y, e.x, count(*) n from places p join edges e on floor(p.lat * 10) = e.y and floor(p.lon * 10) = e.x
  where ((e.y1 > p.lat) <> (e.y2 > p.lat)) and p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 group by 1, 2, 3)"""

SQL = {
    "p3_regions": f"with {_REGIONS} select item, y || ':' || x region from crossed where n % 2 = 1",
    "p3_found": f"with {_PLACES} select item_a, item_b from near_pairs",
    "p3_neighbours": f"with {_PLACES} select item, count(*) n_near, round(min(km) * 1000, 3) nearest_m from (select unnest([item_a, item_b]) item, km from near_pairs) group by item",
    "p4_found": f"with {_SESSIONS} select user_id, start_s, end_s from sessions",
    "p4_sessions": f"with {_SESSIONS} select * from sessions",
    "p5_found": f"with {_VISITS} select user_id, cat from visits where t >= {HALF_YEAR[0]} and t < {HALF_YEAR[1]} group by user_id, cat having count(*) >= 3",
    "p5_vectors": f"""with {_VISITS} select user_id, cat, count(*) n, cast(sum(n) as double) total, max(t) last_s from visits group by 1, 2""",
    "all_p5_vectors": f"""with {CHECKINS} select user_id, cat, count(distinct (t, item)) filter (item is not null) n, cast(count(*) as double) total, max(t) last_s from checkin_rows where user_id is not null and cat is not null and t is not null group by 1, 2""",
}
