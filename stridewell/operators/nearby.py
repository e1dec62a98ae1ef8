"""Points near other points, by covering each search disc with grid cells.

The globe is cut into rows of the search radius' height and every row into cells of about the same width, so cells keep
their size towards the poles and wrap at the date line. A disc is covered by the (at most a dozen) cells it can touch,
and an equi-join on the cell finds the points there. The cover adapts to the points: a cell that holds many of them is
cut into smaller cells on both sides of the join, again and again until a cell holds few or is as small as can be; what
still crowds there is spread over parts. A cell that lies wholly in the disc is interior: its points are accepted as
they are, at any depth. Only points in cells on the disc's edge take the exact distance test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import norm_id, require_columns, stored

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null where a coordinate is null or NaN."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.nanvl(F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a))), F.lit(None).cast("double"))


def is_located(lat: Column, lon: Column) -> Column:
    """Coordinates that can be a place: not null or NaN, in range, not both zero."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def first_places(events: DataFrame, item: str = "item", lat: str = "lat", lon: str = "lon", seq: str = "seq") -> DataFrame:
    """item, lat, lon: where each item's located row with the smallest `seq` is."""
    require_columns(events, item, lat, lon, seq)
    return (
        events.filter(is_located(F.col(lat), F.col(lon)))
        .select(norm_id(item).alias("item"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(seq).alias("seq"))
        .filter("item is not null and seq is not null")
        .groupBy("item")
        .agg(F.min_by("lat", "seq").alias("lat"), F.min_by("lon", "seq").alias("lon"))  # of the same row; numbers aggregate by hash, a struct would be sorted
    )


class _Grid:
    """SQL expressions of the grid for one radius."""

    def __init__(self, radius_km: float, sub: int):
        self.h = math.degrees(radius_km / EARTH_KM)  # height of a row in degrees
        self.r, self.sub = radius_km, sub
        self.rows = max(1, math.ceil(180 / self.h))

    def row(self, lat: str) -> str:
        return f"least(cast(floor(({lat} + 90D) / {self.h!r}D) as bigint), {self.rows - 1}L)"

    def columns(self, row: str) -> str:
        """Cells in a row: as many of at least the row's height as its side nearer the equator has room for."""
        south = f"({row} * {self.h!r}D - 90D)"
        nearest = f"(case when {south} > 0D then {south} when {south} + {self.h!r}D < 0D then {south} + {self.h!r}D else 0D end)"
        return f"greatest(1L, cast(floor(360D * cos(radians({nearest})) / {self.h!r}D) as bigint))"

    @staticmethod
    def key(row: str, col: str) -> str:
        return f"({row} * 4294967296L + {col})"


def near_pairs(points: DataFrame, radius_km: float, dense: int = 64, sub: int = 4, depth: int = 6) -> DataFrame:
    """Pairs (item_a, item_b, km) with item_a < item_b at most `radius_km` apart, at least one of them a query.

    `points` has one row per item: item, lat, lon and is_query. Cells with more than `dense` points are cut into
    sub x sub smaller ones, at most `depth` times; a smallest cell that is crowded still is spread over parts of about
    `dense` points. Rows without item or place are left out; two items at one place are 0 km apart; an empty table gives
    no pairs; other columns are ignored.
    """
    require_columns(points, "item", "lat", "lon", "is_query")
    if not 0 < radius_km <= 1000:
        raise ValueError("radius_km must lie in (0, 1000]")
    g = _Grid(radius_km, sub)
    n = sub * sub
    places = points.filter("item is not null").filter(is_located(F.col("lat"), F.col("lon"))).select("item", "lat", "lon", F.coalesce("is_query", F.lit(False)).alias("is_query"))
    placed = (
        places.withColumn("row", F.expr(g.row("lat")))
        .withColumn("n_cols", F.expr(g.columns("row")))
        .withColumn("x", F.expr("(lon + 180D) / 360D * n_cols"))
        .withColumn("col", F.expr("cast(floor(x) as bigint) % n_cols"))
        .withColumn("cell", F.expr(g.key("row", "col")))
        .select("item", "lat", "lon", "is_query", "cell", F.lit(1).cast("bigint").alias("path"), F.expr(f"(lat + 90D) / {g.h!r}D - row").alias("fy"), F.expr("x - floor(x)").alias("fx"))
    )
    placed = stored(placed)
    cover = (
        placed.filter("is_query")
        .select("item", "lat", "lon")
        # degrees of longitude that the disc reaches to either side; all of them near a pole
        .withColumn("reach", F.expr(f"case when abs(lat) + {g.h!r}D >= 90D then 180D else degrees(asin(least(1D, sin({radius_km / EARTH_KM!r}D) / cos(radians(lat))))) * 1.000000001D end"))
        .withColumn("row", F.explode(F.expr(f"sequence({g.row(f'greatest(-90D, lat - {g.h * 1.000000001!r}D)')}, {g.row(f'least(90D, lat + {g.h * 1.000000001!r}D)')})")))
        .withColumn("n_cols", F.expr(g.columns("row")))
        .withColumn("c0", F.expr("cast(floor((lon - reach + 180D) / 360D * n_cols) as bigint)"))
        .withColumn("c1", F.expr("cast(floor((lon + reach + 180D) / 360D * n_cols) as bigint)"))
        .withColumn("c", F.explode(F.expr("case when c1 - c0 + 1 >= n_cols then sequence(0L, n_cols - 1) else sequence(c0, c1) end")))
        .withColumn("cell", F.expr(g.key("row", "pmod(c, n_cols)")))
        .select("item", "lat", "lon", "row", "n_cols", "c", "cell", F.lit(1).cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("iy"), F.lit(0).cast("bigint").alias("ix"), F.lit(False).alias("interior"))
    )
    cover = _touching(cover, g, radius_km, 0)
    found: list[tuple[DataFrame, DataFrame]] = []  # leaves of either side, level by level
    for level in range(depth + 1):
        crowded = placed.groupBy("cell", "path").count().filter(F.col("count") > dense)
        if level == depth:
            salts = crowded.select("cell", "path", F.ceil(F.col("count") / dense).alias("salts"))
            spread = F.coalesce("salts", F.lit(1).cast("bigint"))
            right = placed.join(salts, ["cell", "path"], "left").withColumn("salt", F.pmod(F.xxhash64("item"), spread))
            left = cover.join(salts, ["cell", "path"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), spread - 1)))
            found.append((left, right))
            break
        crowded = stored(crowded.select("cell", "path", F.lit(True).alias("cut")))
        if crowded.isEmpty():
            found.append((cover.withColumn("salt", F.lit(0).cast("bigint")), placed.withColumn("salt", F.lit(0).cast("bigint"))))
            break
        here, there = placed.join(crowded, ["cell", "path"], "left"), cover.join(crowded, ["cell", "path"], "left")
        if level:
            here, there = stored(here), stored(there)
        leaf = lambda side: side.filter("cut is null").withColumn("salt", F.lit(0).cast("bigint"))
        found.append((leaf(there), leaf(here)))
        k = sub ** (level + 1)
        at = lambda f: f"least({k - 1}L, cast(floor({f} * {k}) as bigint))"
        placed = here.filter("cut").withColumn("path", F.expr(f"path * {n} + ({at('fy')} % {sub}) * {sub} + {at('fx')} % {sub}")).drop("cut")
        cover = (
            there.filter("cut")
            .withColumn("part", F.explode(F.expr(f"sequence(0, {n - 1})")))
            .withColumn("path", F.expr(f"path * {n} + part"))
            .withColumn("iy", F.expr(f"iy * {sub} + part div {sub}"))
            .withColumn("ix", F.expr(f"ix * {sub} + part % {sub}"))
            .drop("cut", "part")
        )
        cover = _touching(cover, g, radius_km, level + 1)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    keys = ["cell", "path", "salt"]
    right = _all_of([r.select(*keys, F.col("item").alias("p_item"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("is_query").alias("p_query")) for _, r in found])
    left = _all_of([x.select(*keys, "item", "lat", "lon", "interior") for x, _ in found])
    hits = left.join(right, keys).filter("item <> p_item and (not p_query or item < p_item)").filter(F.col("interior") | (km <= radius_km))
    return hits.select(F.least("item", "p_item").alias("item_a"), F.greatest("item", "p_item").alias("item_b"), km.alias("km"))


def _all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _touching(cover: DataFrame, g: _Grid, radius_km: float, level: int) -> DataFrame:
    """Of the cover's cells those that their disc can touch, with `interior` set where it holds the whole cell. What lies in
    an interior cell is interior too.
    """
    k = g.sub**level
    rect = (
        cover.withColumn("south", F.expr(f"(row + iy / {float(k)!r}D) * {g.h!r}D - 90D"))
        .withColumn("north", F.expr(f"south + {g.h / k!r}D"))
        .withColumn("west", F.expr(f"(c + ix / {float(k)!r}D) / n_cols * 360D - 180D"))
        .withColumn("east", F.expr(f"west + 360D / n_cols / {k}"))
    )
    # beyond the disc for sure: too far by latitude, or from the nearer meridian
    low = F.expr(f"radians(greatest(0D, south - lat, lat - north)) * {EARTH_KM!r}D")
    side = F.expr(f"case when {level} = 0 or n_cols < 8 then 0D else asin(cos(radians(lat)) * sin(radians(least(90D, greatest(0D, west - lon, lon - east))))) * {EARTH_KM!r}D end")
    corners = [haversine_km(F.col("lat"), F.col("lon"), F.col(a), F.col(b)) for a in ("south", "north") for b in ("west", "east")]
    inside = (F.greatest(*corners) <= radius_km * (1 - 1e-9)) & (F.col("n_cols") >= 8)
    near = F.col("interior") | ((low <= radius_km * (1 + 1e-6)) & (side <= radius_km * (1 + 1e-6)))
    return rect.filter(near).withColumn("interior", F.col("interior") | inside).drop("south", "north", "west", "east")


def venues_near_candidates(checkins: DataFrame, decisions: DataFrame, radius_km: float = 0.080, candidates: str = "candidates", **tuning) -> DataFrame:
    """near_pairs of the venues of `checkins`, with the venues in any list of `candidates` as queries."""
    require_columns(decisions, candidates)
    asked = decisions.select(F.explode(candidates).alias("c")).select(norm_id("c").alias("item")).filter("item is not null").distinct().withColumn("is_query", F.lit(True))
    places = first_places(checkins).join(asked, "item", "left")
    return near_pairs(places, radius_km, **tuning)
