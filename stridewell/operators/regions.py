"""The region that contains each point, by adaptive coverage of the regions with grid cells.

A region's outline is covered from coarse cells to finer ones: a cell that no edge touches is wholly inside or outside
and needs no more; a cell that an edge touches is cut into smaller ones, down to the finest level. The points join the
cells on level and cell number. In a cell that lies inside, they are accepted at once. Only in a cell on the outline
are they tested exactly, against the few edges that lie beside that cell, which come with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import require_columns
from .nearby import is_located
from .ranked import spread_join

_CELLS = "region string, level bigint, cell bigint, interior boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
_EDGES = pa.list_(pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")]))


def _edges(rings: list) -> np.ndarray:
    """x1, y1, x2, y2 of all edges of the rings; rings are closed where they are not."""
    out = []
    for ring in rings or []:
        p = np.array([q[:2] for q in ring or [] if q is not None and len(q) >= 2 and None not in q[:2]], dtype=float)
        if len(p) >= 3:
            q = np.roll(p, -1, axis=0)
            out.append(np.hstack([p, q]))
    e = np.vstack(out) if out else np.zeros((0, 4))
    return e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]


def _inside(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Even-odd rule; a point on an edge belongs to the side that the half-open comparison gives it to."""
    up = (e[:, 1] > y[:, None]) != (e[:, 3] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (e[:, 2] - e[:, 0]) * (y[:, None] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return (up & (x[:, None] < cross)).sum(1) % 2 == 1


def _touched(x0: np.ndarray, y0: np.ndarray, w: float, h: float, e: np.ndarray) -> np.ndarray:
    """Cells x edges: whether the edge touches the cell, borders included."""
    cx, cy = (x0 + w / 2)[:, None], (y0 + h / 2)[:, None]
    mx, my = (e[:, 0] + e[:, 2]) / 2 - cx, (e[:, 1] + e[:, 3]) / 2 - cy
    dx, dy = np.abs(e[:, 2] - e[:, 0]) / 2, np.abs(e[:, 3] - e[:, 1]) / 2
    eps = 1e-12
    a, b = np.abs(mx) <= w / 2 + dx + eps, np.abs(my) <= h / 2 + dy + eps
    side = np.abs(mx * (e[:, 3] - e[:, 1]) - my * (e[:, 2] - e[:, 0])) <= w * dy + h * dx + eps
    return a & b & side


def cover(rings: list, levels: tuple[int, ...]) -> list[tuple[int, int, bool, list]]:
    """(level, cell, interior, edges beside the cell) of one region."""
    e = _edges(rings)
    if not len(e):
        return []
    out: list[tuple[int, int, bool, list]] = []
    xs, ys = e[:, [0, 2]], e[:, [1, 3]]
    n = 1 << levels[0]
    w, h = 360 / n, 180 / n
    col = lambda v: int(np.clip(np.floor((v + 180) / w), 0, n - 1))
    row = lambda v: int(np.clip(np.floor((v + 90) / h), 0, n - 1))
    gx, gy = np.meshgrid(np.arange(col(xs.min()), col(xs.max()) + 1), np.arange(row(ys.min()), row(ys.max()) + 1))
    cx, cy = gx.ravel().astype(np.int64), gy.ravel().astype(np.int64)
    for k, level in enumerate(levels):
        n = 1 << level
        w, h = 360 / n, 180 / n
        keep_x, keep_y = [], []
        for at in range(0, len(cx), max(1, 2_000_000 // len(e))):
            bx, by = cx[at : at + max(1, 2_000_000 // len(e))], cy[at : at + max(1, 2_000_000 // len(e))]
            x0, y0 = bx * w - 180, by * h - 90
            hit = _touched(x0, y0, w, h, e)
            edge = hit.any(1)
            whole = ~edge & _inside(x0 + w / 2, y0 + h / 2, e)
            out += [(level, int(y * n + x), True, []) for x, y in zip(bx[whole], by[whole])]
            if k < len(levels) - 1:
                keep_x.append(bx[edge])
                keep_y.append(by[edge])
            else:
                for i in np.flatnonzero(edge):
                    # for a ray to the east only edges at the cell's height and not west of it matter
                    near = (ys.min(1) <= y0[i] + h + 1e-9) & (ys.max(1) >= y0[i] - 1e-9) & (xs.max(1) >= x0[i] - 1e-9)
                    out.append((level, int(by[i] * n + bx[i]), False, e[near].tolist()))
        if k < len(levels) - 1:
            f = 1 << (levels[k + 1] - level)
            bx, by = np.concatenate(keep_x), np.concatenate(keep_y)
            cx = (bx[:, None, None] * f + np.arange(f)[None, None, :] + np.zeros((1, f, 1), dtype=np.int64)).ravel()
            cy = (by[:, None, None] * f + np.arange(f)[None, :, None] + np.zeros((1, 1, f), dtype=np.int64)).ravel()
    return out


def containing_regions(points: DataFrame, regions: DataFrame, point_id: str = "item", levels: tuple[int, ...] = (8, 11, 14)) -> DataFrame:
    """point_id, region for every region that contains the point (overlapping regions give several rows).

    `points` has point_id, lat, lon; `regions` has region and rings, arrays of [lon, lat] points under the even-odd rule
    (holes are rings like any other). `levels` halve the globe that often per axis: 8 is about 150 km, 14 about 2.4 km
    at the equator; choose the finest so that a region has hundreds of cells on its outline. Points that are no place,
    and regions without an outline, give no rows; outlines must not cross the date line; other columns are ignored.
    """
    require_columns(points, point_id, "lat", "lon")
    require_columns(regions, "region", "rings")
    if list(levels) != sorted(set(levels)) or not 0 <= levels[0] <= levels[-1] <= 28:
        raise ValueError("levels must grow, within 0 and 28")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = cover(rings, levels)
                for at in range(0, len(cells), 5000):
                    part = cells[at : at + 5000]
                    edges = [[dict(zip(("x1", "y1", "x2", "y2"), q)) for q in c[3]] for c in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part), pa.string()), pa.array([c[0] for c in part], pa.int64()), pa.array([c[1] for c in part], pa.int64()), pa.array([c[2] for c in part], pa.bool_()), pa.array(edges, _EDGES)],
                        names=["region", "level", "cell", "interior", "edges"],
                    )

    cells = regions.select(F.col("region").cast("string").alias("region"), F.col("rings").cast("array<array<array<double>>>").alias("rings")).filter("region is not null and rings is not null").mapInArrow(run, _CELLS)
    p = points.filter(is_located(F.col("lat"), F.col("lon"))).select(F.col(point_id).alias("_id"), "lat", "lon")
    at = lambda c, low, span, n: F.least(F.lit(n - 1), F.floor((F.col(c) + low) / (span / n)))
    numbers = F.array(*(F.struct(F.lit(x).cast("bigint").alias("level"), (at("lat", 90, 180, 1 << x) * (1 << x) + at("lon", 180, 360, 1 << x)).cast("bigint").alias("cell")) for x in levels))
    spread = p.select("_id", "lat", "lon", F.inline(numbers))
    crossed = F.filter("edges", lambda q: ((q["y1"] > F.col("lat")) != (q["y2"] > F.col("lat"))) & (F.col("lon") < (q["x2"] - q["x1"]) * F.try_divide(F.col("lat") - q["y1"], q["y2"] - q["y1"]) + q["x1"]))
    # an interior cell of a town may hold a third of all points; cells of one number on two levels differ in the level's bits
    key = F.shiftleft("level", 57) + F.col("cell")
    hits = spread_join(spread.withColumn("_key", key).drop("level", "cell"), cells.withColumn("_key", key).drop("level", "cell"), "_key").filter(F.col("interior") | (F.size(crossed) % 2 == 1))
    return hits.select(F.col("_id").alias(point_id), "region")
