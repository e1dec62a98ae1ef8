"""Points in regions against a plain even-odd test."""

import math
import random

import pytest

from stridewell.operators.regions import containing_regions, cover

SCHEMA = "region string, rings array<array<array<double>>>, level int, cell bigint"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                odd = not odd
    return odd


def star(rng, x, y, r, n):
    return [[x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]


@pytest.mark.parametrize("levels", [(4, 7, 9), (8,), (2, 5, 8, 11)])
def test_regions(spark, levels):
    rng = random.Random(1)
    regions = {f"r{k}": [star(rng, rng.uniform(-60, 60), rng.uniform(-40, 40), rng.choice([0.3, 4, 20]), rng.choice([3, 7, 40]))] for k in range(12)}
    regions["ring"] = [[[-10.0, -10.0], [10.0, -10.0], [10.0, 10.0], [-10.0, 10.0]], [[-5.0, -5.0], [5.0, -5.0], [5.0, 5.0], [-5.0, 5.0]]]
    regions["pole"] = [[[-180.0, 80.0], [180.0, 80.0], [180.0, 90.0], [-180.0, 90.0]]]
    points = [(f"p{k}", rng.uniform(-60, 60), rng.uniform(-70, 70)) for k in range(500)]
    for k, rings in enumerate(regions.values()):
        points += [(f"q{k}-{j}", q[1] + rng.gauss(0, 0.05), q[0] + rng.gauss(0, 0.05)) for j, q in enumerate(rings[0])]
    points = [(i, max(-90.0, min(90.0, a)), max(-180.0, min(180.0, b))) for i, a, b in points] + [("north", 90.0, 0.5), ("east", 85.0, 180.0)]
    df = spark.createDataFrame([*points, ("none", None, 1.0), ("nan", float("nan"), 1.0)], "item string, lat double, lon double")
    rows = [(n, r, 1, 1) for n, r in regions.items()] + [("empty", [], 1, 1), ("null", None, 1, 1), ("line", [[[0.0, 0.0], [1.0, 1.0]]], 1, 1), (None, [[[0.0, 0.0], [1.0, 1.0], [1.0, 0.0]]], 1, 1)]
    got = sorted((r["item"], r.region) for r in containing_regions(df, spark.createDataFrame(rows, SCHEMA), levels=levels).collect())
    want = sorted((i, n) for i, lat, lon in points for n, rings in regions.items() if inside(lon, lat, rings))
    assert got == want and len(want) > 50


def test_most_of_a_large_region_is_interior():
    cells = cover([[[-20.0, -20.0], [20.0, -20.0], [20.0, 20.0], [-20.0, 20.0]]], (4, 7, 9))
    area = lambda inner: sum((360 / 2**c[0]) * (180 / 2**c[0]) for c in cells if c[2] == inner)
    assert area(True) > 0.93 * 1600
    assert max(len(c[3]) for c in cells) <= 4
