"""Polygons and neighbours against brute force, with crowded spots."""
import math
import random

from fieldrounds.operators import geo


def test_boundary_is_inside_and_lowest_wins(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    notch = [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.5, 0.5), (1.0, 1.0)]
    shapes = spark.createDataFrame([(2, ring), (1, notch)], "district int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 1.5, 0.9), (4, 1.9, 0.2), (5, 3.0, 3.0), (6, None, 1.0)], "id int, lon double, lat double")
    got = {r.id: r.district for r in geo.point_in_polygon(pts, shapes, "id", 0.4).collect()}
    assert got == {1: 2, 2: 1, 4: 1}


def test_nearest_with_a_crowded_cell(spark):
    rng = random.Random(4)
    pts = [(i, -117.0 + rng.gauss(0, 0.00002), 32.7 + rng.gauss(0, 0.00002)) for i in range(300)]
    pts += [(300 + i, -117.0005, 32.7005) for i in range(40)]
    pts += [(400 + i, -117.0 + rng.uniform(-0.05, 0.05), 32.7 + rng.uniform(-0.05, 0.05)) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {}
    for r in geo.nearby(df, "id", 800.0, 3).collect():
        got.setdefault(r.id, []).append((r.meters, r.near_id))

    def metres(a, b):
        k = math.cos(a[2] * math.pi / 180)
        return math.hypot((b[1] - a[1]) * 111320 * k, (b[2] - a[2]) * 110540)
    for a in pts:
        d = sorted((metres(a, b), b[0]) for b in pts if b[0] != a[0])
        want = [round(m, 6) for m, _ in d if m <= 800][:3]
        assert [round(m, 6) for m, _ in sorted(got.get(a[0], []))] == want
