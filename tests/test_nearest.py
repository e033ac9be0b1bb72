"""Closest vertices against every vertex by itself."""

import numpy as np

from sensorline.operators import polyline

LINE = "cable_id long, seq long, lat double, lon double, cum double"
POINTS = "cable_id long, point_id long, lat double, lon double"


def brute(points, line):
    out = {}
    for cable, point, lat, lon in points:
        own = [v for v in line if v[0] == cable and v[2] is not None]
        if lat is None or not own:
            continue
        la, lo = (np.array([v[k] for v in own]) for k in (2, 3))
        dx, dy = (lo - lon) * 111320.0 * np.cos(np.radians((lat + la) / 2)), (la - lat) * 111320.0
        d = np.sqrt(dx * dx + dy * dy)
        out[cable, point] = min(v[1] for v, far in zip(own, d) if far == d.min())
    return out


def test_closest_vertices_of_lines_and_clouds(spark):
    """A line, a cloud, vertices on one place, a single vertex, places near and far, at the pole and beyond the equator."""
    rng = np.random.default_rng(4)
    shapes = {
        1: [(63 + k * 1e-5, 10 + 0.3 * np.sin(k / 90)) for k in range(900)],
        2: [tuple(v) for v in rng.normal((0, 20), (3, 5), (700, 2))],
        3: [(5.0, 5.0)] * 40,
        4: [(89.9, -170.0)],
        5: [(round(a, 1), round(b, 1)) for a, b in rng.uniform(-1, 1, (500, 2))],  # many ties
    }
    line = [(c, k, float(la), float(lo), k * 2.0) for c, v in shapes.items() for k, (la, lo) in enumerate(v)]
    line += [(1, 5000, None, 10.0, 0.0), (6, 0, None, None, 0.0)]
    points = [(c, 1000 * c + k, float(la), float(lo)) for c in range(1, 8) for k, (la, lo) in enumerate(rng.normal((40, 10), (25, 15), (40, 2)).clip(-90, 90))]
    points += [(5, 9000 + k, float(la), float(lo)) for k, (la, lo) in enumerate(rng.integers(-20, 20, (60, 2)) / 20)]
    points += [(1, 9990, None, 10.0), (1, 9991, 63.001, 10.01)]
    got = {(r.cable_id, r.point_id): (r.seq, r.cum) for r in polyline.nearest_vertex(spark.createDataFrame(points, POINTS), spark.createDataFrame(line, LINE)).collect()}
    want = brute(points, line)
    assert {k: v[0] for k, v in got.items()} == want and all(cum == 2.0 * seq for seq, cum in got.values())


def test_a_hundred_thousand_vertices(spark):
    """Each point looks at some leaves, not at all vertices."""
    t = np.arange(100_000)
    line = [(1, int(k), float(a), float(b), float(k)) for k, a, b in zip(t, 60 + t * 1e-6 + 1e-3 * np.sin(t / 500), 8 + t * 3e-6)]
    rng = np.random.default_rng(2)
    points = [(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(59.9, 60.2, 50), rng.uniform(7.9, 8.4, 50)))]
    near = polyline.nearest_vertex(spark.createDataFrame(points, POINTS), spark.createDataFrame(line, LINE))
    assert {(r.cable_id, r.point_id): r.seq for r in near.collect()} == brute(points, line)
    packed = polyline._packed(spark.createDataFrame(line, LINE)).selectExpr("size(vertices) as n").collect()
    assert max(r.n for r in packed) <= 317 and len(packed) < 400
