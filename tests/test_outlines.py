"""Common polygons of outlines against cells and closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorline.operators import locate, outlines


def _inside(e, n, x, y):
    """Odd number of crossings of a ray, point by point."""
    out = np.zeros(len(x), bool)
    for k in range(len(e)):
        (x1, y1), (x2, y2) = (e[k], n[k]), (e[k - 1], n[k - 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def test_squares_bow_ties_and_points_of_contact():
    square = ([0, 2, 2, 0], [0, 0, 2, 2])
    assert outlines.common_polygon([square[0]], [square[1]]).tolist() == [[4.0, 1.0, 1.0]]
    got = outlines.common_polygon([square[0], [1, 3, 3, 1]], [square[1], [1, 1, 3, 3]])
    assert got == pytest.approx(np.array([[1.0, 1.5, 1.5]]))
    bow = outlines.common_polygon([[0, 2, 2, 0]], [[0, 2, 0, 2]])  # two lobes that meet in a point
    assert bow == pytest.approx(np.array([[1.0, 1 / 3, 1.0], [1.0, 5 / 3, 1.0]]))
    assert len(outlines.common_polygon([square[0], [5, 6, 6]], [square[1], [5, 5, 6]])) == 0
    assert len(outlines.common_polygon([[0, 1, 2]], [[0, 0, 0]])) == 0
    assert outlines.common_polygon([square[0]] * 2, [square[1]] * 2) == pytest.approx(np.array([[4.0, 1.0, 1.0]]))


def test_a_frame_is_one_region_and_a_cross_cuts_it_in_four():
    """Ring of 4 x 4 less its middle 2 x 2, against a plus of width 1: four arms."""
    frame = ([0, 4, 4, 0, 0, 1, 1, 3, 3, 1, 1, 0], [0, 0, 4, 4, 0, 1, 3, 3, 1, 1, 1, 0])
    assert outlines.common_polygon([frame[0]], [frame[1]]) == pytest.approx(np.array([[12.0, 2.0, 2.0]]))
    plus = ([1.5, 2.5, 2.5, 4, 4, 2.5, 2.5, 1.5, 1.5, 0, 0, 1.5], [0, 0, 1.5, 1.5, 2.5, 2.5, 4, 4, 2.5, 2.5, 1.5, 1.5])
    got = outlines.common_polygon([frame[0], plus[0]], [frame[1], plus[1]])
    assert got[:, 0] == pytest.approx([1.0] * 4)
    assert sorted(map(tuple, got[:, 1:].round(9))) == [(0.5, 2.0), (2.0, 0.5), (2.0, 3.5), (3.5, 2.0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(3, 9))
def test_any_outlines_against_cells(seed, count, corners):
    rng = np.random.default_rng(seed)
    shapes = [rng.random((2, corners)) * 10 for _ in range(count)]
    got = outlines.common_polygon([s[0] for s in shapes], [s[1] for s in shapes])
    side = 400
    at = (np.arange(side) + 0.5) * 10 / side
    x, y = (v.ravel() for v in np.meshgrid(at, at))
    hit = np.logical_and.reduce([_inside(s[0], s[1], x, y) for s in shapes])
    border = sum(np.hypot(*(s - np.roll(s, 1, 1))).sum() for s in shapes) * 10 / side
    assert abs(got[:, 0].sum() - hit.sum() * (10 / side) ** 2) <= border
    if hit.sum() > 4000:
        assert (got[:, 0] * got[:, 1]).sum() / got[:, 0].sum() == pytest.approx(x[hit].mean(), abs=0.1)


def test_regions_of_bands_agree_with_fine_cells(spark):
    """Three subarrays hear one source: bands that close within the range, in cells of 1 m."""
    source, rows = (260.0, 40.0, 30.0), []
    for k, (e, n, turn) in enumerate(((0.0, 0.0, 0.3), (250.0, -150.0, 1.4), (420.0, 200.0, 2.5))):
        axis = (math.cos(turn), math.sin(turn), 0.0)
        away = np.array([e - source[0], n - source[1], -60.0])
        rows.append((1, k, math.degrees(math.acos(np.dot(away, axis) / np.linalg.norm(away))), *axis, e, n, -30.0))
    fits = spark.createDataFrame(rows, "packet long, subarray_id long, angle_deg double, ax double, ay double, az double, re double, rn double, ru double")
    points = locate.cone_plane_points(fits, samples=1440, max_range=4000.0)
    got = outlines.outline_track(points, 3).collect()
    assert [(r.packet, r.rank, r.u) for r in got][0] == (1, 1, 30.0)
    cells = locate.intersect_bands(fits, (0.0, 700.0, -500.0, 500.0), 1.0)
    held = locate.track_centroids(locate.regions(cells), 1.0).filter("rank = 1").first()
    assert got[0].area == pytest.approx(held.area, rel=0.02)
    assert (got[0].e, got[0].n) == pytest.approx((held.e, held.n), abs=1.0)
    assert outlines.outline_track(points, 4).count() == 0


def test_missing_rings_repeated_rows_and_no_rows(spark):
    ring = lambda p, s, ring, r: [(p, s, ring, k, r * math.cos(k), r * math.sin(k)) for k in range(6)]
    kind = "packet long, subarray_id long, ring string, k int, e double, n double"
    rows = ring(1, 1, "outer", 2.0) + ring(1, 1, "inner", 1.0) + ring(1, 1, "nominal", 1.5) + ring(2, 1, "outer", 2.0)
    points = spark.createDataFrame(rows, kind)
    once = outlines.common_regions(outlines.outlines(points)).collect()
    assert {r.packet for r in once} == {1}
    twice = outlines.common_regions(outlines.outlines(points.union(points))).agg(F.sum("area")).first()[0]
    assert twice == pytest.approx(sum(r.area for r in once))
    assert outlines.common_regions(outlines.outlines(points.filter("packet > 9"))).count() == 0
