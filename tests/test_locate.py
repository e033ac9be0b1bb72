"""Bands intersected by a quadtree and regions labelled in batches, against every cell by itself."""

import math
import random

import numpy as np

from sensorline.operators import locate

SCHEMA = "packet long, subarray_id int, angle_deg double, ax double, ay double, az double, re double, rn double, ru double"


def fits(packets, seed):
    rng, rows = random.Random(seed), []
    for k in range(packets):
        for j in range(1 + k % 3):
            a = rng.uniform(0, 2 * math.pi)
            rows.append((k, j, rng.uniform(2, 178), math.cos(a), math.sin(a), 0.0, rng.uniform(-50, 150), rng.uniform(-80, 80), rng.uniform(-1, 1)))
    return rows


def brute(rows, window, cell):
    """Cells (packet, ix, iy) by the angle at every cell's centre."""
    nx, ny = (math.ceil((window[k + 1] - window[k]) / cell) for k in (0, 2))
    e, n = (v.ravel() for v in np.meshgrid(window[0] + (np.arange(nx) + 0.5) * cell, window[2] + (np.arange(ny) + 0.5) * cell, indexing="ij"))
    held = {}
    for packet, _, angle, ax, ay, az, re, rn, ru in rows:
        d = np.array([re - e, rn - n, np.full(len(e), ru - 30.0)])
        to = np.degrees(np.arccos(np.clip((d[0] * ax + d[1] * ay + d[2] * az) / np.sqrt((d**2).sum(0)), -1, 1)))
        inside = np.abs(to - angle) <= 5
        inside = inside if inside.any() else np.abs(to - (180 - angle)) <= 5
        held[packet] = held.get(packet, True) & inside
    return {(p, int(c // ny), int(c % ny)) for p, ok in held.items() for c in np.flatnonzero(ok)}


def test_quadtree_gives_every_cell(spark):
    rows = fits(40, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for window, cell in (((0.0, 120.0, -100.0, 100.0), 5.0), ((0.0, 97.0, -31.0, 50.0), 3.0)):
        got = locate.intersect_bands(df, window, cell).collect()
        assert len(got) == len({(r.packet, r.ix, r.iy) for r in got}) and {(r.packet, r.ix, r.iy) for r in got} == brute(rows, window, cell)
        assert all(abs(r.e - (window[0] + (r.ix + 0.5) * cell)) < 1e-9 and abs(r.n - (window[2] + (r.iy + 0.5) * cell)) < 1e-9 for r in got)
    assert locate.intersect_bands(df.limit(0), (0.0, 10.0, 0.0, 10.0), 1.0).count() == 0


def test_the_whole_window_at_one_metre(spark):
    """700 000 cells a packet; the squares looked at grow with the border."""
    rows, window = fits(4, 2), (0.0, 700.0, -500.0, 500.0)
    got = {(r.packet, r.ix, r.iy) for r in locate.intersect_bands(spark.createDataFrame(rows, SCHEMA), window, 1.0).collect()}
    assert got == brute(rows, window, 1.0)
    table = np.array([[r[3:] for r in rows if r[0] == 1]])
    angles, given = np.array([[r[2] for r in rows if r[0] == 1]]), np.ones((1, 2), bool)
    sizes = [len(locate._descend(table, angles, given, window, cell, 30.0, 5.0)[0][0]) for cell in (4.0, 2.0, 1.0)]
    assert all(b < 3 * a + 50 for a, b in zip(sizes, sizes[1:]))


def test_regions_of_many_packets(spark):
    rng = random.Random(3)
    cells = {(p, x, y) for p in range(60) for x in range(9) for y in range(9) if rng.random() < 0.55}
    df = spark.createDataFrame([(p, x, y, float(x), float(y)) for p, x, y in cells], "packet long, ix int, iy int, e double, n double")
    got = {(r.packet, r.ix, r.iy): r.region for r in locate.regions(df).collect()}
    assert set(got) == cells
    for p in range(60):
        left, parts = {c for c in cells if c[0] == p}, []
        while left:
            part, edge = set(), [left.pop()]
            while edge:
                c = edge.pop()
                part.add(c)
                near = {(p, c[1] + a, c[2] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))} & left
                left -= near
                edge += near
            parts.append(part)
        assert sorted(len({got[c] for c in part}) for part in parts) == [1] * len(parts)
        assert {got[next(iter(part))] for part in parts} == set(range(len(parts)))


def test_regions_across_tiles(spark):
    """A comb, a spiral and loose cells, the same regions with tiles of 4 cells as in one tile."""
    comb = {(x, y) for x in range(0, 40, 2) for y in range(30)} | {(x, 0) for x in range(40)}
    spiral, x, y, dx, dy = {(50, 0)}, 50, 0, 1, 0
    for leg in range(20, 0, -2):
        for _ in range(2):
            for _ in range(leg):
                x, y = x + dx, y + dy
                spiral.add((x, y))
            dx, dy = -dy, dx
    rng = random.Random(5)
    loose = {(x, y) for x in range(100, 160) for y in range(60) if rng.random() < 0.6}
    rows = [(p, x + s, y + s, float(x), float(y)) for p, s in ((1, 0), (2, 3)) for x, y in comb | spiral | loose]
    df = spark.createDataFrame(rows + rows[:1], "packet long, ix int, iy int, e double, n double")
    label = lambda tile: sorted(tuple(r) for r in locate.regions(df, tile).select("packet", "ix", "iy", "region").collect())
    small = label(4)
    assert small == label(4096) and len(small) == len(rows) + 1
    named = {(p, x, y): k for p, x, y, k in small}
    assert len({named[1, x, y] for x, y in comb}) == 1 and len({named[1, x, y] for x, y in spiral}) == 1
    assert {k for p, _, _, k in small if p == 1} == set(range(1 + max(named.values())))


def test_no_cells_no_regions(spark):
    df = spark.createDataFrame([], "packet string, ix int, iy int, e double, n double")
    assert locate.regions(df).collect() == []
