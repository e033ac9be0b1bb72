"""Common polygons of band outlines: exact areas, centroids and regions by a scanline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.operators.locate import SOURCE_U, SPREAD_DEG, TOGETHER, _least_of_linked, _ring_places

#: Regions of less area are rounding.
SPECK = 1e-9


def outlines(points: DataFrame) -> DataFrame:
    """packet, subarray_id and the closed outline (arrays e, n) of ``cone_plane_points``:
    outer ring forward, inner ring backward. Rings that are missing or fewer than 3
    vertices give no row."""
    turn = F.when(F.col("ring") == "outer", F.col("k")).otherwise(-F.col("k") - 1)
    held = points.filter("ring in ('outer', 'inner')").select("packet", "subarray_id", F.struct((F.col("ring") == "inner").alias("last"), turn.alias("o"), "e", "n").alias("p"))
    g = held.groupBy("packet", "subarray_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = F.exists("p", lambda p: p["last"]) & F.exists("p", lambda p: ~p["last"]) & (F.size("p") >= 3)
    return g.filter(whole).select("packet", "subarray_id", "p.e", "p.n")


def fit_outlines(fits: DataFrame, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG, samples: int = 300, max_range: float | None = None) -> DataFrame:
    """``outlines`` of the ``cone_plane_points`` of fits, within the row of a fit: its points are
    neither rows nor sorted."""

    @F.pandas_udf("struct<e array<double>, n array<double>>")
    def outline(*columns: pd.Series) -> pd.DataFrame:
        table = np.stack([c.to_numpy(float) for c in columns], 1)
        held: list[tuple] = []
        step = max(1, TOGETHER // samples)
        for begin in range(0, len(table), step):
            outer, inner = (_ring_places(table[begin : begin + step], off, source_u, samples, max_range) for off in (spread_deg, -spread_deg))
            e, n, met = (np.hstack([x, y[:, ::-1]]) for x, y in zip(outer, inner))
            whole = outer[2].any(1) & inner[2].any(1) & (met.sum(1) >= 3)
            held += [(e[k, met[k]], n[k, met[k]]) if whole[k] else (None, None) for k in range(len(e))]
        return pd.DataFrame(held, columns=["e", "n"])

    made = fits.select("packet", "subarray_id", outline(*[F.col(c).cast("double") for c in ("angle_deg", "ax", "ay", "az", "re", "rn", "ru")]).alias("g"))
    return made.select("packet", "subarray_id", F.inline(F.array("g"))).filter("e is not null")


def _heights(group: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different heights of all groups, group by group from below: group, height; and the place of each given one."""
    order = np.lexsort((y, group))
    group, y = group[order], y[order]
    first = np.append(True, (group[1:] != group[:-1]) | (y[1:] != y[:-1]))
    place = np.empty(len(order), int)
    place[order] = np.cumsum(first) - 1
    return group[first], y[first], place


def _pieces(edges: np.ndarray, first: np.ndarray, stop: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges from height ``first`` to ``stop`` of ``y``, cut at the heights between: edge, strip, x at the strip's bottom and top."""
    count = stop - first
    edge = np.repeat(np.arange(len(edges)), count)
    strip = np.arange(len(edge)) - np.repeat(np.cumsum(count) - stop, count)
    x1, y1, x2, y2 = edges[edge].T
    at = lambda h: x1 + (x2 - x1) * ((h - y1) / (y2 - y1))
    return edge, strip, at(y[strip]), at(y[strip + 1])


def _crossings(y: np.ndarray, strip: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strips and heights at which pieces of one strip cross: pairs in another order at the top than at the bottom."""
    order = np.lexsort((high, low, strip))
    strip, low, high = strip[order], low[order], high[order]
    turned = strip[1:][(strip[1:] == strip[:-1]) & (high[1:] < high[:-1])]
    held = np.isin(strip, turned)
    strip, low, high = strip[held], low[held], high[held]
    place = np.arange(len(strip))
    later = np.searchsorted(strip, strip, "right") - place - 1
    a = np.repeat(place, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    swapped = high[a] > high[b]
    a, b = a[swapped], b[swapped]
    gap, over = low[b] - low[a], high[a] - high[b]
    foot, top = y[strip[a]], y[strip[a] + 1]
    h = foot + (top - foot) * (gap / (gap + over))
    inner = (h > foot) & (h < top)
    return strip[a][inner], h[inner]


def common_polygons(group: np.ndarray, outline_e: list, outline_n: list) -> tuple[np.ndarray, np.ndarray]:
    """Groups and rows (area, e, n) of the connected regions inside all the closed outlines of a
    group, the largest first. ``group`` counts from 0 and tells the group of each outline, in order.

    A place is inside an outline that crosses itself if a ray from it meets the
    outline an odd number of times. The heights of all vertices and crossings cut
    the plane into strips in which no edges cross; between neighbouring edges lie
    trapezoids, whose areas and moments are exact. Trapezoids that share a part of
    a side are one region; those that meet in a point are not. A strip belongs to one
    group, so the strips of many groups are worked on together.
    """
    nothing = np.zeros(0, int), np.zeros((0, 3))
    size = np.array([len(e) for e in outline_e], int)
    if not size.sum():
        return nothing
    owner = np.repeat(np.arange(len(size)), size)
    place = np.stack([np.concatenate([np.asarray(v, float) for v in x]) for x in (outline_e, outline_n)], 1)
    follow = np.arange(1, len(place) + 1)
    stops = np.cumsum(size)[size > 0]
    follow[stops - 1] = stops - size[size > 0]
    edges = np.hstack([place, place[follow]])
    edges = np.where((edges[:, 1] <= edges[:, 3])[:, None], edges, edges[:, [2, 3, 0, 1]])
    rising = edges[:, 1] < edges[:, 3]  # level edges bound no strip
    edges, owner = edges[rising], owner[rising]
    if not len(edges):
        return nothing
    of = group[owner]
    n_groups = int(group.max()) + 1
    many = np.maximum(np.bincount(of, minlength=n_groups), 1)
    middle = np.stack([np.bincount(of, edges[:, k], n_groups) / many for k in (0, 1)], 1)
    edges = edges - np.tile(middle[of], 2)
    given = np.concatenate([edges[:, 1], edges[:, 3]])
    y_of, y, at = _heights(np.tile(of, 2), given)
    strip, h = _crossings(y, *_pieces(edges, at[: len(edges)], at[len(edges) :], y)[1:])
    y_of, y, at = _heights(np.concatenate([of, of, y_of[strip]]), np.concatenate([given, h]))
    edge, strip, low, high = _pieces(edges, at[: len(edges)], at[len(edges) : 2 * len(edges)], y)
    order = np.lexsort((low + high, strip))
    edge, strip, low, high = edge[order], strip[order], low[order], high[order]
    within = np.arange(len(group)) - np.searchsorted(group, group)  # number of an outline in its group
    bits, outlines_of = within[owner[edge]], np.bincount(group, minlength=n_groups)
    inside = np.ones(len(edge), bool)
    for k in range(int(outlines_of.max())):  # a strip's edges of an outline are even in number, so counts need no restart
        inside &= (np.cumsum(bits == k) % 2 == 1) | (k >= outlines_of[y_of[strip]])
    at = np.flatnonzero(inside)
    if not len(at):
        return nothing
    strip, l0, l1, r0, r1 = strip[at], low[at], high[at], low[at + 1], high[at + 1]
    mine = y_of[strip]
    foot, height = y[strip], y[strip + 1] - y[strip]
    area = height * ((r0 - l0) + (r1 - l1)) / 2
    e = height * (r0 * r0 + r0 * r1 + r1 * r1 - l0 * l0 - l0 * l1 - l1 * l1) / 6
    n = foot * area + height * height * ((r0 - l0) + 2 * (r1 - l1)) / 6

    beside = np.flatnonzero((at[1:] == at[:-1] + 1))
    least, most = np.full(n_groups, np.inf), np.full(n_groups, -np.inf)
    np.minimum.at(least, mine, np.minimum(l0, l1))
    np.maximum.at(most, mine, np.maximum(r0, r1))
    key = lambda s, x: s + (x - least[mine]) / (most - least + 1.0)[mine]
    touch = 1e-9
    first = np.searchsorted(np.maximum.accumulate(key(strip, r0)), key(strip + 1, l1) + touch, "right")
    stop = np.searchsorted(np.maximum.accumulate(key(strip, l0)), key(strip + 1, r1) - touch, "left")
    count = np.maximum(stop - first, 0)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
    top = _least_of_linked(len(at), np.concatenate([beside, np.repeat(np.arange(len(at)), count)]), np.concatenate([beside + 1, above]))

    roots, label = np.unique(top, return_inverse=True)
    total = [np.bincount(label, v, len(roots)) for v in (area, e, n)]
    kept = total[0] > SPECK
    area, e, n = (v[kept] for v in total)
    mine = mine[roots[kept]]
    out = np.stack([area, e / area + middle[mine, 0], n / area + middle[mine, 1]], 1)
    order = np.lexsort((out[:, 2], out[:, 1], -out[:, 0], mine))
    return mine[order], out[order]


def common_polygon(outline_e, outline_n) -> np.ndarray:
    """``common_polygons`` of one group."""
    return common_polygons(np.zeros(len(outline_e), int), list(outline_e), list(outline_n))[1]


#: Vertices of the groups that are worked on together, about.
VERTICES = 1 << 14


def common_regions(bands: DataFrame, keys: tuple[str, ...] = ("packet",)) -> DataFrame:
    """keys, rank (from 1, the largest first), e, n, area of the regions that all ``outlines`` of a group share.

    Groups without a common place give no row. With the keys packet and
    subarray_id the regions are those of a single outline, its self-crossings
    resolved. A group holds one outline per subarray, a handful; one aggregation
    is the only shuffle, and none where rows stand by packet already.
    """
    held = bands.groupBy(*keys).agg(F.collect_list(F.struct("subarray_id", "e", "n")).alias("o")).withColumn("o", F.sort_array("o"))
    kinds = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            vertices = np.cumsum([sum(map(len, e)) for e in batch["e"]])
            for _, rows in batch.groupby(vertices // VERTICES):
                group = np.repeat(np.arange(len(rows)), [len(e) for e in rows["e"]])
                of, places = common_polygons(group, *([v for x in rows[c] for v in x] for c in ("e", "n")))
                rank = np.arange(len(of)) - np.searchsorted(of, of) + 1
                yield pd.DataFrame({**{k: rows[k].to_numpy()[of] for k in keys}, "rank": rank, "e": places[:, 1], "n": places[:, 2], "area": places[:, 0]})

    return held.select(*keys, "o.e", "o.n").mapInPandas(run, f"{kinds}, rank int, e double, n double, area double")


def whole_areas(regions: DataFrame, keys: tuple[str, ...] = ("packet",)) -> DataFrame:
    """keys, area, e, n of all regions of a group together."""
    g = regions.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum(F.col("e") * F.col("area")).alias("se"), F.sum(F.col("n") * F.col("area")).alias("sn"))
    return g.select(*keys, "area", (F.col("se") / F.col("area")).alias("e"), (F.col("sn") / F.col("area")).alias("n"))


def outline_track(points: DataFrame, wanted: int | None = None, top: int = 2, source_u: float = SOURCE_U) -> DataFrame:
    """packet, rank, e, n, u, area of the ``top`` largest common regions of each packet;
    with ``wanted`` only of packets with that many outlines."""
    bands = outlines(points)
    if wanted is not None:
        bands = bands.withColumn("of", F.count("*").over(W.partitionBy("packet"))).filter(F.col("of") == wanted).drop("of")
    return common_regions(bands).filter(F.col("rank") <= top).select("packet", "rank", "e", "n", F.lit(source_u).alias("u"), "area")
