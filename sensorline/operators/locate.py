"""Localisation: uncertainty bands on the source plane, their intersection, tracks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SOURCE_U = 30.0
SPREAD_DEG = 5.0
EDGE_DEG = 0.5


def _basis(ax: Column, ay: Column, az: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Axis and two unit vectors across it."""
    flat = F.abs(az) < 0.9
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    helper = [F.when(flat, 0.0).otherwise(1.0), F.lit(0.0), F.when(flat, 1.0).otherwise(0.0)]
    e1 = [ax, ay, az]
    raw = cross(e1, helper)
    size = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    e2 = [c / size for c in raw]
    return e1, e2, cross(e1, e2)


def cone_plane_points(fits: DataFrame, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG, samples: int = 300, window: tuple[float, float, float, float] | None = None, max_range: float | None = None) -> DataFrame:
    """Points (packet, subarray_id, ring, k, flipped, e, n, u) of three cones on the plane u = source_u.

    ``fits`` has packet, subarray_id, angle_deg, axis ax, ay, az and reference
    re, rn, ru. Rings are inner, nominal and outer (angle less spread, angle,
    angle plus spread, kept off 0 and 180). A sound that travels along a cone
    direction comes from the opposite one; where a ring meets the plane nowhere
    within window and range, the other hemisphere is taken. Which one that is follows
    from the row of the ring: without a window the points of the steepest
    directions are the nearest ones, so they tell it. Nothing is shuffled.
    """
    rings = F.explode(F.array(*[F.struct(F.lit(n).alias("ring"), F.lit(d).alias("off")) for n, d in (("inner", -spread_deg), ("nominal", 0.0), ("outer", spread_deg))])).alias("ring_")
    clip = lambda a: F.greatest(F.lit(EDGE_DEG), F.least(F.lit(180.0 - EDGE_DEG), a))
    held = fits.select("packet", "subarray_id", "angle_deg", "ax", "ay", "az", "re", "rn", "ru", rings)
    held = held.withColumn("theta", F.radians(clip(clip(F.col("angle_deg")) + F.col("ring_.off"))))
    e1, e2, e3 = _basis(F.col("ax"), F.col("ay"), F.col("az"))
    held = held.withColumns({f"{v}{c}": x for v, vec in (("p", e2), ("q", e3)) for c, x in zip("xyz", vec)})
    height = source_u - F.col("ru")

    def meet(k: Column, sign: Column | float) -> Column:
        """Distance at which direction k meets the plane, and the place there."""
        phi = k * (2 * math.pi / samples)
        d = {c: -(F.cos("theta") * F.col(f"a{c}") + F.sin("theta") * (F.cos(phi) * F.col(f"p{c}") + F.sin(phi) * F.col(f"q{c}"))) for c in "xyz"}
        dist = F.when(F.abs(d["z"]) > 1e-8, height / (sign * d["z"]))
        return F.struct(dist.alias("dist"), *[(F.col(f"r{x}") + dist * sign * d[c]).alias(x) for x, c in (("e", "x"), ("n", "y"))])

    def hit(m: Column) -> Column:
        seen = m["dist"] > 0
        if max_range is not None:
            seen = seen & (m["dist"] <= max_range)
        if window is not None:
            seen = seen & m["e"].between(window[0], window[1]) & m["n"].between(window[2], window[3])
        return seen

    if window is None:
        way = F.when(height < 0, 1.0).otherwise(-1.0)
        nearest = F.round(F.atan2(way * F.col("qz"), way * F.col("pz")) * (samples / (2 * math.pi))).cast("int")
        asked = F.array(*[F.pmod(nearest + d, F.lit(samples)) for d in (-1, 0, 1)])
    else:
        asked = F.sequence(F.lit(0), F.lit(samples - 1))
    straight = F.coalesce(F.exists(asked, lambda k: hit(meet(k, F.lit(1.0)))), F.lit(False))
    around = held.withColumn("flipped", ~straight).select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    met = around.select("packet", "subarray_id", F.col("ring_.ring").alias("ring"), "k", "flipped", meet(F.col("k"), F.when(F.col("flipped"), -1.0).otherwise(1.0)).alias("m"))
    return met.filter(hit(F.col("m"))).select("packet", "subarray_id", "ring", "k", "flipped", "m.e", "m.n", F.lit(source_u).alias("u"))


def band_polygon(points: DataFrame) -> DataFrame:
    """packet, subarray_id, n, area, ce, cn of the closed outline: outer ring
    forward, inner ring backward. Rings that are missing or fewer than 3
    vertices give no row. Outlines that cross themselves keep the signed
    area's magnitude; ``outlines.common_regions`` resolves the crossings."""
    place = F.when(F.col("ring") == "outer", F.col("k")).when(F.col("ring") == "inner", 1_000_000 - F.col("k"))
    outline = points.filter("ring <> 'nominal'").withColumn("o", place)
    w = W.partitionBy("packet", "subarray_id")
    w_o = w.orderBy("o")
    step = outline.withColumns({c2: F.coalesce(F.lead(c).over(w_o), F.first(c).over(w_o)) for c, c2 in (("e", "e2"), ("n", "n2"))})
    cross = F.col("e") * F.col("n2") - F.col("e2") * F.col("n")
    g = step.groupBy("packet", "subarray_id").agg(F.count("*").alias("n_vertices"), F.count_distinct("ring").alias("rings"), (F.sum(cross) / 2).alias("a"), F.sum((F.col("e") + F.col("e2")) * cross).alias("se"), F.sum((F.col("n") + F.col("n2")) * cross).alias("sn"))
    good = g.filter("rings = 2 and n_vertices >= 3 and abs(a) > 1e-9")
    return good.select("packet", "subarray_id", "n_vertices", F.abs("a").alias("area"), (F.col("se") / (6 * F.col("a"))).alias("ce"), (F.col("sn") / (6 * F.col("a"))).alias("cn"))


#: Numbers in an array of the rings of many fits that are worked on together, about.
TOGETHER = 1 << 18


def _ring_places(f: np.ndarray, off: float, source_u: float, samples: int, max_range: float | None):
    """e, n of the directions of one ring and which of them meet the plane, for rows
    (angle_deg, ax, ay, az, re, rn, ru): ``cone_plane_points`` for many fits at once."""
    clip = lambda a: np.maximum(EDGE_DEG, np.minimum(180.0 - EDGE_DEG, a))
    theta, axis = np.radians(clip(clip(f[:, 0]) + off)), f[:, 1:4]
    flat = np.abs(axis[:, 2]) < 0.9
    p = np.cross(axis, np.stack([~flat, np.zeros(len(f)), flat], 1).astype(float))
    p /= np.sqrt((p * p).sum(1))[:, None]
    q = np.cross(axis, p)
    phi = np.arange(samples) * (2 * math.pi / samples)
    d = [-(np.cos(theta)[:, None] * axis[:, c, None] + np.sin(theta)[:, None] * (np.cos(phi) * p[:, c, None] + np.sin(phi) * q[:, c, None])) for c in range(3)]
    r = np.divide((source_u - f[:, 6])[:, None], d[2], out=np.full(d[2].shape, np.nan), where=np.abs(d[2]) > 1e-8)
    far = np.inf if max_range is None else max_range
    straight = (r > 0) & (r <= far)
    met = np.where(straight.any(1)[:, None], straight, (-r > 0) & (-r <= far))
    return f[:, 4, None] + r * d[0], f[:, 5, None] + r * d[1], met  # both signs of a direction meet the plane in one place


def fit_polygons(fits: DataFrame, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG, samples: int = 300, max_range: float | None = None) -> DataFrame:
    """``band_polygon`` of the ``cone_plane_points`` of fits, within the row of a fit: its
    points are neither rows nor sorted."""

    @F.pandas_udf("struct<n_vertices long, rings long, a double, se double, sn double>")
    def polygon(*columns: pd.Series) -> pd.DataFrame:
        table = np.stack([c.to_numpy(float) for c in columns], 1)
        out = np.zeros((len(table), 5))
        step = max(1, TOGETHER // samples)
        for begin in range(0, len(table), step):
            part = table[begin : begin + step]
            outer, inner = (_ring_places(part, off, source_u, samples, max_range) for off in (spread_deg, -spread_deg))
            e, n, met = (np.hstack([x, y[:, ::-1]]) for x, y in zip(outer, inner))
            count = met.sum(1)
            some = np.flatnonzero(count)
            row = np.repeat(np.arange(len(part)), count)
            e, n = e[met], n[met]
            follow = np.arange(1, len(row) + 1)
            stop = np.cumsum(count)
            follow[stop[some] - 1] = (stop - count)[some]
            e2, n2 = e[follow], n[follow]
            cross = e * n2 - e2 * n
            sums = [np.bincount(row, v, len(part)) for v in (cross, (e + e2) * cross, (n + n2) * cross)]
            out[begin : begin + step] = np.stack([count, outer[2].any(1).astype(int) + inner[2].any(1), sums[0] / 2, sums[1], sums[2]], 1)
        made = pd.DataFrame(out, columns=["n_vertices", "rings", "a", "se", "sn"])
        return made.astype({"n_vertices": "int64", "rings": "int64"})

    held = fits.select("packet", "subarray_id", polygon(*[F.col(c).cast("double") for c in ("angle_deg", "ax", "ay", "az", "re", "rn", "ru")]).alias("g"))
    good = held.select("packet", "subarray_id", F.inline(F.array("g"))).filter("rings = 2 and n_vertices >= 3 and abs(a) > 1e-9")
    return good.select("packet", "subarray_id", "n_vertices", F.abs("a").alias("area"), (F.col("se") / (6 * F.col("a"))).alias("ce"), (F.col("sn") / (6 * F.col("a"))).alias("cn"))


def qualified_packets(fits: DataFrame, subarrays: DataFrame) -> DataFrame:
    """Packets valid, with points and a nominal ring, in all the subarrays: relational division."""
    good = fits.filter("valid and has_points and nominal_points > 0").join(subarrays.select("subarray_id").distinct(), "subarray_id", "left_semi")
    wanted = subarrays.agg(F.count_distinct("subarray_id").alias("wanted"))  # one row
    return good.groupBy("packet").agg(F.count_distinct("subarray_id").alias("n")).join(F.broadcast(wanted)).filter("n = wanted").select("packet")


#: Packets whose squares are worked on together.
PACKETS = 256


def _bounds(fits: np.ndarray, angles: np.ndarray, e: np.ndarray, n: np.ndarray, reach: float, source_u: float, spread_deg: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether all, and whether no cell centres within ``reach`` of the points (e, n) can lie in
    the band of a fit (rows of points, columns of fits)."""
    d = [fits[:, :, 3] - e[:, None], fits[:, :, 4] - n[:, None], fits[:, :, 5] - source_u]
    r = np.maximum(np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), 1e-9)
    cos = (d[0] * fits[:, :, 0] + d[1] * fits[:, :, 1] + d[2] * fits[:, :, 2]) / r
    off = np.abs(np.degrees(np.arccos(np.clip(cos, -1.0, 1.0))) - angles)
    if not reach:
        return off <= spread_deg, off > spread_deg
    slack = np.where(r > reach, np.degrees(np.arcsin(np.minimum(1.0, reach / r))), 180.0) + 1e-9
    return off + slack <= spread_deg, off - slack > spread_deg


def _descend(fits: np.ndarray, angles: np.ndarray, given: np.ndarray, window, cell_m: float, source_u: float, spread_deg: float, first_only: bool = False):
    """Squares (row of ``fits``, ix, iy, side in cells) whose cell centres all lie in all bands of the row.

    A quadtree over the window: the angle between axis and direction changes over
    a square by no more than its half diagonal subtends, so a square is inside,
    outside or split, and work grows with the border of the region. With
    ``first_only`` a row is done with its first square.
    """
    nx, ny = (math.ceil((window[k + 1] - window[k]) / cell_m) for k in (0, 2))
    side = 1 << max(0, max(nx, ny) - 1).bit_length()
    row, x, y = np.arange(len(fits)), np.zeros(len(fits), int), np.zeros(len(fits), int)
    done, found = np.zeros(len(fits), bool), []
    while len(row):
        e, n = window[0] + (x + side / 2) * cell_m, window[2] + (y + side / 2) * cell_m
        every, none = _bounds(fits[row], angles[row], e, n, (side - 1) * cell_m * math.sqrt(0.5), source_u, spread_deg)
        inside = (every | ~given[row]).all(1)
        split = ~inside & ~(none & given[row]).any(1)
        found.append((row[inside], x[inside], y[inside], np.full(inside.sum(), side)))
        done[row[inside]] = True
        if side == 1:
            break
        side //= 2
        row, x, y = (np.repeat(v[split], 4) for v in (row, x, y))
        turn = np.tile(np.arange(4), split.sum())
        x, y = x + side * (turn % 2), y + side * (turn // 2)
        held = (x < nx) & (y < ny)
        if first_only:
            held &= ~done[row]
        row, x, y = row[held], x[held], y[held]
    return tuple(np.concatenate(v) for v in zip(*found)), done, (nx, ny)


def _unrolled(squares, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of squares, as far as the window reaches."""
    row, x, y, side = squares
    count = side * side
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, x, y, side = (np.repeat(v, count) for v in (row, x, y, side))
    ix, iy = x + at % side, y + at // side
    held = (ix < shape[0]) & (iy < shape[1])
    return row[held], ix[held], iy[held]


def intersect_bands(fits: DataFrame, window: tuple[float, float, float, float], cell_m: float = 5.0, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG) -> DataFrame:
    """packet, ix, iy, e, n of the cells whose centres lie inside the bands of all fits of a packet.

    A cell is inside a band if the angle between the axis and the direction from
    the cell to the reference is within ``spread_deg`` of the fit's, or of its
    supplement where the band meets no cell of the window (there the sound came
    from the other side). The fits of a packet (one per subarray, a handful) are
    one row, so one aggregation is the only shuffle; squares of many packets are
    halved together, see ``_descend``.
    """
    def cells(packet: np.ndarray, row: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"packet": packet[row], "ix": ix, "iy": iy, "e": window[0] + (ix + 0.5) * cell_m, "n": window[2] + (iy + 0.5) * cell_m})

    return _in_bands(fits, window, cell_m, source_u, spread_deg, cells, "ix int, iy int, e double, n double")


def _in_bands(fits: DataFrame, window: tuple[float, float, float, float], cell_m: float, source_u: float, spread_deg: float, out, schema: str) -> DataFrame:
    """Rows packet and ``schema`` that ``out`` makes of the cells of ``intersect_bands``:
    it is given some packets, and for each cell the row of its packet, ix and iy."""
    kind = fits.schema["packet"].dataType.simpleString()
    # few bytes but much work, which size-based merging of partitions does not see
    dealt = fits.repartition(int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "packet")
    held = dealt.groupBy("packet").agg(F.sort_array(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("ax", "ay", "az", "re", "rn", "ru", "angle_deg")]))).alias("fits"))

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), PACKETS):
                part = batch.iloc[begin : begin + PACKETS]
                rows = [np.array([np.asarray(f, float) for f in r]) for r in part["fits"]]
                most = max(map(len, rows))
                given = np.array([[k < len(r) for k in range(most)] for r in rows])
                table = np.zeros((len(rows), most, 7))
                for k, r in enumerate(rows):
                    table[k, : len(r)] = r
                each = table[given][:, None, :]
                _, met, _ = _descend(each[:, :, :6], each[:, :, 6], np.ones((len(each), 1), bool), window, cell_m, source_u, spread_deg, True)
                angles = table[:, :, 6].copy()
                angles[given] = np.where(met, angles[given], 180 - angles[given])
                squares, _, shape = _descend(table[:, :, :6], angles, given, window, cell_m, source_u, spread_deg)
                row, ix, iy = _unrolled(squares, shape)
                yield out(part["packet"].to_numpy(), row, ix, iy)

    return held.mapInPandas(run, f"packet {kind}, {schema}")


def fine_cells(fits: DataFrame, window: tuple[float, float, float, float], coarse_m: float = 5.0, parts: int = 5, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG) -> DataFrame:
    """``intersect_bands`` with cells ``parts`` times finer than ``coarse_m``, as far as their centres lie in the window."""
    cells = intersect_bands(fits, window, coarse_m / parts, source_u, spread_deg)
    return cells.filter((F.col("e") < window[1]) & (F.col("n") < window[3]))


#: Side of a tile of labelling, in cells.
TILE = 128


def _least_of_linked(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number that each of 0..count-1 reaches along the links (a, b)."""
    top = np.arange(count)
    while (top[a] != top[b]).any():
        least = np.minimum(top[a], top[b])
        np.minimum.at(top, np.concatenate([a, top[a], b, top[b]]), np.tile(least, 4))
        top = top[top]
    return top


def _labelled(row: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the cells by row, ix and iy, and the place in it of the least cell that each reaches within its row."""
    x, y = ix - ix.min(), iy - iy.min()
    height, width = int(x.max()) + 2, int(y.max()) + 2
    key = (row * height + x) * width + y
    order = np.argsort(key, kind="stable")
    key = key[order]
    links = []
    for step in (0, 1, width):  # a cell given twice, the next in the column, the next in the row
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        hit = np.flatnonzero(key[at] == key + step)
        links.append((hit, at[hit]))
    return order, _least_of_linked(len(key), *(np.concatenate(v) for v in zip(*links)))


def _label_tiles(batches):
    """Cells with the least cell (rx, ry) that they reach inside their tile, a batch of tiles at once."""
    for batch in batches:
        row = np.repeat(np.arange(len(batch)), [len(x) for x in batch["ix"]])
        if not len(row):
            continue
        ix, iy, e, n = (np.concatenate(list(batch[c])) for c in ("ix", "iy", "e", "n"))
        order, top = _labelled(row, ix, iy)
        row, ix, iy, e, n = (v[order] for v in (row, ix, iy, e, n))
        yield pd.DataFrame({"packet": batch["packet"].to_numpy()[row], "ix": ix, "iy": iy, "e": e, "n": n, "rx": ix[top], "ry": iy[top]})


def _join_tiles(batches):
    """Roots of tiles that meet across borders, each with the least root that it reaches."""
    for batch in batches:
        for packet, pairs in zip(batch["packet"], batch["pairs"]):
            ends = np.array([(p["a"]["rx"], p["a"]["ry"], p["b"]["rx"], p["b"]["ry"]) for p in pairs], np.int64)
            roots, number = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
            number = number.reshape(-1, 2)
            top = _least_of_linked(len(roots), number[:, 0], number[:, 1])
            yield pd.DataFrame({"packet": [packet] * len(roots), "rx": roots[:, 0], "ry": roots[:, 1], "tx": roots[top, 0], "ty": roots[top, 1]})


def regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``region``: number of the connected region (4 neighbours) of a packet's
    cells, from 0 in the order of their least cells (ix, then iy).

    Two passes: cells are labelled tile by tile, so that a packet is many tasks;
    then labels on both sides of the tiles' borders are joined, and the distinct
    pairs of them (at most one for each cell of a border) settle which labels are
    one region. Cells given twice count once for the links and stay two rows.
    """
    kind = cells.schema["packet"].dataType.simpleString()
    tiles = cells.groupBy("packet", F.floor(F.col("ix") / tile).alias("bx"), F.floor(F.col("iy") / tile).alias("by")).agg(F.collect_list(F.struct("ix", "iy", "e", "n")).alias("c"))
    labelled = tiles.select("packet", *[F.col(f"c.{x}").alias(x) for x in ("ix", "iy", "e", "n")]).mapInPandas(_label_tiles, f"packet {kind}, ix int, iy int, e double, n double, rx int, ry int")

    def sides(across: str, along: str) -> list[Column]:
        place = lambda line, before: F.struct(F.lit(across).alias("axis"), line.alias("line"), F.col(along).alias("at"), F.lit(before).alias("before"))
        rest = F.pmod(F.col(across), F.lit(tile))
        return [F.when(rest == tile - 1, place(F.col(across) + 1, True)), F.when(rest == 0, place(F.col(across), False))]

    faced = labelled.select("packet", F.struct("rx", "ry").alias("root"), F.explode(F.array_compact(F.array(*sides("ix", "iy"), *sides("iy", "ix")))).alias("s"))
    met = faced.groupBy("packet", "s.axis", "s.line", "s.at").agg(F.max(F.when(F.col("s.before"), F.col("root"))).alias("a"), F.max(F.when(~F.col("s.before"), F.col("root"))).alias("b"))
    pairs = met.filter("a is not null and b is not null").groupBy("packet").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    joined = pairs.mapInPandas(_join_tiles, f"packet {kind}, rx int, ry int, tx int, ty int")
    roots = labelled.filter("ix = rx and iy = ry").select("packet", "rx", "ry").distinct().join(joined, ["packet", "rx", "ry"], "left")
    named = roots.select("packet", "rx", "ry", (F.dense_rank().over(W.partitionBy("packet").orderBy(F.coalesce("tx", "rx"), F.coalesce("ty", "ry"))) - 1).alias("region"))
    return labelled.join(named, ["packet", "rx", "ry"]).select("packet", "ix", "iy", "e", "n", "region")


def track_centroids(labelled: DataFrame, cell_m: float, top: int = 2, source_u: float = SOURCE_U) -> DataFrame:
    """packet, rank, e, n, u, area of the ``top`` largest regions of each packet."""
    g = labelled.groupBy("packet", "region").agg(F.avg("e").alias("e"), F.avg("n").alias("n"), (F.count("*") * cell_m * cell_m).alias("area"))
    ranked = g.withColumn("rank", F.row_number().over(W.partitionBy("packet").orderBy(F.desc("area"), "e", "n")))
    return ranked.filter(F.col("rank") <= top).select("packet", "rank", "e", "n", F.lit(source_u).alias("u"), "area")


def _band_tracks(fits: DataFrame, window: tuple[float, float, float, float], cell_m: float, source_u: float, spread_deg: float, top: int = 2) -> DataFrame:
    """``track_centroids`` of the regions of ``intersect_bands``, for windows of one tile: cells
    are labelled and summed where they are found, so they are neither rows nor shuffled."""

    def tracks(packet: np.ndarray, row: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> pd.DataFrame:
        e, n = window[0] + (ix + 0.5) * cell_m, window[2] + (iy + 0.5) * cell_m
        held = (e < window[1]) & (n < window[3])
        row, ix, iy, e, n = (v[held] for v in (row, ix, iy, e, n))
        if not len(row):
            return pd.DataFrame({"packet": packet[:0], "rank": [], "e": [], "n": [], "u": [], "area": []})
        order, root = _labelled(row, ix, iy)
        roots, label, count = np.unique(root, return_inverse=True, return_counts=True)
        e, n = (np.bincount(label, v[order]) / count for v in (e, n))
        mine, area = row[order][roots], count * cell_m * cell_m
        order = np.lexsort((n, e, -area, mine))
        rank = np.arange(len(order)) - np.searchsorted(mine[order], mine[order]) + 1
        order, rank = order[rank <= top], rank[rank <= top]
        return pd.DataFrame({"packet": packet[mine[order]], "rank": rank, "e": e[order], "n": n[order], "u": source_u, "area": area[order]})

    return _in_bands(fits, window, cell_m, source_u, spread_deg, tracks, "rank int, e double, n double, u double, area double")


def locate(fits: DataFrame, window: tuple[float, float, float, float], coarse_m: float = 5.0, parts: int = 5, source_u: float = SOURCE_U, spread_deg: float = SPREAD_DEG) -> DataFrame:
    """Track of all packets: cells, regions, centroids; a window of one tile keeps them within the packet."""
    cell_m = coarse_m / parts
    if max(window[1] - window[0], window[3] - window[2]) <= TILE * cell_m:
        return _band_tracks(fits, window, cell_m, source_u, spread_deg)
    return track_centroids(regions(fine_cells(fits, window, coarse_m, parts, source_u, spread_deg)), cell_m, source_u=source_u)
