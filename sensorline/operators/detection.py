"""Packet detection: expected arrivals, peaks, and the interval join of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.operators.joins import within_join


def expected_arrivals(runs: DataFrame) -> DataFrame:
    """run_id, packet, target of runs (run_id, offset, period, n_packets)."""
    return runs.select("run_id", "offset", "period", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_packets") - 1)).alias("packet")).select("run_id", "packet", (F.col("offset") + F.col("packet") * F.col("period")).alias("target"))


def estimate_run(peaks: DataFrame) -> DataFrame:
    """offset, period, n_packets of an unknown run from peaks (channel, peak):
    median first peak, median gap, and the median span divided by that gap plus one."""
    w = W.partitionBy("channel").orderBy("peak")
    gaps = peaks.withColumn("gap", F.col("peak") - F.lag("peak").over(w))
    ends = peaks.groupBy("channel").agg(F.min("peak").alias("first"), (F.max("peak") - F.min("peak")).alias("span"))
    period = gaps.agg(F.percentile("gap", 0.5).alias("period"))
    rest = ends.agg(F.percentile("first", 0.5).alias("offset"), F.percentile("span", 0.5).alias("span"))
    return rest.join(period).select("offset", "period", (F.round(F.col("span") / F.col("period")) + 1).cast("long").alias("n_packets"))


def default_tolerance(peaks: DataFrame) -> DataFrame:
    """Three population standard deviations of the channels' first peaks."""
    return peaks.groupBy("channel").agg(F.min("peak").alias("first")).agg((3 * F.stddev_pop("first")).alias("tol"))


def assign_peaks(peaks: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """packet, channel, sample_idx: each target takes the earliest peak of a
    channel with |peak - target| <= tol; targets without one are left out."""
    near = within_join(peaks.select("channel", "peak"), targets.select("packet", "target"), "peak", "target", tol)
    return near.groupBy("packet", "channel").agg(F.min("peak").alias("sample_idx"))


#: Samples in a cell: the unit of work of the peak search. A channel is as many tasks as it has cells.
CELL = 1 << 16


def _cells(series: DataFrame, cell: int, on: str = "channel", order: str = "sample_idx", value: str = "value") -> DataFrame:
    """channel, cell and the samples of a cell in order, as arrays ``at`` and ``v``; null values are left out."""
    at = F.col(order).cast("long")
    held = series.select(F.col(on).alias("channel"), F.floor(at / cell).alias("cell"), at.alias("at"), F.col(value).cast("double").alias("v")).filter("v is not null")
    packed = held.groupBy("channel", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))
    return packed.select("channel", "cell", F.col("s.at").alias("at"), F.col("s.v").alias("v"))


def _each(df: DataFrame, body, schema: str, by: str | None = None) -> DataFrame:
    """Rows (tuples) that ``body`` makes of each row; many rows are one Arrow batch.

    Rows with long arrays give ``by``, which tells them apart within their channel: a batch
    holds as many rows however long they are, so these are handed over one by one.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def made(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [out for row in batch.itertuples(index=False) for out in body(row)]
        return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: [] for c in names})

    if by is not None:
        return df.groupBy("channel", by).applyInPandas(lambda rows: made(rows), schema)
    return df.mapInPandas(lambda batches: map(made, batches), schema)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and one past their last places."""
    start = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
    return start, np.concatenate([start[1:], [len(v)]])


def _summary(row) -> list[tuple]:
    """What other cells need to know of a cell: its size, its first and last run and the value next to each, its extremes."""
    v = row.v
    start, stop = _runs(v)
    more = len(start) > 1
    return [(row.channel, row.cell, len(v), v[0], int(stop[0]), v[start[1]] if more else np.nan, v[-1], int(len(v) - start[-1]), v[start[-2]] if more else np.nan)]


_SUMMARY = ("n", "first", "first_n", "second", "last", "last_n", "before_last")


def _linked(row) -> list[tuple]:
    """For each cell of a channel: rows by which its first run begins before it and what value precedes the run,
    and the same for its last run ahead (not a number: the channel ends)."""

    def along(cells: list, near: str, near_n: str, far: str, far_n: str, next_to_far: str) -> list[tuple]:
        out = []
        value, count, beyond = np.nan, 0, np.nan  # the run that ends where this cell begins
        for c in cells:
            same = c[near] == value
            out.append((count if same else 0, beyond if same else value))
            if c[near_n] == c["n"]:  # one run: it goes on through the cell
                count, beyond = (count + c["n"] if same else c["n"]), (beyond if same else value)
            else:
                count, beyond = c[far_n], c[next_to_far]
            value = c[far]
        return out

    cells = sorted(row.cells, key=lambda c: c["cell"])
    back = along(cells, "first", "first_n", "last", "last_n", "before_last")
    ahead = along(cells[::-1], "last", "last_n", "first", "first_n", "second")[::-1]
    return [(row.channel, c["cell"], int(x[0]), x[1], int(y[0]), y[1]) for c, x, y in zip(cells, back, ahead)]


def local_maxima(series: DataFrame, height: float, value: str = "value", order: str = "sample_idx", on: str = "channel", cell: int = CELL) -> DataFrame:
    """``on``, peak, level: strict rises into and falls out of a level of at least ``height``.

    A plateau counts once, at its middle (the earlier one of two). The first
    and the last sample are no maxima. Cells of ``cell`` samples are searched side by
    side; a table with a row per cell links runs that reach over borders. Places
    are distinct within a channel; null values are left out.
    """
    kind = series.schema[on].dataType.simpleString()
    cells = _cells(series, cell, on, order, value)
    ends = _each(cells, _summary, f"channel {kind}, cell long, n long, first double, first_n long, second double, last double, last_n long, before_last double", "cell")
    links = _each(ends.groupBy("channel").agg(F.collect_list(F.struct("cell", *_SUMMARY)).alias("cells")), _linked, f"channel {kind}, cell long, back long, before double, ahead long, after double")

    def pick(row) -> list[tuple]:
        at, v = row.at, row.v
        start, stop = _runs(v)
        level, a, b = v[start], start.copy(), stop - 1
        before, after = np.concatenate([[row.before], level[:-1]]), np.concatenate([level[1:], [row.after]])
        a[0] -= row.back
        b[-1] += row.ahead
        middle = (a + b) // 2
        found = (level > before) & (level > after) & (level >= height) & (middle >= 0) & (middle < len(v))
        return [(row.channel, p, x) for p, x in zip(at[middle[found]].tolist(), level[found].tolist())]

    return _each(cells.join(links, ["channel", "cell"]), pick, f"channel {kind}, peak long, level double", "cell").withColumnRenamed("channel", on)


def _thin(at: np.ndarray, level: np.ndarray, distance: int, unsure: np.ndarray) -> np.ndarray:
    """Greedy choice by level (ties: the earlier one first): 1 kept, 0 dropped, -1 open.

    ``unsure`` peaks may have neighbours that are not here, so they are never
    kept, and what depends on them stays open.
    """
    state = np.full(len(at), 2)
    for k in np.lexsort((at, -level)):
        if state[k] == 0:
            continue
        a, b = np.searchsorted(at, at[k] - distance, "right"), np.searchsorted(at, at[k] + distance)
        near = np.arange(a, b)
        lower = near[(level[a:b] < level[k]) | (level[a:b] == level[k]) & (near > k)]
        if unsure[k] or state[k] == -1:
            state[k] = -1
            state[lower[state[lower] == 2]] = -1
        else:
            state[k] = 1
            state[lower] = 0
    return state


def keep_distant(peaks: DataFrame, distance: int, zone: int | None = None) -> DataFrame:
    """The peaks (channel, peak, level) that remain if the highest is taken first and
    all others nearer than ``distance`` go, and so on; ties take the earlier one.

    Zones of several distances decide side by side, knowing the peaks up to two
    distances beyond their borders; what depends on peaks further away stays open.
    Open peaks are then decided along stretches between gaps of ``distance`` or
    more, in which the choice does not depend on others: few are left, unless
    levels rise without end from zone to zone.
    """
    if distance <= 1:
        return peaks.select("channel", "peak", "level")
    kind = peaks.schema["channel"].dataType.simpleString()
    width = zone or max(16 * distance, CELL)
    halo = 2 * distance
    held = peaks.select("channel", F.col("peak").cast("long").alias("peak"), F.col("level").cast("double").alias("level"))
    own = F.floor(F.col("peak") / width)
    near = held.withColumn("own", own).withColumn("zone", F.explode(F.sequence(F.floor((F.col("peak") - halo) / width), F.floor((F.col("peak") + halo) / width))))

    def decide(row) -> list[tuple]:
        at, level, owner = (np.array([x[c] for x in row.peaks]) for c in ("peak", "level", "own"))
        lo, hi = row.zone * width, row.zone * width + width
        state = _thin(at, level, distance, (at - distance < lo - halo) | (at + distance > hi + halo))
        left = (owner == row.zone) & (state != 0)
        return [(row.channel, *x) for x in zip(at[left].tolist(), level[left].tolist(), state[left].tolist())]

    zones = near.groupBy("channel", "zone").agg(F.sort_array(F.collect_list(F.struct("peak", "level", "own"))).alias("peaks"))
    first = _each(zones, decide, f"channel {kind}, peak long, level double, state long", "zone")
    w = W.partitionBy("channel").orderBy("peak")  # kept ones, a distance apart, and the few open ones
    gap = F.coalesce((F.col("peak") - F.lag("peak").over(w) >= distance).cast("long"), F.lit(1))
    runs = first.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    open_runs = W.partitionBy("channel", "run")
    split = runs.withColumn("open", F.min("state").over(open_runs) < 0)

    def settle(row) -> list[tuple]:
        at, level, state = (np.array([x[c] for x in row.peaks]) for c in ("peak", "level", "state"))
        # what is kept already stands above all its neighbours
        kept = _thin(at, np.where(state == 1, np.inf, level), distance, np.zeros(len(at), bool)) == 1
        return [(row.channel, *x) for x in zip(at[kept].tolist(), level[kept].tolist())]

    stretches = split.filter("open").groupBy("channel", "run").agg(F.sort_array(F.collect_list(F.struct("peak", "level", "state"))).alias("peaks"))
    settled = _each(stretches, settle, f"channel {kind}, peak long, level double")
    return split.filter("not open").select("channel", "peak", "level").unionByName(settled)


def _ground(at: np.ndarray, v: np.ndarray, place: int, level: float) -> list[tuple[str, float, bool]]:
    """On either side of a place: the lowest sample up to higher ground, and whether these samples hold that."""
    k = int(np.searchsorted(at, place))
    higher, beyond = np.flatnonzero(v[:k] > level), np.flatnonzero(v[k + 1 :] > level)
    left = v[higher[-1] + 1 : k + 1] if len(higher) else v[: k + 1]
    right = v[k : k + 1 + beyond[0]] if len(beyond) else v[k:]
    return [("left", float(left.min()), len(higher) > 0), ("right", float(right.min()), len(beyond) > 0)]


def _seek(top: np.ndarray, low: np.ndarray, begin: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the first cell from ``begin`` on whose top is above ``level`` (or the
    end), and the lowest low of the cells passed: descent in a sparse table."""
    n = len(top)
    tops, lows = [top], [low]
    while 2 << len(tops) - 1 <= n:
        half = 1 << len(tops) - 1
        tops.append(np.maximum(tops[-1][: len(tops[-1]) - half], tops[-1][half:]))
        lows.append(np.minimum(lows[-1][: len(lows[-1]) - half], lows[-1][half:]))
    at, least = begin.copy(), np.full(len(begin), np.inf)
    for k in range(len(tops) - 1, -1, -1):
        fits = at + (1 << k) <= n
        place = np.where(fits, at, 0)
        go = fits & (tops[k][place] <= level)
        least = np.where(go, np.minimum(least, lows[k][place]), least)
        at = np.where(go, at + (1 << k), at)
    return at, least


#: Cells whose peaks look for higher ground together in their channel's table.
TABLE_CELLS = 64


def prominences(series: DataFrame, peaks: DataFrame, cell: int = CELL) -> DataFrame:
    """channel, peak, level, prominence: how far a peak rises above the higher of the
    lowest grounds on either side, up to where the series is higher than the peak.

    Each cell answers for its own peaks; a peak that finds no higher ground in its
    cell looks it up in the table of the cells' extremes, and the cell found there
    answers for its part. Peaks must be places of the series.
    """
    kind = series.schema["channel"].dataType.simpleString()
    cells = _cells(series, cell)
    mine = peaks.groupBy("channel", F.floor(F.col("peak") / cell).alias("cell")).agg(F.collect_list(F.struct("peak", "level")).alias("peaks"))

    def within(row) -> list[tuple]:
        return [(row.channel, row.cell, x["peak"], x["level"], side, ground, done) for x in row.peaks for side, ground, done in _ground(row.at, row.v, x["peak"], x["level"])]

    side_rows = f"channel {kind}, cell long, peak long, level double, side string, ground double"
    local = _each(cells.join(mine, ["channel", "cell"]), within, f"{side_rows}, done boolean", "cell")
    table = cells.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("cell", F.array_max("v").alias("top"), F.array_min("v").alias("low")))).alias("table"))
    searching = local.filter("not done").groupBy("channel", F.floor(F.col("cell") / TABLE_CELLS).alias("part")).agg(F.collect_list(F.struct("cell", "peak", "level", "side", "ground")).alias("sides"))

    def ask(row) -> list[tuple]:
        """Each side with the cell that has to answer for the rest (-1: none does)."""
        names, top, low = (np.array([x[c] for x in row.table]) for c in ("cell", "top", "low"))
        out = []
        for side, order in (("left", slice(None, None, -1)), ("right", slice(None))):
            asked = [x for x in row.sides if x["side"] == side]
            place = np.searchsorted(names, [x["cell"] for x in asked])
            begin = len(names) - place if side == "left" else place + 1
            at, least = _seek(top[order], low[order], np.asarray(begin, int), np.array([x["level"] for x in asked], float))
            for x, k, ground in zip(asked, at.tolist(), least.tolist()):
                out.append((row.channel, int(names[order][k]) if k < len(names) else -1, x["peak"], x["level"], side, min(ground, x["ground"]), k == len(names)))
        return out

    sought = _each(searching.join(table, "channel"), ask, f"{side_rows}, done boolean", "part")
    questions = sought.filter("not done").groupBy("channel", "cell").agg(F.collect_list(F.struct("peak", "level", "side", "ground")).alias("sides"))

    def answer(row) -> list[tuple]:
        out = []
        for x in row.sides:
            higher = np.flatnonzero(row.v > x["level"])
            part = row.v[higher[-1] + 1 :] if x["side"] == "left" else row.v[: higher[0]]
            out.append((row.channel, row.cell, x["peak"], x["level"], x["side"], min(x["ground"], part.min()) if len(part) else x["ground"]))
        return out

    answered = _each(cells.join(questions, ["channel", "cell"]), answer, side_rows, "cell")
    sides = local.filter("done").drop("done").unionByName(sought.filter("done").drop("done")).unionByName(answered)
    return sides.groupBy("channel", "peak", "level").agg((F.col("level") - F.max("ground")).alias("prominence"))


def find_peaks(series: DataFrame, height: float, prominence: float, distance: int, cell: int = CELL) -> DataFrame:
    """channel, peak, level, prominence of peaks that are high enough, stay
    ``distance`` samples from higher ones that are kept, and rise ``prominence`` above
    the higher of the two valleys between them and higher ground (or the end).

    A channel is worked on in cells of ``cell`` samples; per channel there is only
    a row a cell, and the kept peaks.
    """
    kept = keep_distant(local_maxima(series, height, cell=cell), distance)
    return prominences(series, kept, cell).filter(F.col("prominence") >= prominence)


def detect_packets(envelopes: DataFrame, runs: DataFrame, tol: float, height: float = 0.05, prominence: float = 0.025, distance: int = 500_000) -> DataFrame:
    """Arrivals (packet, channel, sample_idx) of envelopes (channel, sample_idx, value) in one run."""
    return assign_peaks(find_peaks(envelopes, height, prominence, distance), expected_arrivals(runs), tol)
