"""Block-wise signal processing: band-pass, matched filter, envelope, spectra."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth_bandpass(f_lo: float, f_hi: float, fs: float, order: int = 6) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth band-pass."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (f_lo, f_hi))
    mid, width = np.sqrt(w1 * w2), w2 - w1
    k = np.arange(1, order + 1)
    low = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    turn = np.sqrt(low * low - mid * mid)
    analog = np.concatenate([low + turn, low - turn])
    poles = (2 * fs + analog) / (2 * fs - analog)
    gain = np.real(width**order * (2 * fs) ** order / np.prod(2 * fs - analog))
    upper = poles[np.imag(poles) > 0]
    upper = upper[np.argsort(np.abs(upper))]
    sos = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    sos[0, :3] *= gain
    return sos


def _edges(blocks: DataFrame, length: int, forward: bool) -> DataFrame:
    """channel, block_no, ``edge``: the ``length`` samples before (``forward``) or after each
    block, as far as the channel reaches.

    All blocks of a channel but the last are of one size, so a block knows which
    of its samples each later or earlier block needs; only these are sent.
    """
    size = blocks.agg(F.max(F.size("samples")).alias("n")).first().n or 1
    reach = max(1, -(-length // size))
    part = F.lit(length) - (F.col("k") - 1) * size
    sent = blocks.select("channel", F.col("block_no").alias("origin"), "samples", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"))
    if forward:
        cut = F.slice("samples", F.greatest(F.size("samples") - part + 1, F.lit(1)), F.greatest(part, F.lit(0)))
    else:
        cut = F.slice("samples", F.lit(1), F.greatest(part, F.lit(0)))
    target = F.col("origin") + F.col("k") if forward else F.col("origin") - F.col("k")
    parts = sent.select("channel", target.alias("block_no"), F.struct("origin", cut.alias("part")).alias("e")).groupBy("channel", "block_no").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return parts.select("channel", "block_no", F.flatten(F.transform("e", lambda x: x["part"])).alias("edge"))


def _joined(blocks: DataFrame, length: int, name: str, forward: bool) -> DataFrame:
    none = F.array().cast("array<double>")
    if not length:
        return blocks.withColumn(name, none)
    cut = F.slice("edge", F.greatest(F.size("edge") - length + 1, F.lit(1)), length) if forward else F.slice("edge", 1, length)
    met = blocks.join(_edges(blocks, length, forward), ["channel", "block_no"], "left")
    return met.withColumn(name, F.coalesce(cut, none)).drop("edge").select(*blocks.columns, name)


def _with_tail(blocks: DataFrame, length: int) -> DataFrame:
    """Blocks with ``tail``: the ``length`` samples before them, by a join on channel and block."""
    return _joined(blocks, length, "tail", True)


def _as_double(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("samples", F.col("samples").cast("array<double>"))


def state_space(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, b, c, d of a cascade of sections: state' = A state + b x, y = c state + d x."""
    n = 2 * len(sos)
    rows, v = np.zeros((n, n + 1)), np.eye(n + 1)[n]
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = b0 * v + np.eye(n + 1)[2 * k]
        rows[2 * k] = b1 * v - a1 * y + np.eye(n + 1)[2 * k + 1]
        rows[2 * k + 1] = b2 * v - a2 * y
        v = y
    return rows[:, :n], rows[:, n], v[:n], float(v[n])


def run_filter(space: tuple, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output of a filter over ``x`` from ``state``, and the state after it.

    The samples are cut into about sqrt(n) stretches that run from rest side by
    side; the states that they begin with follow by powers of the matrix, and
    what each adds to its stretch is one product.
    """
    A, b, c, d = space
    m = max(1, int(np.sqrt(len(x))))
    r = len(x) // m
    rows, y = x[: r * m].reshape(r, m), np.empty((r, m))
    held = np.zeros((r, len(b)))
    for k in range(m):
        y[:, k] = held @ c + d * rows[:, k]
        held = held @ A.T + rows[:, k, None] * b
    over, begin = np.linalg.matrix_power(A, m), np.empty((r, len(b)))
    for k in range(r):
        begin[k] = state
        state = over @ state + held[k]
    seen = np.empty((m, len(b)))  # what a state adds to the m outputs after it
    row = c
    for k in range(m):
        seen[k], row = row, row @ A
    out = np.empty(len(x))
    out[: r * m] = (y + begin @ seen.T).ravel()
    for k in range(r * m, len(x)):
        out[k] = c @ state + d * x[k]
        state = A @ state + b * x[k]
    return out, state


#: Blocks whose state maps are composed in one task.
SCAN_BLOCKS = 1024


def _entry_states(ends: DataFrame, A: np.ndarray) -> DataFrame:
    """channel, block_no, ``state`` that a block begins with, from the states ``end`` that
    blocks of ``n`` samples end in when they begin at rest.

    A block is the affine map state -> A^n state + end. Maps are composed within
    groups of SCAN_BLOCKS, then over the groups of a channel, and the states go
    back down: no task holds more than one row a block of a group, or one a group.
    """
    power = {}

    def after(n: int) -> np.ndarray:
        if n not in power:
            power[n] = np.linalg.matrix_power(A, n)
        return power[n]

    def through(rows: pd.DataFrame, state: np.ndarray) -> tuple[list, np.ndarray]:
        begins = []
        for n, end in zip(rows["n"], rows["end"]):
            begins.append(state.tolist())
            state = after(int(n)) @ state + np.asarray(end)
        return begins, state

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, end = through(rows.sort_values("block_no"), np.zeros(len(A)))
        return pd.DataFrame({"channel": [key[0]], "block_no": [key[1]], "n": [int(rows["n"].sum())], "end": [end.tolist()]})

    def over_groups(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        return pd.DataFrame({"channel": key[0], "part": rows["block_no"], "state": through(rows, np.zeros(len(A)))[0]})

    def down(key, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        return pd.DataFrame({"channel": key[0], "block_no": rows["block_no"], "state": through(rows, np.asarray(state["state"].iloc[0]))[0]})

    kind = ends.schema["channel"].dataType.simpleString()
    cells = ends.withColumn("part", F.floor(F.col("block_no") / SCAN_BLOCKS)).groupBy("channel", "part")
    groups = cells.applyInPandas(fold, f"channel {kind}, block_no long, n long, end array<double>")
    carried = groups.groupBy("channel").applyInPandas(over_groups, f"channel {kind}, part long, state array<double>")
    return cells.cogroup(carried.groupBy("channel", "part")).applyInPandas(down, f"channel {kind}, block_no long, state array<double>")


def bandpass(blocks: DataFrame, f_lo: float, f_hi: float, fs: float, order: int = 6) -> DataFrame:
    """Causal Butterworth band-pass of every channel along time, from rest: the exact recursion.

    Blocks run from rest by themselves; the states they end in are carried over
    the blocks of a channel as affine maps, and each block runs again from the
    state it really begins with. Only states leave a block. Blocks of a channel
    follow each other without gaps in order of block_no.
    """
    space = state_space(butterworth_bandpass(f_lo, f_hi, fs, order))
    rest = np.zeros(len(space[1]))
    held = _as_double(blocks)

    @F.pandas_udf("array<double>")
    def ending(x: pd.Series) -> pd.Series:
        return pd.Series([run_filter(space, np.asarray(v, float), rest)[1] for v in x])

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, begin: pd.Series) -> pd.Series:
        return pd.Series([run_filter(space, np.asarray(v, float), np.asarray(s))[0] for v, s in zip(x, begin)])

    ends = held.select("channel", F.col("block_no").cast("long").alias("block_no"), F.size("samples").cast("long").alias("n"), ending("samples").alias("end"))
    return held.join(_entry_states(ends, space[0]), ["channel", "block_no"]).withColumn("samples", run("samples", "state")).select(*blocks.columns)


#: Templates of more samples are correlated by Fourier transforms.
DIRECT_TAPS = 64


def correlate(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Sums of products of ``ref`` with every stretch of ``x`` that is as long."""
    if len(x) < len(ref):
        return np.zeros(0)
    if len(ref) <= DIRECT_TAPS:
        return np.correlate(x, ref, "valid")
    n = 1 << (len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(ref, n)), n)[: len(x) - len(ref) + 1]


def matched_filter(blocks: DataFrame, template: list[float]) -> DataFrame:
    """channel, block_no, start_sample, samples: correlation with the template
    wherever it fits wholly; the end of the block before joins in, so block
    borders leave no mark."""
    ref = np.asarray(template, float)
    held = _with_tail(_as_double(blocks), len(ref) - 1)

    @F.pandas_udf("array<double>")
    def run(tail: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([correlate(np.concatenate([np.asarray(a, float), np.asarray(b, float)]), ref) for a, b in zip(tail, x)])

    return held.select("channel", "block_no", (F.col("start_sample") - F.size("tail")).alias("start_sample"), run("tail", "samples").alias("samples"))


def matched_filter_native(blocks: DataFrame, template: list[float]) -> DataFrame:
    """``matched_filter`` for short templates in column functions."""
    held = _with_tail(_as_double(blocks), len(template) - 1)
    full = held.withColumn("x", F.concat("tail", "samples"))
    ref = F.array(*map(F.lit, map(float, template)))
    n = F.size("x") - len(template) + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    corr = F.transform(at, lambda k: F.aggregate(F.zip_with(F.slice("x", k, len(template)), ref, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return full.select("channel", "block_no", (F.col("start_sample") - F.size("tail")).alias("start_sample"), corr.alias("samples"))


class Grid(NamedTuple):
    """Layout of a transform over ``size`` points as ``rows`` x ``cols``: point n is row
    n // cols, column n % cols. ``exact`` if it is as long as the run."""

    size: int
    rows: int
    cols: int
    exact: bool


#: Points in a tile of columns or rows, about: the largest unit in memory is a few such.
TILE = 1 << 18
#: A run length whose best divisor leaves a side longer than this many tiles is padded.
LONG_SIDE = 4


def grid_of(n: int, tile: int = TILE) -> Grid:
    """Grid of a run of n samples: n itself if a divisor keeps both sides short, else
    the power of two that holds the run and all its shifts."""
    side = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    if n // side <= max(LONG_SIDE * math.isqrt(n), tile // 64):
        return Grid(n, side, n // side, True)
    bits = max(1, (2 * n - 2).bit_length())
    return Grid(1 << bits, 1 << bits // 2, 1 << bits - bits // 2, False)


def hilbert_kernel(n: int, k: np.ndarray) -> np.ndarray:
    """Imaginary part at shift k of the analytic signal of a unit pulse in a run of n samples."""
    k = k % n
    angle = np.pi * np.where(k, k, 1) / n
    value = np.where(k % 2, 2 / np.tan(angle), 0.0) if n % 2 == 0 else 1 / np.tan(angle) - np.where(k % 2, -1.0, 1.0) / np.sin(angle)
    return np.where(k, value / n, 0.0)


def _tiles(total: int, across: int, tile: int) -> int:
    """Lines (columns or rows) of ``across`` points in a tile."""
    return max(1, min(total, tile // across))


def _twiddle(g: Grid, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.exp(-2j * np.pi * ((rows[:, None] * cols[None, :]) % g.size) / g.size)


def imaginary_part(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """channel, block_no, ``quadrature``: imaginary part of the analytic signal of the whole
    run of a channel, as one transform over the run would give it.

    A four-step transform: the run is a grid of rows and columns. Tiles of columns
    are transformed and turned by their twiddle factors; one shuffle transposes;
    tiles of rows are transformed, filtered and transformed back; one shuffle
    transposes again, and tiles of columns are transformed back and dealt to
    their blocks. Run lengths without fitting divisors are convolved with the
    kernel of their length on a longer grid, which is exact too. Missing blocks
    are silent. No task holds more than a tile of lines of a channel.
    """
    spans = blocks.groupBy("channel").agg(F.min("start_sample").alias("first"), F.max(F.col("start_sample") + F.size("samples")).alias("stop")).select("channel", "first", (F.col("stop") - F.col("first")).alias("n"))
    kind = blocks.schema["channel"].dataType.simpleString()

    def deal(batches):
        """Samples of each block by tiles of columns."""
        for batch in batches:
            out = []
            for channel, block, at, n, x in zip(batch["channel"], batch["block_no"], batch["at"], batch["n"], batch["samples"]):
                g, x = grid_of(int(n), tile), np.asarray(x, float)
                width = _tiles(g.cols, g.rows, tile)
                place = (at + np.arange(len(x))) % g.cols // width
                out += [(channel, int(p), int(n), int(at), len(x), x[place == p].tobytes()) for p in np.unique(place)]
            yield pd.DataFrame(out, columns=["channel", "part", "n", "at", "count", "data"])

    def asked(batches):
        """Tiles of columns that each block takes its values from."""
        for batch in batches:
            out = []
            for channel, block, at, n, count in zip(batch["channel"], batch["block_no"], batch["at"], batch["n"], batch["count"]):
                g = grid_of(int(n), tile)
                hit = np.unique((at + np.arange(min(count, g.cols))) % g.cols // _tiles(g.cols, g.rows, tile))
                out += [(channel, int(p), block, int(at), int(count)) for p in hit]
            yield pd.DataFrame(out, columns=["channel", "part", "block_no", "at", "count"])

    def members(at: int, count: int, g: Grid, lo: int, hi: int) -> np.ndarray:
        """Points of a block of ``count`` samples from ``at`` that lie in columns lo..hi."""
        n = at + np.arange(count)
        return n[(n % g.cols >= lo) & (n % g.cols < hi)]

    def columns(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        g = grid_of(n, tile)
        width, height = _tiles(g.cols, g.rows, tile), _tiles(g.rows, g.cols, tile)
        lo = int(key[1]) * width
        cols = np.arange(lo, min(lo + width, g.cols))
        grid = np.zeros((g.rows, len(cols)))
        for at, count, data in zip(rows["at"], rows["count"], rows["data"]):
            place = members(int(at), int(count), g, lo, lo + len(cols))
            grid[place // g.cols, place % g.cols - lo] = np.frombuffer(data)
        turn = _twiddle(g, np.arange(g.rows), cols)
        done = [np.fft.fft(grid, axis=0) * turn]
        if not g.exact:
            shift = np.arange(g.rows)[:, None] * g.cols + cols[None, :]
            shift = np.where(shift < n, shift, shift - g.size)
            done.append(np.fft.fft(np.where(np.abs(shift) < n, hilbert_kernel(n, shift), 0.0), axis=0) * turn)
        cut = range(0, g.rows, height)
        return pd.DataFrame({"channel": key[0], "part": [k // height for k in cut], "n": n, "other": key[1], "data": [b"".join(np.ascontiguousarray(x[k : k + height]).tobytes() for x in done) for k in cut]})

    def over_rows(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        g = grid_of(n, tile)
        width, height = _tiles(g.cols, g.rows, tile), _tiles(g.rows, g.cols, tile)
        at = np.arange(int(key[1]) * height, min(int(key[1]) * height + height, g.rows))
        layers = [np.zeros((len(at), g.cols), complex) for _ in range(1 if g.exact else 2)]
        for other, data in zip(rows["other"], rows["data"]):
            both = np.frombuffer(data, complex).reshape(len(layers), len(at), -1)
            for layer, x in zip(layers, both):
                layer[:, int(other) * width : int(other) * width + x.shape[1]] = x
        spectrum = np.fft.fft(layers[0], axis=1)
        if g.exact:
            k = at[:, None] + g.rows * np.arange(g.cols)[None, :]
            spectrum *= np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))
        else:
            spectrum *= np.fft.fft(layers[1], axis=1)
        back = np.fft.ifft(spectrum, axis=1) * np.conj(_twiddle(g, at, np.arange(g.cols)))
        cut = range(0, g.cols, width)
        return pd.DataFrame({"channel": key[0], "part": [k // width for k in cut], "n": n, "other": key[1], "data": [np.ascontiguousarray(back[:, k : k + width]).tobytes() for k in cut]})

    def back(key, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        g = grid_of(n, tile)
        width = _tiles(g.cols, g.rows, tile)
        lo = int(key[1]) * width
        order = rows.sort_values("other")["data"]
        grid = np.concatenate([np.frombuffer(d, complex).reshape(-1, min(width, g.cols - lo)) for d in order])
        whole = np.fft.ifft(grid, axis=0)
        whole = whole.imag if g.exact else whole.real
        out = []
        for block, at, count in zip(wanted["block_no"], wanted["at"], wanted["count"]):
            place = members(int(at), int(count), g, lo, lo + whole.shape[1])
            out.append((key[0], block, int(at), int(count), n, int(key[1]), np.ascontiguousarray(whole[place // g.cols, place % g.cols - lo]).tobytes()))
        return pd.DataFrame(out, columns=["channel", "block_no", "at", "count", "n", "part", "data"])

    def joined(key, rows: pd.DataFrame) -> pd.DataFrame:
        g, at, count = grid_of(int(rows["n"].iloc[0]), tile), int(rows["at"].iloc[0]), int(rows["count"].iloc[0])
        place = (at + np.arange(count)) % g.cols // _tiles(g.cols, g.rows, tile)
        y = np.empty(count)
        for part, data in zip(rows["part"], rows["data"]):
            y[place == part] = np.frombuffer(data)
        return pd.DataFrame({"channel": [key[0]], "block_no": [key[1]], "quadrature": [y]})

    placed = blocks.join(spans, "channel").withColumn("at", F.col("start_sample") - F.col("first")).withColumn("block_no", F.col("block_no").cast("long"))
    dealt = placed.select("channel", "block_no", "at", "n", F.col("samples").cast("array<double>").alias("samples")).mapInPandas(deal, f"channel {kind}, part long, n long, at long, count long, data binary")
    wanted = placed.select("channel", "block_no", "at", "n", F.size("samples").cast("long").alias("count")).mapInPandas(asked, f"channel {kind}, part long, block_no long, at long, count long")
    first = dealt.groupBy("channel", "part").applyInPandas(columns, f"channel {kind}, part long, n long, other long, data binary")
    middle = first.groupBy("channel", "part").applyInPandas(over_rows, f"channel {kind}, part long, n long, other long, data binary")
    pieces = middle.groupBy("channel", "part").cogroup(wanted.groupBy("channel", "part")).applyInPandas(back, f"channel {kind}, block_no long, at long, count long, n long, part long, data binary")
    return pieces.groupBy("channel", "block_no").applyInPandas(joined, f"channel {kind}, block_no long, quadrature array<double>")


def envelope(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Magnitude of the analytic signal of the channel's whole run over its largest (0 counts as 1).

    See ``imaginary_part``: block borders and sizes leave no mark, slow parts are
    not damped. Blocks without samples stay empty.
    """
    held = _as_double(blocks).withColumn("block_no", F.col("block_no").cast("long"))
    some = held.filter(F.size("samples") > 0)
    met = held.join(imaginary_part(some, tile), ["channel", "block_no"], "left")
    made = met.withColumn("samples", F.coalesce(F.zip_with("samples", "quadrature", lambda a, b: F.hypot(a, b)), "samples")).drop("quadrature")
    top = made.groupBy("channel").agg(F.max(F.array_max("samples")).alias("__m"))
    scale = F.when(F.col("__m") > 0, F.col("__m")).otherwise(1.0)
    return made.join(top, "channel").withColumn("samples", F.transform("samples", lambda x: x / scale)).select(*blocks.columns)


def noise_psd(windows: DataFrame, fs: float, win: int = 1024, hop: int = 512, offset_db: float = 180.0) -> DataFrame:
    """channel, freq, psd_db of windows (channel, packet, samples): Hann frames,
    without the first and last one, mean power over frames and packets in dB."""
    n = F.floor((F.size("samples") - win) / hop).cast("int")
    frames = windows.filter(n >= 2).select("channel", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice("samples", k * hop + 1, win))).alias("x"))
    taper = np.hanning(win)

    @F.pandas_udf("array<double>")
    def power(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(x.to_numpy()).astype(float) * taper)) ** 2 / (fs * (taper**2).sum())))

    each = frames.select("channel", F.posexplode(power("x")).alias("k", "p"))
    return each.groupBy("channel", "k").agg(F.avg("p").alias("p")).select("channel", (F.col("k") * fs / win).alias("freq"), F.when(F.col("p") > 0, 10 * F.log10("p") + offset_db).alias("psd_db"))
