"""Direction finding: axes, robust line fits per packet and subarray, cone angles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.operators import slopes

SPEED = 1475.0
KEYS = ("packet", "subarray_id")


def principal_axis_2d(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Unit axis (ax, ay) of the points (x, y) of each group, pointing from the
    first channel to the last; in closed form from the covariances."""
    g = points.groupBy(*keys).agg(
        F.var_pop("x").alias("cxx"), F.var_pop("y").alias("cyy"), F.covar_pop("x", "y").alias("cxy"),
        F.min_by(F.struct("x", "y"), "channel").alias("a"), F.max_by(F.struct("x", "y"), "channel").alias("b"),
    )
    turn = 0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    ax, ay = F.cos(turn), F.sin(turn)
    sign = F.when((F.col("b.x") - F.col("a.x")) * ax + (F.col("b.y") - F.col("a.y")) * ay < 0, -1.0).otherwise(1.0)
    return g.select(*keys, (sign * ax).alias("ax"), (sign * ay).alias("ay"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leading(ee: pd.Series, en: pd.Series, eu: pd.Series, nn: pd.Series, nu: pd.Series, uu: pd.Series) -> pd.Series:
    """Eigenvectors of the largest eigenvalues of a batch of covariances."""
    m = np.stack([np.stack(r, -1) for r in ((ee, en, eu), (en, nn, nu), (eu, nu, uu))], -2)
    return pd.Series(list(np.linalg.eigh(m)[1][:, :, 2]))


def principal_axis(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Unit axis (ax, ay, az) of the points (e, n, u) of each group.

    The six covariances are one aggregation; the eigenvectors of all groups of
    a batch are taken at once.
    """
    axes = ("e", "n", "u")
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    g = points.groupBy(*keys).agg(
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs],
        F.min_by(F.struct(*axes), "channel").alias("a"), F.max_by(F.struct(*axes), "channel").alias("b"),
    )

    v = g.withColumn("v", _leading(*[F.col(f"c{a}{b}") for a, b in pairs]))
    dot = sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) * F.get("v", F.lit(k)) for k, c in enumerate(axes)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    return v.select(*keys, *[(sign * F.get("v", F.lit(k))).alias(f"a{c}") for k, c in enumerate("xyz")])


def packet_lines(points: DataFrame, coords: tuple[str, ...] = ("e", "n", "u"), from_first: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per group: axis ax, ay (az for three ``coords``), mean place re, rn,
    ru and ``line``, its (channel, s, t) in order of channels. ``s`` is the place
    along the axis from the first channel (or from the least place).

    ``points`` has the keys, channel, t and e, n, u. A group is the channels of a
    subarray, some dozens; all of it comes from one aggregation.
    """
    held = points.select(*keys, "channel", "t", "e", "n", "u")
    pairs = [(a, b) for i, a in enumerate(coords) for b in coords[i:]]
    g = held.groupBy(*keys).agg(
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs],
        *[F.avg(c).alias(f"r{c}") for c in ("e", "n", "u")],
        F.array_sort(F.collect_list(F.struct("channel", "t", *coords))).alias("p"),
    )
    if len(coords) == 2:
        turn = 0.5 * F.atan2(2 * F.col("cen"), F.col("cee") - F.col("cnn"))
        raw = [F.cos(turn), F.sin(turn)]
    else:
        g = g.withColumn("v", _leading(*[F.col(f"c{a}{b}") for a, b in pairs]))
        raw = [F.get("v", F.lit(k)) for k in range(3)]
    ends = F.element_at("p", -1), F.element_at("p", 1)
    dot = sum(((ends[0][c] - ends[1][c]) * v for c, v in zip(coords[1:], raw[1:])), (ends[0][coords[0]] - ends[1][coords[0]]) * raw[0])
    names = ("ax", "ay", "az")[: len(coords)]
    g = g.withColumn("sign", F.when(dot < 0, -1.0).otherwise(1.0))
    g = g.withColumns({a: F.col("sign") * v for a, v in zip(names, raw)})

    def place(x: Column) -> Column:
        return sum((x[c] * F.col(a) for c, a in zip(coords[1:], names[1:])), x[coords[0]] * F.col("ax"))

    g = g.withColumn("at", F.transform("p", place))
    start = F.get("at", F.lit(0)) if from_first else F.array_min("at")
    g = g.withColumn("start", start)
    line = F.zip_with("p", "at", lambda x, at: F.struct(x["channel"].alias("channel"), (at - F.col("start")).alias("s"), x["t"].alias("t")))
    return g.select(*keys, *names, "re", "rn", "ru", line.alias("line"))


def line_points(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows keys, channel, s, t of ``packet_lines``.

    The generator is given an expression: for a plain column Spark infers a filter on
    its size and works out the whole line once more for it, again for each point.
    """
    return lines.select(*keys, F.inline(F.when(F.size("line") > 0, F.col("line"))))


def gather_line(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Points (keys, channel, s, t) as one row per group with ``line``, in order of channels."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("channel", "s", "t"))).alias("line"))


def _let(value: Column, body) -> Column:
    """Work ``value`` out once and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ols_line(line: Column) -> Column:
    """slope and intercept of the least-squares line through an array of (s, t);
    null where all s are equal."""
    mean = lambda f: F.try_divide(F.aggregate(line, F.lit(0.0), lambda a, p: a + p[f]), F.size(line))

    def fitted(m: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("ss"), F.lit(0.0).alias("st"))
        step = lambda a, p: F.struct((a["ss"] + (p["s"] - m["s"]) * (p["s"] - m["s"])).alias("ss"), (a["st"] + (p["s"] - m["s"]) * (p["t"] - m["t"])).alias("st"))
        slope = _let(F.aggregate(line, start, step), lambda v: F.when(v["ss"] > 0, v["st"] / v["ss"]))
        return _let(slope, lambda b: F.struct(b.alias("slope"), (m["t"] - b * m["s"]).alias("intercept")))

    return _let(F.struct(mean("s").alias("s"), mean("t").alias("t")), fitted)


def _median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2

    return _let(F.sort_array(values), middle)


def theil_sen_line(line: Column) -> Column:
    """Median of the slopes of all pairs of an array of (s, t), and the median of t - slope * s."""
    slopes = F.flatten(F.transform(line, lambda a: F.transform(F.filter(line, lambda b: b["s"] > a["s"]), lambda b: (b["t"] - a["t"]) / (b["s"] - a["s"]))))
    return _let(_median(slopes), lambda k: F.struct(k.alias("slope"), _median(F.transform(line, lambda p: p["t"] - k * p["s"])).alias("intercept")))


#: Numbers in an array of many groups that are worked on together, about.
TOGETHER = 1 << 19


def _by_size(s_all: pd.Series, t_all: pd.Series, least: int, each: int = 1):
    """Rows of a batch whose lines have one size of at least ``least``, and their s and t as rows
    of arrays; ``each`` tells how many numbers a point needs."""
    size = np.array([-1 if s is None else len(s) for s in s_all], int)
    flat = [np.concatenate([np.zeros(0), *(np.asarray(v, float) for v in x if v is not None)]) for x in (s_all, t_all)]
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for n in np.unique(size[size >= least]):
        same = np.flatnonzero(size == n)
        step = max(1, TOGETHER // max(1, int(n) * each))
        for begin in range(0, len(same), step):
            rows = same[begin : begin + step]
            at = start[rows, None] + np.arange(n)
            yield rows, flat[0][at], flat[1][at]


def ransac_line(line: Column, key: Column, trials: int = 200, seed: int = 0) -> Column:
    """slope and intercept of seeded RANSAC over an array of (s, t): samples of 3,
    inliers within the median absolute deviation of t, least squares over the
    best set. The draws follow from ``key``, so partitions do not matter; lines of
    one size are fitted together."""

    @F.pandas_udf("struct<slope double, intercept double>")
    def fit(s_all: pd.Series, t_all: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = np.full((len(keys), 2), np.nan)
        keys = keys.to_numpy()
        for rows, s, t in _by_size(s_all, t_all, 3, trials):
            limit = np.median(np.abs(t - np.median(t, 1, keepdims=True)), 1)
            drawn = np.empty((len(rows), trials, s.shape[1]))
            for k, row in enumerate(rows):
                np.random.default_rng([seed, int(keys[row]) & (1 << 63) - 1]).random(out=drawn[k])
            pick = drawn.argsort(2)[:, :, :3]
            of = np.arange(len(rows))[:, None, None]
            ps, pt = s[of, pick], t[of, pick]
            ms, mt = ps.mean(2), pt.mean(2)
            ds, dt = ps - ms[:, :, None], pt - mt[:, :, None]
            across = (ds * ds).sum(2)
            slope = np.divide((ds * dt).sum(2), across, out=np.full(across.shape, np.nan), where=across > 0)
            off = mt - slope * ms
            inside = np.abs(t[:, None] - slope[:, :, None] * s[:, None] - off[:, :, None]) <= limit[:, None, None]
            best = inside[np.arange(len(rows)), inside.sum(2).argmax(1)]
            best[~best.any(1)] = True
            held = best.sum(1)
            for m in np.unique(held):
                mine = np.flatnonzero(held == m)
                x, y = (v[mine][best[mine]].reshape(-1, m) for v in (s, t))
                mx, my = x.mean(1), y.mean(1)
                x, y = x - mx[:, None], y - my[:, None]
                xx, xy = (np.array([a @ b for a, b in zip(x, v)]) for v in (x, y))
                good = xx > 0
                a = xy[good] / xx[good]
                out[rows[mine[good]]] = np.stack([a, my[good] - a * mx[good]], 1)
        return pd.DataFrame(out, columns=["slope", "intercept"])

    return fit(line["s"], line["t"], key)


def ols_lines(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``ols_fit`` of rows with ``line``, within the row. Points without s or t count in n only."""
    told = F.filter("line", lambda p: p["s"].isNotNull() & p["t"].isNotNull())
    return _fit_lines(lines, keys, _let(told, ols_line))


def ols_fit(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """slope, intercept, n of the least-squares line t over s."""
    return points.groupBy(*keys).agg(F.regr_slope("t", "s").alias("slope"), F.regr_intercept("t", "s").alias("intercept"), F.count("*").alias("n"))


def _fit_lines(lines: DataFrame, keys: tuple[str, ...], model: Column) -> DataFrame:
    """slope, intercept and n of rows with ``line``. The fit becomes a generated row, so that
    filters on it stay above it and it is worked out once."""
    held = lines.select(*keys, F.size("line").cast("long").alias("n"), model.alias("m"))
    return held.select(*keys, F.inline(F.array(F.struct("m.slope", "m.intercept", "n"))))


def _middle(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Medians of the first ``count`` of the sorted numbers of each row."""
    at = np.arange(len(v))
    return (v[at, (count - 1) // 2] + v[at, count // 2]) / 2 + 0.0


@F.pandas_udf(T.StructType([T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType())]))
def _theil_sen(s_all: pd.Series, t_all: pd.Series) -> pd.DataFrame:
    """Median slopes of a batch of lines and the medians of t - slope * s; nothing for a null
    line. Lines of one size of up to ``slopes.FEW`` points form all their pairs together."""
    out = np.full((len(s_all), 2), np.nan)
    for rows, s, t in _by_size(s_all, t_all, 2, slopes.FEW):
        if s.shape[1] > slopes.FEW:
            for row, x, y in zip(rows, s, t):
                slope = slopes.median_slope(x, y)
                if slope == slope:
                    out[row] = slope, np.median(y - slope * x)
            continue
        a, b = np.triu_indices(s.shape[1], 1)
        ds, dt = s[:, b] - s[:, a], t[:, b] - t[:, a]
        count = (ds != 0).sum(1)
        rows, s, t, ds, dt, count = (v[count > 0] for v in (rows, s, t, ds, dt, count))
        if not len(rows):
            continue
        slope = _middle(np.sort(np.divide(dt, ds, out=np.full(ds.shape, np.nan), where=ds != 0), 1), count)
        rest = np.sort(t - slope[:, None] * s, 1)
        out[rows] = np.stack([slope, _middle(rest, np.full(len(rows), s.shape[1]))], 1)
    return pd.DataFrame(out, columns=["slope", "intercept"])


def theil_sen_lines(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``theil_sen_fit`` of rows with ``line``, within the row."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x)
    told = lines.select(*keys, F.filter("line", lambda p: whole(p["s"]) & whole(p["t"])).alias("line"))
    return _fit_lines(told, keys, _theil_sen("line.s", "line.t")).filter("slope is not null")


def theil_sen_fit(points: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """slope (median of the slopes of all pairs) and intercept (median of t - slope * s).

    In groups of over ``slopes.FEW`` points the median is found by counting
    inversions, so all channels of a cable need no array of all pairs; smaller ones
    form their pairs, many groups at once. Both give the same bits. Points without s
    or t are left out; groups without a pair of different s give no row.
    """
    return theil_sen_lines(gather_line(points, keys), keys)


def _dealt(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points dealt by their keys over all shuffle partitions: the rows are few
    bytes but much work, which size-based merging of partitions does not see."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ransac_fit(points: DataFrame, trials: int = 200, keys: tuple[str, ...] = KEYS, seed: int = 0) -> DataFrame:
    """slope, intercept, n of ``ransac_line``; null for groups of fewer than 3 points."""
    return ransac_lines(gather_line(points, keys), trials, keys, seed)


def ransac_lines(lines: DataFrame, trials: int = 200, keys: tuple[str, ...] = KEYS, seed: int = 0) -> DataFrame:
    """``ransac_fit`` of rows with ``line`` in order of channels, within the row."""
    return _fit_lines(lines, keys, ransac_line(F.col("line"), F.xxhash64(*keys), trials, seed))


#: Fits over rows and what they do over an array of (s, t).
LINES = {ols_fit: ols_line, theil_sen_fit: theil_sen_line}


def _trimmed(first: float, second: float):
    """Counts, last slope and residual figures of ``trimmed_lines`` by least squares, for
    the lines of a batch; those of one size are worked on together."""
    names = ["channels_available", "n_inliers_stage1", "n_inliers_stage2", "slope", "rms", "most"]

    @F.pandas_udf(", ".join(f"{c} {'double' if k > 2 else 'long'}" for k, c in enumerate(names)))
    def fit(s_all: pd.Series, t_all: pd.Series) -> pd.DataFrame:
        out = np.full((len(s_all), 6), np.nan)
        out[:, :3] = 0
        for rows, s, t in _by_size(s_all, t_all, 1, 8):

            def off(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Slopes over the held points and the distances of all points from the lines."""
                mean = lambda v: (v * held).sum(1, keepdims=True) / held.sum(1, keepdims=True)
                ms, mt = mean(s), mean(t)
                ds = (s - ms) * held
                across = (ds * ds).sum(1, keepdims=True)
                slope = np.where(across > 0, (ds * (t - mt)).sum(1, keepdims=True) / across, np.nan)
                return slope[:, 0], t - slope * s - (mt - slope * ms)

            with np.errstate(invalid="ignore", divide="ignore"):
                one = np.abs(off(np.ones(s.shape, bool))[1]) < first
                two = one & (np.abs(off(one)[1]) < second)
                slope, rest = off(two)
            rest = np.where(two, rest, 0.0)
            count = two.sum(1)
            rms = np.sqrt((rest * rest).sum(1) / np.maximum(count, 1))
            out[rows] = np.stack([np.full(len(rows), s.shape[1]), one.sum(1), count, slope, rms, np.abs(rest).max(1)], 1)
        return pd.DataFrame(out, columns=names).astype(dict.fromkeys(names[:3], "int64"))

    return fit


def trimmed_lines(lines: DataFrame, first_m: float = 10.0, second_m: float = 5.0, speed: float = SPEED, line=ols_line) -> DataFrame:
    """Fit, keep |residual| < first_m / speed, fit, keep < second_m / speed, fit.

    ``lines`` has one row per group with ``line``, an array of (channel, s, t);
    everything happens within the row, by least squares for many rows at once.
    Adds the slope, counts of each stage, residual figures of the last fit, valid
    and the reason otherwise (fewer than 3 channels left), in place of ``line``.
    """
    off = lambda m: lambda p: p["t"] - m["slope"] * p["s"] - m["intercept"]
    near = lambda k, m, far: F.filter(k, lambda p: F.abs(off(m)(p)) < far / speed)

    def told(v: Column) -> Column:
        a, b, c, slope = (v[x] for x in ("channels_available", "n_inliers_stage1", "n_inliers_stage2", "slope"))
        reason = F.when(a < 3, "too_few_channels").when(b < 3, "too_few_inliers_stage1").when(c < 3, "too_few_inliers_stage2").when(slope.isNull() | F.isnan(slope), "no_slope")
        figures = [(slope, "slope"), (v["rms"], "residual_rms"), (v["most"], "residual_max_abs")]
        counts = [a.alias("channels_available"), b.alias("n_inliers_stage1"), c.alias("n_inliers_stage2")]
        return _let(reason, lambda why: F.struct(*counts, why.isNull().alias("valid"), why.alias("reason"), *[F.when(why.isNull(), x).alias(n) for x, n in figures]))

    def last(given: Column, k1: Column, k2: Column) -> Column:
        size = lambda x: F.size(x).cast("long")

        def row(m: Column, r: Column) -> Column:
            rms = F.sqrt(F.try_divide(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x), F.size(r)))
            return F.struct(size(given).alias("channels_available"), size(k1).alias("n_inliers_stage1"), size(k2).alias("n_inliers_stage2"), m["slope"].alias("slope"), rms.alias("rms"), F.array_max(F.transform(r, F.abs)).alias("most"))

        return _let(line(k2), lambda m: _let(F.transform(k2, off(m)), lambda r: row(m, r)))

    if line is ols_line:
        fitted = _trimmed(first_m / speed, second_m / speed)("line.s", "line.t")
    else:
        second = lambda given, k1: _let(line(k1), lambda m: _let(near(k1, m, second_m), lambda k2: last(given, k1, k2)))
        fitted = _let(F.col("line"), lambda given: _let(line(given), lambda m: _let(near(given, m, first_m), lambda k1: second(given, k1))))
    # a generated row: filters on its columns stay above it, so nothing is worked out twice
    held = [x for x in lines.columns if x != "line"]
    return lines.select(*held, fitted.alias("__fit")).select(*held, F.inline(F.array(told(F.col("__fit")))))


def trimmed_fit(points: DataFrame, first_m: float = 10.0, second_m: float = 5.0, speed: float = SPEED, keys: tuple[str, ...] = KEYS, fit=ols_fit) -> DataFrame:
    """``trimmed_lines`` of points (keys, channel, s, t): one shuffle by the keys, no
    join. ``fit`` is ols_fit, theil_sen_fit or a function of an array of (s, t)."""
    return trimmed_lines(gather_line(points, keys), first_m, second_m, speed, LINES.get(fit, fit))


def cone_angle(slope: Column, speed: float = SPEED) -> Column:
    """Angle to the axis in degrees; slopes beyond 1/speed are clipped."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope * speed))))


def with_angles(fits: DataFrame, speed: float = SPEED) -> DataFrame:
    """Add angle_deg, angle_off_axis_deg and side: the way the sound runs along the axis."""
    a = fits.withColumn("angle_deg", cone_angle(F.col("slope"), speed))
    off = F.least(F.col("angle_deg"), 180 - F.col("angle_deg"))
    side = F.when(F.col("angle_deg") <= 90, "first to last").when(F.col("angle_deg") > 90, "last to first")
    return a.withColumn("angle_off_axis_deg", off).withColumn("side", side)


def shared_slope(points: DataFrame, keys: tuple[str, ...] = KEYS, cluster: str = "cluster") -> DataFrame:
    """One slope over all clusters of a group, an intercept each: least squares on
    times and places with their cluster's mean taken off."""
    w = W.partitionBy(*keys, cluster)
    off = points.withColumns({"__s": F.col("s") - F.avg("s").over(w), "__t": F.col("t") - F.avg("t").over(w)})
    return off.groupBy(*keys).agg(F.regr_slope("__t", "__s").alias("slope"), F.count("*").alias("n"))


def _clusters(s: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """Labels of k-means on (0.2 * scaled place, residual), started from points
    spread evenly over the order of residuals."""
    span = np.ptp(s) or 1.0
    x = np.stack([0.2 * (s - s.min()) / span, r / (np.abs(r).max() or 1.0)], 1)
    centre = x[np.argsort(r, kind="stable")[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
    label = np.zeros(len(x), int)
    for _ in range(50):
        new = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
        centre = np.stack([x[new == j].mean(0) if (new == j).any() else centre[j] for j in range(k)])
        if (new == label).all():
            break
        label = new
    return label


def _plain(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares slopes and intercepts of rows of points; level through the mean where all s are equal."""
    ms, mt = s.mean(-1), t.mean(-1)
    ds, dt = s - ms[..., None], t - mt[..., None]
    across = (ds * ds).sum(-1)
    level = s.max(-1) == s.min(-1)
    a = np.where(level, 0.0, (ds * dt).sum(-1) / np.where(level, 1.0, across))
    return a, mt - a * ms


def _line(s: np.ndarray, t: np.ndarray, speed: float) -> tuple[float, float]:
    """Line with |slope| at most 1/speed: least squares, else over the three middle
    points, else clamped to 0.99/speed through the medians."""
    if len(s) < 2 or np.ptp(s) == 0:
        return 0.0, float(t.mean())
    a, b = np.polyfit(s, t, 1)
    if abs(a) > 1 / speed:
        m = len(s) // 2
        mid = np.argsort(s, kind="stable")[max(0, m - 1) : m + 2]
        if np.ptp(s[mid]):
            a, b = np.polyfit(s[mid], t[mid], 1)
        if abs(a) > 1 / speed:
            a = math.copysign(0.99 / speed, a)
            b = np.median(t) - a * np.median(s)
    return float(a), float(b)


def _best_shared(s: np.ndarray, t: np.ndarray, label: np.ndarray, k: int, least: int, leave: bool) -> tuple[float, np.ndarray]:
    """Slope and the intercepts of k clusters by least squares. With ``leave`` the best of
    the fits without one point of a cluster of more than ``least``, if that is better.

    Without point j of a cluster of n, its sums of squares about the mean lose
    n / (n - 1) times the point's own, so all fits come from the same sums.
    """
    n = np.bincount(label, minlength=k)
    held = np.maximum(n, 1)
    ms, mt = (np.bincount(label, v, k) / held for v in (s, t))
    ds, dt = s - ms[label], t - mt[label]
    lost = np.where((n[label] > least) & leave & (n.min() >= 2), n[label] / np.maximum(n[label] - 1, 1), 0.0)
    less = np.append(lost, 0.0)  # the last one leaves nothing out
    ss, st, tt = (v.sum() - less * np.append(v, 0.0) for v in (ds * ds, ds * dt, dt * dt))
    slope = np.divide(st, ss, out=np.zeros(len(ss)), where=ss > 0)
    off = tt - slope * st
    j = len(s) if off[-1] <= off.min() else int(off.argmin())
    if j < len(s):
        c = label[j]
        ms[c], mt[c] = ms[c] - ds[j] / (n[c] - 1), mt[c] - dt[j] / (n[c] - 1)
    return float(slope[j]), mt - slope[j] * ms


def _repaired(s: np.ndarray, t: np.ndarray, label: np.ndarray, slope: float, cut: np.ndarray, steepest: float) -> tuple[float, np.ndarray]:
    """A slope beyond 1/speed becomes that of the two middle times of the cluster that fits
    worst, at most ``steepest``; the intercepts become medians."""
    worst = int(np.bincount(label, (t - slope * s - cut[label]) ** 2, len(cut)).argmax())
    mine = np.flatnonzero(label == worst)
    if len(mine) < 2:
        return float(np.clip(slope, -steepest, steepest)), cut
    mine = mine[np.argsort(t[mine], kind="stable")]
    m = len(mine) // 2
    i, j = mine[m - 1], mine[m if len(mine) % 2 == 0 else min(m + 1, len(mine) - 1)]
    if abs(s[j] - s[i]) >= 1e-12:
        slope = (t[j] - t[i]) / (s[j] - s[i])
    slope = float(np.clip(slope, -steepest, steepest))
    return slope, np.array([np.median((t - slope * s)[label == c]) if (label == c).any() else 0.0 for c in range(len(cut))])


def _shared_lines(s: np.ndarray, t: np.ndarray, label: np.ndarray, k: int, rounds: int, speed: float, least: int) -> float:
    """Slope that k parallel lines share: fit, repair, move points to the nearest line,
    and from the second fit on leave out the point that harms most."""
    far, steepest = 1 / speed, 0.99 / speed

    def fitted(mine: np.ndarray) -> tuple[float, np.ndarray]:
        slope, cut = _best_shared(s, t, mine, k, least, False)
        return _repaired(s, t, mine, slope, cut, steepest) if abs(slope) > far else (slope, cut)

    slope, cut = fitted(label)
    for _ in range(rounds):
        new = np.abs(t[:, None] - slope * s[:, None] - cut).argmin(1)
        if (new == label).all():
            break
        label = new
        slope, cut = fitted(label)
        if np.bincount(label, minlength=k).min() >= 2:
            best, best_cut = _best_shared(s, t, label, k, least, True)
            if abs(best) <= 1.01 * far:
                slope, cut = float(np.clip(best, -steepest, steepest)), best_cut
    return slope


def multiline_fit(points: DataFrame, **options) -> DataFrame:
    """``multiline_lines`` of points (keys, channel, s, t), gathered by one shuffle."""
    return multiline_lines(gather_line(points, options.get("keys", KEYS)), **options)


def multiline_lines(lines: DataFrame, k: int = 3, rounds: int | None = None, speed: float = SPEED, shared: bool = False, keys: tuple[str, ...] = KEYS, least: int = 3) -> DataFrame:
    """slope, n_lines, n of ``k`` lines per group, for arrivals over several paths.

    Points start in clusters of place and residual; then lines are fitted and
    points move to the nearest line, at most ``rounds`` times (5, or 8 if
    ``shared``). Clusters of fewer than ``least`` points have no line; a group of
    fewer than ``k * least`` points is one plain line. Without ``shared`` the
    slope nearest the median of the usable ones is given, with it all lines share
    one slope, repaired where it is too steep, and one outlier may be left out.
    Groups of fewer than 2 points have a null slope. Groups are a few dozen
    channels and in order of channels, so the result depends on nothing but their
    rows. Plain lines of a batch are fitted together.
    """
    most = rounds or (8 if shared else 5)

    def one(s: np.ndarray, t: np.ndarray, a: float, b: float) -> tuple[float, int]:
        label = _clusters(s, t - a * s - b, k)
        if shared:
            return _shared_lines(s, t, label, k, most, speed, least), k
        lines: list[tuple[float, float]] = []
        for _ in range(most):
            present = [j for j in range(k) if (label == j).sum() >= least]
            if not present:
                break
            lines = [_line(s[label == j], t[label == j], speed) for j in present]
            new = np.array(present)[np.abs(t[:, None] - s[:, None] * [x for x, _ in lines] - [y for _, y in lines]).argmin(1)]
            if (new == label).all():
                break
            label = new
        slopes = np.array([x for x, _ in lines])
        usable = slopes[np.abs(slopes) <= 1 / speed]
        return float(usable[np.abs(usable - np.median(usable)).argmin()]) if len(usable) else math.nan, len(lines)

    @F.pandas_udf("struct<slope double, n_lines long>")
    def fit(s_all: pd.Series, t_all: pd.Series) -> pd.DataFrame:
        slope, count = np.full(len(s_all), np.nan), np.zeros(len(s_all), np.int64)
        for rows, s, t in _by_size(s_all, t_all, 2):
            a, b = _plain(s, t)
            if s.shape[1] < k * least:
                slope[rows], count[rows] = a, 1
                continue
            for row, *x in zip(rows, s, t, a, b):
                if not shared and np.ptp(x[0]):  # rounding can decide which of two lines is nearest to their median
                    x[2:] = np.polyfit(x[0], x[1], 1)
                slope[row], count[row] = one(*x)
        return pd.DataFrame({"slope": slope, "n_lines": count})

    held = _dealt(lines.select(*keys, F.size("line").cast("long").alias("n"), "line.s", "line.t"), keys)
    return held.select(*keys, "n", fit("s", "t").alias("m")).select(*keys, "m.slope", "m.n_lines", "n")
