"""Calibration of array segments from arrivals of sources at known places.

A segment is a run of channels on a straight level line. Its origin, bearing
and clock offset are fitted by damped Gauss-Newton steps. A step is one
aggregation of all measurements to the normal equations of each segment; what
is known of the segments is a small table, written once a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.operators.doa import SPEED

_STATE = "segment long, n long, p array<double>, best array<double>, sse double, h array<double>, b array<double>, damp double, done boolean"
_N = 4  # x0, y0, theta and the offset times the speed, so that all count about a metre


def array_segments(depths: DataFrame, start: int, stop: int, step: int = 20, below: float = 30.0) -> DataFrame:
    """segment, ch_min, ch_max, z_h of the segments from ``start`` on before ``stop``,
    both ends included: ``below`` added to the mean of the end channels' z (null
    where one has none)."""
    made = depths.sparkSession.range(start, stop, step).select(F.col("id").alias("segment"), F.col("id").alias("ch_min"), (F.col("id") + step).alias("ch_max"))
    ends = depths.filter("z is not null").groupBy(F.col("channel").cast("long").alias("channel")).agg(F.max("z").alias("z"))
    for end in ("ch_min", "ch_max"):
        made = made.join(ends.select(F.col("channel").alias(end), F.col("z").alias(f"z_{end}")), end, "left")
    return made.select("segment", "ch_min", "ch_max", ((F.col("z_ch_min") + F.col("z_ch_max")) / 2 + below).alias("z_h"))


def _equations(measured: DataFrame, state: DataFrame, speed: float, spacing: float) -> DataFrame:
    """segment, new_sse, new_h, new_b: sums of squares, products of slopes and slopes
    times residuals, all in metres, at the places ``p`` of unfinished segments."""
    p = [F.col("p")[k] for k in range(_N)]
    d = F.col("k") * spacing
    c, s = F.cos(p[2]), F.sin(p[2])
    placed = measured.join(state.filter("not done").select("segment", "p"), "segment")
    placed = placed.withColumns({"dx": F.col("x") - p[0] - d * c, "dy": F.col("y") - p[1] - d * s})
    placed = placed.withColumn("r", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + (F.col("z") - F.col("z_h")) ** 2))
    per = lambda v: F.coalesce(F.try_divide(v, F.col("r")), F.lit(0.0))
    g = [per(-F.col("dx")), per(-F.col("dy")), per(d * (F.col("dx") * s - F.col("dy") * c)), F.lit(1.0)]
    miss = F.col("took") * speed - F.col("r") - p[3]
    made = placed.select("segment", miss.alias("miss"), *[v.alias(f"g{k}") for k, v in enumerate(g)])
    g = [F.col(f"g{k}") for k in range(_N)]
    return made.groupBy("segment").agg(
        F.sum(F.col("miss") ** 2).alias("new_sse"),
        F.array(*[F.sum(a * b) for a in g for b in g]).alias("new_h"),
        F.array(*[F.sum(a * F.col("miss")) for a in g]).alias("new_b"),
    )


def _move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Take or refuse the last step of each segment and propose the next one."""
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            if r.done:
                rows.append((r.segment, r.n, r.p, r.best, r.sse, r.h, r.b, r.damp, True))
                continue
            better = r.new_sse < r.sse
            settled = better and np.isfinite(r.sse) and r.sse - r.new_sse <= 1e-12 * r.sse
            best, sse, h, b = (r.p, r.new_sse, r.new_h, r.new_b) if better else (r.best, r.sse, r.h, r.b)
            damp = max(r.damp / 10, 1e-12) if better else r.damp * 10
            m = np.asarray(h, float).reshape(_N, _N)
            step = np.linalg.lstsq(m + damp * np.diag(np.diag(m)), np.asarray(b, float), rcond=None)[0]
            still = np.abs(step).max() < 1e-9
            rows.append((r.segment, r.n, list(np.asarray(best) + step), list(best), sse, list(h), list(b), damp, bool(settled or still)))
        yield pd.DataFrame(rows, columns=["segment", "n", "p", "best", "sse", "h", "b", "damp", "done"])


def calibrate_segments(
    arrivals: DataFrame, sources: DataFrame, depths: DataFrame, scratch: str, start: int, stop: int, step: int = 20,
    ranges: list[tuple[int, int]] | None = None, speed: float = SPEED, spacing: float = 1.02, below: float = 30.0, rounds: int = 60,
) -> DataFrame:
    """Origin, bearing and clock offset of each segment of the array.

    ``arrivals`` has channel, packet and t in seconds, ``sources`` packet, x, y, z
    and t_tx (one row a packet; ``ranges`` of packets, ends included, choose
    some), ``depths`` channel and z. Gives segment, ch_min, ch_max, z_h,
    n_measurements, success, reason, x0, y0, theta_deg (as the steps leave it, some
    turns on at times), theta_deg_norm (in [-180, 180)) and dt. Places along a segment count the channels that have
    any arrival. Reasons: missing_depth, no_receivers, no_measurements,
    too_few_measurements (under 4), not_converged. Rows with a null are no
    measurements. ``scratch`` is a new folder that all executors share.

    Measurements are joined once; every step sums them where they lie, so a
    segment heard a billion times is no larger a task than any other.
    """
    spark = arrivals.sparkSession
    heard = arrivals.select(F.col("channel").cast("long").alias("channel"), "packet", "t").filter("channel is not null")
    some = sources.dropna(subset=["packet", "x", "y", "z", "t_tx"]).select("packet", "x", "y", "z", "t_tx")
    if ranges is not None:
        some = some.filter(" or ".join(f"packet between {int(a)} and {int(b)}" for a, b in ranges) or "false")
    cut = array_segments(depths, start, stop, step, below)
    lying = cut.select("segment", "z_h", F.explode(F.sequence("ch_min", "ch_max")).alias("channel")).join(heard.select("channel").distinct(), "channel")
    lying = lying.withColumn("k", F.row_number().over(W.partitionBy("segment").orderBy("channel")) - 1)
    lying.write.parquet(f"{scratch}/channels")
    lying = spark.read.parquet(f"{scratch}/channels")
    made = heard.dropna().join(some, "packet").join(lying.filter("z_h is not null"), "channel")
    made.select("segment", "k", "x", "y", "z", "z_h", (F.col("t") - F.col("t_tx")).alias("took")).write.parquet(f"{scratch}/measured")
    measured = spark.read.parquet(f"{scratch}/measured")
    centre = some.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("cx"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("cy")).first()
    begin = F.array(F.lit(centre.cx), F.lit(centre.cy), F.lit(0.0), F.lit(0.0))
    none = F.array().cast("array<double>")
    state = measured.groupBy("segment").agg(F.count("*").alias("n")).withColumns({"p": begin, "best": begin, "sse": F.lit(float("inf")), "h": none, "b": none, "damp": F.lit(1e-3), "done": F.col("n") < _N})
    for k in range(rounds + 1):
        state.write.parquet(f"{scratch}/state-{k}")
        state = spark.read.schema(_STATE).parquet(f"{scratch}/state-{k}")
        if k == rounds or state.filter("not done").isEmpty():
            break
        state = state.join(_equations(measured, state, speed, spacing), "segment", "left").mapInPandas(_move, _STATE)
    near = lying.groupBy("segment").agg(F.count("*").alias("n_receivers"))
    out = cut.join(near, "segment", "left").join(state, "segment", "left")
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when(F.col("z_h").isNull(), "missing_depth").when(F.col("n_receivers").isNull(), "no_receivers").when(n == 0, "no_measurements")
        .when(n < _N, "too_few_measurements").when(~F.col("done"), "not_converged")
    )
    fitted = lambda k: F.when(reason.isNull(), F.col("best")[k])
    theta = F.degrees(fitted(2))
    return out.select(
        "segment", "ch_min", "ch_max", "z_h", n.alias("n_measurements"), reason.isNull().alias("success"), reason.alias("reason"),
        fitted(0).alias("x0"), fitted(1).alias("y0"), theta.alias("theta_deg"), (F.pmod(theta + 180, F.lit(360.0)) - 180).alias("theta_deg_norm"), (fitted(3) / speed).alias("dt"),
    )
