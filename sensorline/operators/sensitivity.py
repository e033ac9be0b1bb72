"""Receiver sensitivity: spectra, binned statistics, kernel smoothing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.functions.scalars import hann_kernel, rectangular_kernel
from sensorline.operators.joins import bracketing_bucketed, lerp, point_interval_join, within_join


def lookup_interp(queries: DataFrame, table: DataFrame, x: str = "x", y: str = "y", width: float = 1000.0) -> DataFrame:
    """Linear look-up of ``y`` at ``x``, clamped at both ends of the table. Swept in cells of ``width``."""
    met = bracketing_bucketed(queries, table.select(x, y), x, [y], width)
    made = F.coalesce(lerp(F.col(x), F.col("at_lo"), F.col("at_hi"), F.col(f"{y}_lo"), F.col(f"{y}_hi")), F.col(f"{y}_lo"), F.col(f"{y}_hi"))
    return met.select(*queries.columns, made.alias(y))


def kernel_mean(queries: DataFrame, points: DataFrame, tol: float, kernel: Callable[[Column, float], Column] = rectangular_kernel, db_in: bool = False, db_out: bool = False) -> DataFrame:
    """qid, x, mean: mean of the points (xp, fp) around each query, weighted by a
    kernel inside the open interval (-tol, tol). A null fp counts as 0 with its
    weight; no point or no weight gives null. Means are of amplitudes: with
    ``db_in`` fp is in dB (20 log), with ``db_out`` the mean."""
    value = F.coalesce(F.pow(F.lit(10.0), F.col("fp") / 20) if db_in else F.col("fp"), F.lit(0.0))
    near = within_join(queries.select("qid", "x"), points.select("xp", "fp"), "x", "xp", tol, closed=False)
    w = kernel(F.col("xp") - F.col("x"), tol)
    g = near.groupBy("qid").agg(F.sum(w * value).alias("s"), F.sum(w).alias("w"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    made = F.when(mean > 0, 20 * F.log10(mean)) if db_out else mean
    return queries.select("qid", "x").join(g, "qid", "left").select("qid", "x", made.alias("mean"))


def cross_spectrum(receptions: DataFrame, template: list[float], fs: float) -> DataFrame:
    """channel, packet, freq, re, im: correlation with the template, scaled to unit
    power as a tone, wherever it fits wholly; under a Hann window, transformed
    and divided by the template's length and by fs."""
    ref = np.asarray(template, float)
    ref = np.sqrt(2) * ref / np.abs(ref).max()

    @F.pandas_udf("array<double>")
    def spectrum(x: pd.Series) -> pd.Series:
        def one(v):
            y = np.correlate(np.asarray(v, float), ref, "valid")
            z = np.fft.rfft(y * np.hanning(len(y))) / len(ref) / fs
            return np.stack([z.real, z.imag], -1).ravel()

        return pd.Series([one(v) for v in x])

    flat = receptions.select("channel", "packet", (F.size("samples") - len(template) + 1).alias("m"), spectrum("samples").alias("y"))
    each = flat.select("channel", "packet", "m", "y", F.explode(F.sequence(F.lit(0), F.floor(F.size("y") / 2).cast("int") - 1)).alias("k"))
    return each.select("channel", "packet", (F.col("k") * fs / F.col("m")).alias("freq"), F.get("y", 2 * F.col("k")).alias("re"), F.get("y", 2 * F.col("k") + 1).alias("im"))


def sensitivity_db(spectra: DataFrame, source_psd: DataFrame, transducer: DataFrame, losses: DataFrame) -> DataFrame:
    """channel, packet, freq, sens_db = 20 log |Y| - (source + transducer - loss).

    ``source_psd`` and ``transducer`` are (freq, db) on the same frequencies,
    ``losses`` (channel, packet, loss_db).
    """
    level = 10 * F.log10(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    met = spectra.join(source_psd.select("freq", F.col("db").alias("psd")), "freq").join(transducer.select("freq", F.col("db").alias("tx")), "freq").join(losses, ["channel", "packet"])
    return met.select("channel", "packet", "freq", (level - (F.col("psd") + F.col("tx") - F.col("loss_db"))).alias("sens_db"))


#: Statistics that ``binned_sensitivity`` offers by name, besides "mean".
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max,
    "median": lambda c: F.percentile(c, 0.5), "q1": lambda c: F.percentile(c, 0.25), "q3": lambda c: F.percentile(c, 0.75),
}


def binned_sensitivity(values: DataFrame, f_bins: DataFrame, angles: DataFrame, stats: list[str], tol_deg: float = 2.0, min_snr: float = 3.0) -> DataFrame:
    """Statistics per frequency bin [lo, hi) and angle over receptions within the
    open interval of ``tol_deg`` around it. "mean" is the Hann-weighted mean of
    amplitudes in dB.

    ``values`` is (channel, packet, freq, sens_db, snr, angle_deg). Receptions
    are averaged over a bin first, so the angle join meets one row per
    reception and bin.
    """
    unknown = set(stats) - set(STATISTICS) - {"mean"}
    if unknown:
        raise ValueError(f"no such statistic: {', '.join(sorted(unknown))}")
    width = 1000.0
    binned = point_interval_join(values.filter(F.col("snr") >= min_snr), f_bins.select("bin_no", "lo", "hi"), "freq", "lo", "hi", width)
    per = binned.groupBy("bin_no", "channel", "packet").agg(F.avg("sens_db").alias("sens_db"), F.first("angle_deg").alias("angle_deg"))
    near = within_join(per, angles.select("angle"), "angle_deg", "angle", tol_deg, closed=False)
    w = hann_kernel(F.col("angle_deg") - F.col("angle"), tol_deg)
    mean = 20 * F.log10(F.sum(w * F.pow(F.lit(10.0), F.col("sens_db") / 20)) / F.sum(w))
    return near.groupBy("bin_no", "angle").agg(F.count("*").alias("n"), *[(mean if s == "mean" else STATISTICS[s]("sens_db")).alias(s) for s in stats])
