"""Scalar functions: times, strings, wrapping, kernels and closed-form models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wrap(x: Column, step: float) -> Column:
    """``x`` brought to [-step/2, step/2); a step of 0 or less changes nothing."""
    if step <= 0:
        return x
    return F.pmod(x + step / 2, F.lit(float(step))) - step / 2


def despike(x: Column, threshold: float) -> Column:
    """0 where the magnitude exceeds the threshold."""
    return F.when(F.abs(x) > threshold, F.lit(0.0)).otherwise(x)


def time_list(spark: SparkSession, start: str, stop: str, step: int = 10) -> DataFrame:
    """Times "HHMMSS" from start to stop (exclusive), ``step`` seconds apart."""
    seconds = lambda s: int(s[:2]) * 3600 + int(s[2:4]) * 60 + int(s[4:6])
    first, last = seconds(start), seconds(stop)
    at = spark.range(first, max(first, last), step).select(F.col("id").alias("second"))
    hh = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.col("second")
    return at.select("second", F.concat(hh(F.floor(s / 3600) % 24), hh(F.floor(s / 60) % 60), hh(s % 60)).alias("hhmmss"))


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, with their fraction."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def parse_ts(s: Column) -> Column:
    """Timestamp of "YYYYmmdd HHMMSS", "HHMMSS" (first of January 1970) or ISO
    text with or without a fraction; null for anything else."""
    clean = F.trim(s)
    day = F.when(clean.rlike(r"^\d{8} \d{6}$"), clean).when(clean.rlike(r"^\d{6}$"), F.concat(F.lit("19700101 "), clean))
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), clean)
    return F.coalesce(F.try_to_timestamp(day, F.lit("yyyyMMdd HHmmss")), iso.try_cast("timestamp"))


def strip_trailing(s: Column, char: str) -> Column:
    """``s`` without the trailing run of ``char``."""
    return F.rtrim(s, F.lit(char))


def json_path(s: Column, *keys: str) -> Column:
    """Text at a key path of a JSON document; null where it lacks."""
    return F.get_json_object(s, "$" + "".join(f"['{k}']" for k in keys))


def transmission_loss(distance: Column, exponent: float = 2.0) -> Column:
    """Spreading loss in dB; distances of 0 or less give null."""
    return F.when(distance > 0, 10 * exponent * F.log10(distance))


def rectangular_kernel(t: Column, span: float) -> Column:
    return F.when(F.abs(t) < span, F.lit(1.0)).otherwise(F.lit(0.0))


def hann_kernel(t: Column, span: float) -> Column:
    """Raised cosine inside the open interval (-span, span), 0 outside."""
    return F.when(F.abs(t) < span, 0.5 + 0.5 * F.cos(math.pi * t / span)).otherwise(F.lit(0.0))


def packet_samples(df: Column, rate: Column, chips: int = 176) -> Column:
    """Samples of a packet of ``chips`` chips at frequency step ``df``."""
    return F.round(rate * chips / df).cast("long")


def bpsk_slice(re: Column, im: Column, zero_phase: float = 0.0) -> Column:
    """0 if the phase lies within a quarter turn of ``zero_phase``, else 1."""
    turned = F.pmod(F.atan2(im, re) + math.pi - zero_phase, F.lit(2 * math.pi)) - math.pi
    return F.when(F.abs(turned) <= math.pi / 2, 0).otherwise(1)


def bpsk_map(bit: Column, zero_phase: float = 0.0) -> tuple[Column, Column]:
    """Unit phasor (re, im) of a bit."""
    at = bit * math.pi + zero_phase
    return F.cos(at), F.sin(at)


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return F.when(F.abs(x) < 1e-12, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (math.pi * x))


def modelled_gain(angle_deg: Column, freq: Column, speed: float = 1500.0, spacing: float = 1.02, gauge_factor: float = 2.0) -> Column:
    """Gain of pulse shape and gauge length at the wavenumber along the line.

    The pulse passes wavenumbers up to 0.40 per channel spacing and fades to 0
    at 0.45 by a raised cosine; the gauge gives a squared sinc.
    """
    along = freq * F.cos(F.radians(angle_deg)) / speed
    edge = F.abs(along * spacing)
    fade = F.when(edge > 0.45, F.lit(0.0)).when(edge < 0.40, F.lit(1.0)).otherwise(0.5 + 0.5 * F.cos(math.pi * (edge - 0.40) / 0.05))
    return fade * F.pow(sinc(along * spacing / gauge_factor), 2)


def modelled_strain_db(angle_deg: Column, level_db: Column, bulk_modulus: float = 2.25e9, young_ratio: float = 0.1, poisson: float = 0.2) -> Column:
    """Strain of a cable along the line, in dB of nanostrain, for a pressure level
    in dB of micropascal: stretch along the wave less squeeze across it. Only the
    magnitude is given; null where both cancel."""
    if not 0 <= young_ratio <= 1 or not -1 <= poisson <= 0.5:
        raise ValueError("young_ratio must lie in 0..1 and poisson in -1..0.5")
    a = F.radians(angle_deg)
    shape = F.abs((0.7 + 0.4 * poisson) * F.pow(F.cos(a), 2) - 0.2 * young_ratio * F.pow(F.sin(a), 2))
    return F.when(shape > 0, level_db + 60 - 20 * math.log10(bulk_modulus) + 20 * F.log10(shape))
