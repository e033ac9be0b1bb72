"""Sample conditioning: selection, units, unwrapping, integration, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorline.functions.scalars import wrap
from sensorline.operators.joins import point_interval_join, running_sum


def select_range(samples: DataFrame, channels: tuple[int, int, int], first: int, count: int) -> DataFrame:
    """Rows of channels start..stop (exclusive) by step and ``count`` samples from ``first``."""
    lo, hi, step = channels
    c, i = F.col("channel"), F.col("sample_idx")
    return samples.filter((c >= lo) & (c < hi) & ((c - lo) % step == 0) & (i >= first) & (i < first + count))


def select_block_range(blocks: DataFrame, channels: list[int], first: int, count: int) -> DataFrame:
    """Blocks of the channels with the part of ``samples`` in [first, first+count); empty blocks go."""
    a = F.greatest(F.lit(first) - F.col("start_sample"), F.lit(0))
    b = F.least(F.lit(first + count) - F.col("start_sample"), F.size("samples").cast("long"))
    cut = blocks.filter(F.col("channel").isin(channels)).withColumn("__a", a).withColumn("__n", b - a).filter("__n > 0")
    return cut.withColumn("samples", F.slice("samples", (F.col("__a") + 1).cast("int"), F.col("__n").cast("int"))).withColumn("start_sample", F.col("start_sample") + F.col("__a")).drop("__a", "__n")


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """Long form: channel, sample_idx, value."""
    return blocks.select("channel", "start_sample", F.posexplode("samples").alias("k", "value")).select("channel", (F.col("start_sample") + F.col("k")).alias("sample_idx"), F.col("value").cast("double").alias("value"))


def time_axis(start: Column, sample_idx: Column, dt_seconds: float) -> Column:
    """Timestamp of a sample; the step is rounded to whole nanoseconds first."""
    step_ns = round(dt_seconds * 1e9)
    return F.timestamp_micros(F.unix_micros(start) + F.floor(sample_idx * step_ns / 1000).cast("long"))


def relative_time(df: DataFrame, ts: str = "ts", out: str = "rel_s", on: str = "channel") -> DataFrame:
    """Seconds since the first sample of each channel."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn(out, (micros - F.min(micros).over(W.partitionBy(on))) / 1e6)


def to_units(samples: Column, data_scale: float, sensitivities: list[float], select: int = 0, user: float = 1.0) -> Column:
    """Scaled samples. ``select`` n takes the n-th sensitivity, -1 radians per
    metre (scale alone), -2 radians (first sensitivity), -3 the user's."""
    if select >= 0:
        factor = data_scale / sensitivities[select]
    else:
        factor = {-1: data_scale, -2: data_scale / sensitivities[0], -3: data_scale / user}[select]
    return F.transform(samples, lambda x: x * F.lit(factor))


def unwrap(df: DataFrame, step: float, value: str = "value", out: str = "unwrapped", on: str = "sample_idx", order: str = "channel") -> DataFrame:
    """Remove jumps of more than half a step between neighbours along ``order``."""
    w = W.partitionBy(on).orderBy(order)
    jump = F.col(value) - F.lag(value).over(w)
    stepped = df.withColumn("__d", F.coalesce(wrap(jump, step), F.col(value)))
    return stepped.withColumn(out, F.sum("__d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__d")


def integrate(samples: DataFrame, dt: float, block: int = 1 << 16, value: str = "value", out: str = "integral") -> DataFrame:
    """Running sum times dt of each channel, in two levels of ``block`` samples."""
    summed = running_sum(samples, F.col(value), out, F.floor(F.col("sample_idx") / block), [F.col("sample_idx")], ("channel",))
    return summed.withColumn(out, F.col(out) * dt)


def integrate_blocks(blocks: DataFrame, dt: float) -> DataFrame:
    """Blocks of running sums times dt: prefix sums within, block totals before."""
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    w = W.partitionBy("channel").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("__t", total).withColumn("__o", F.coalesce(F.sum("__t").over(w), F.lit(0.0)))
    start = F.struct(F.col("__o").alias("s"), F.array().cast("array<double>").alias("a"))

    def step(acc, x):
        return F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array((acc["s"] + x) * dt)).alias("a"))

    return carried.withColumn("samples", F.aggregate("samples", start, step)["a"]).drop("__t", "__o")


def channel_ranges(channels: DataFrame) -> DataFrame:
    """Compress a channel list to runs: min_ch, max_ch, size (step 1)."""
    once = channels.select("channel").distinct()
    island = F.col("channel") - F.row_number().over(W.partitionBy(F.lit(0)).orderBy("channel"))  # a row per channel
    return once.withColumn("g", island).groupBy("g").agg(F.min("channel").alias("min_ch"), F.max("channel").alias("max_ch"), F.count("*").alias("size")).drop("g")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """Inverse of ``channel_ranges``."""
    return ranges.select(F.explode(F.sequence("min_ch", "max_ch")).alias("channel"))


def available_channels(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Channels in both lists with their 0-based place in the sorted available list."""
    placed = available.select("channel").distinct().withColumn("place", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("channel")) - 1))
    return placed.join(requested.select("channel").distinct(), "channel")


def window_around(samples: DataFrame, points: DataFrame, before: int, after: int) -> DataFrame:
    """Samples in [at-before, at+after) of each point (channel, packet, at) with
    ``rel`` = sample - at. Windows reach over the ends only as far as samples go."""
    spans = points.select("channel", "packet", "at", (F.col("at") - before).alias("lo"), (F.col("at") + after).alias("hi"))
    joined = point_interval_join(samples, spans, "sample_idx", "lo", "hi", float(max(1, before + after)), ("channel",))
    return joined.select("channel", "packet", "sample_idx", (F.col("sample_idx") - F.col("at")).alias("rel"), "value")
