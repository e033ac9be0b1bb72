"""Arrival tables: (packet, channel, sample_idx) and what is derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.operators.joins import point_interval_join


def merge_arrivals(*tables: DataFrame) -> DataFrame:
    """Union of arrival tables; of several arrivals of a packet at a channel the earliest stays."""
    whole = reduce(DataFrame.unionByName, [t.select("packet", "channel", "sample_idx") for t in tables])
    return whole.groupBy("packet", "channel").agg(F.min("sample_idx").alias("sample_idx"))


def flip_arrivals(arrivals: DataFrame, by: str = "packet") -> DataFrame:
    """One row per packet (or channel) with its arrivals in order of the other key."""
    other = "channel" if by == "packet" else "packet"
    return arrivals.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(other, "sample_idx"))).alias("arrivals"))


def presence_matrix(arrivals: DataFrame, packets: DataFrame) -> DataFrame:
    """packet, channel, present (0/1) for all given packets and every channel in min..max."""
    span = arrivals.agg(F.min("channel").alias("lo"), F.max("channel").alias("hi"))  # one row
    grid = packets.select("packet").distinct().join(F.broadcast(span)).select("packet", F.explode(F.sequence("lo", "hi")).alias("channel"))
    seen = arrivals.select("packet", "channel", F.lit(1).alias("seen")).distinct()
    return grid.join(seen, ["packet", "channel"], "left").select("packet", "channel", F.coalesce("seen", F.lit(0)).alias("present"))


def coverage_pct(arrivals: DataFrame) -> DataFrame:
    """Share of the channel range, in percent, that each packet reached."""
    span = arrivals.agg((F.max("channel") - F.min("channel") + 1).alias("span"))  # one row
    counts = arrivals.groupBy("packet").agg(F.count_distinct("channel").alias("n"))
    return counts.join(F.broadcast(span)).select("packet", (100.0 * F.col("n") / F.col("span")).alias("coverage_pct"))


def travel_times(arrivals: DataFrame, sent: DataFrame) -> DataFrame:
    """packet, channel, travel: arrival minus transmit sample; packets not sent are left out."""
    return arrivals.join(sent.select("packet", "tx_sample"), "packet").select("packet", "channel", (F.col("sample_idx") - F.col("tx_sample")).alias("travel"))


def avg_travel_time(arrivals: DataFrame, sent: DataFrame, first: int, last: int) -> DataFrame:
    """Mean travel per channel over packets first..last; channels without one have null."""
    timed = travel_times(arrivals.filter(F.col("packet").between(first, last)), sent)
    return arrivals.select("channel").distinct().join(timed.groupBy("channel").agg(F.avg("travel").alias("avg_travel"), F.count("*").alias("n")), "channel", "left").select("channel", "avg_travel", F.coalesce("n", F.lit(0)).alias("n"))


def path_difference(arrivals: DataFrame, a: int, b: int, speed: float, fs: float) -> DataFrame:
    """packet, measured path difference in metres between two channels."""
    x = arrivals.filter(F.col("channel") == a).select("packet", F.col("sample_idx").alias("s_a"))
    y = arrivals.filter(F.col("channel") == b).select("packet", F.col("sample_idx").alias("s_b"))
    return x.join(y, "packet").select("packet", (speed * (F.col("s_b") - F.col("s_a")) / fs).alias("measured_m"))


def path_difference_error(measured: DataFrame, geometry: DataFrame) -> DataFrame:
    """Measured against geometric difference |d_a - d_b| of (packet, d_a, d_b)."""
    return measured.join(geometry, "packet").select("packet", "measured_m", F.abs(F.col("d_a") - F.col("d_b")).alias("geometric_m"), (F.abs("measured_m") - F.abs(F.col("d_a") - F.col("d_b"))).alias("error_m"))


def depth_correct(times: DataFrame, channels: DataFrame, source: DataFrame, speed: float) -> DataFrame:
    """Take the vertical part dz * (dz / R) / c off each time; R below 1e-6 leaves it raw.

    ``channels`` is (channel, e, n, u), ``source`` (packet, se, sn, su).
    """
    both = times.join(channels, "channel").join(source, "packet")
    dz = F.col("u") - F.col("su")
    r = F.sqrt(F.pow(F.col("e") - F.col("se"), 2) + F.pow(F.col("n") - F.col("sn"), 2) + dz * dz)
    return both.select("packet", "channel", "t", F.when(r < 1e-6, F.col("t")).otherwise(F.col("t") - dz * (dz / r) / speed).alias("t_flat"))


def to_seconds(sample_idx: Column, fs: float) -> Column:
    return sample_idx.cast("double") / fs


def subarray_slice(arrivals: DataFrame, subarrays: DataFrame) -> DataFrame:
    """Arrivals of each subarray (subarray_id, start_ch, n_ch), channels in [start, start+n)."""
    spans = subarrays.select("subarray_id", "start_ch", "n_ch", (F.col("start_ch") + F.col("n_ch")).alias("end_ch"))
    return point_interval_join(arrivals, spans, "channel", "start_ch", "end_ch", 32.0).drop("end_ch")


def subarray_status(arrivals: DataFrame, subarrays: DataFrame, packets: DataFrame, min_channels: int = 3) -> DataFrame:
    """One row per packet and subarray: n, valid and the reason if not valid."""
    grid = packets.select("packet").distinct().crossJoin(subarrays.select("subarray_id", "start_ch", "n_ch"))  # all pairs are wanted; subarrays are few
    seen = arrivals.select("packet").distinct().withColumn("seen", F.lit(True))
    counts = subarray_slice(arrivals, subarrays).groupBy("packet", "subarray_id").agg(F.count("*").alias("n"))
    held = grid.join(counts, ["packet", "subarray_id"], "left").join(seen, "packet", "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("seen").isNull(), "packet_missing").when(n < min_channels, "too_few_channels")
    return held.select("packet", "subarray_id", n.alias("n"), reason.isNull().alias("valid"), reason.alias("reason"))
