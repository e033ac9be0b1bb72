"""Structured Streaming versions of coverage, integration and packet assignment.

Inputs have an event time ``ts`` of type timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType


def block_coverage(arrivals: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Distinct packets seen and arrivals per window and channel.

    A stream keeps no sets, so packets (whole numbers; nulls do not count) are
    bits: one word for each 64 numbers that a window and channel meet. A second
    aggregation over the closed windows adds up their bits, so the count is exact
    and the state grows with the arrivals, or with the packets' range if that is less.
    """
    packet = F.col("packet").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), packet.bitwiseAND(63).cast("int"))
    words = arrivals.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "channel", F.shiftright(packet, 6).alias("word"))
    parts = words.agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    whole = parts.groupBy(F.window(F.window_time("w"), window).alias("w"), "channel")
    summed = whole.agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).alias("packets"), F.sum("n").alias("n"))
    return summed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "channel", "packets", "n")


#: Groups of channels that share their state: calls and state rows of a batch are bounded by them, not by the channels.
GROUPS = 256
_CHANNEL = ["blank", "channel"]


class _Integral(StatefulProcessor):
    """Running sums of despiked samples of the channels of a group, carried between batches."""

    def __init__(self, threshold: float, dt: float):
        self.threshold, self.dt = threshold, dt

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", StructType([StructField(c, BinaryType()) for c in (*_CHANNEL, "s")]))

    def _summed(self, part: pd.DataFrame) -> pd.DataFrame:
        """Integrals of samples in order, the carried sums taken on and kept."""
        told = self.sums.get() if self.sums.exists() else (b"", b"", b"")
        carried = pd.DataFrame({c: np.frombuffer(x, kind) for c, x, kind in zip((*_CHANNEL, "s"), told, (bool, np.int64, float))})
        value = part["value"].where(part["value"].abs() <= self.threshold, 0.0)
        run = value.groupby([part[c] for c in _CHANNEL]).cumsum().to_numpy()
        run = run + part[_CHANNEL].merge(carried, "left", _CHANNEL)["s"].fillna(0.0).to_numpy()
        held = pd.concat([carried, part[_CHANNEL].assign(s=run)]).drop_duplicates(_CHANNEL, keep="last")
        self.sums.update(tuple(held[c].to_numpy(kind).tobytes() for c, kind in zip(held, (bool, np.int64, float))))
        return pd.DataFrame({"channel": part["channel"].astype("Int64").mask(part["blank"]).array, "sample_idx": part["sample_idx"].to_numpy(), "integral": run * self.dt})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        yield self._summed(pd.concat(list(rows)).sort_values([*_CHANNEL, "sample_idx"], kind="stable"))

    def close(self) -> None:
        pass


class _OrderedIntegral(_Integral):
    """The same sums over samples that come in any order within the watermark's delay.

    Samples wait in a list of blocks, one for each Arrow batch that brought some,
    until the watermark has passed their time: from then on no earlier sample is
    let in, so they are summed in order. A timer stands at the least waiting time.
    """

    _KINDS = {"blank": bool, "channel": np.int64, "us": np.int64, "sample_idx": np.int64, "value": float}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField(c, BinaryType()) for c in self._KINDS]))

    def _wait(self, part: pd.DataFrame) -> None:
        self.waiting.appendValue(tuple(part[c].to_numpy(kind).tobytes() for c, kind in self._KINDS.items()))
        self.handle.registerTimer(-(-int(part["us"].min()) // 1000))  # timers are whole milliseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                self._wait(part)
        yield pd.DataFrame({"channel": [], "sample_idx": [], "integral": []}).astype({"channel": "int64", "sample_idx": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = list(self.waiting.get())
        if not blocks:
            return
        held = pd.DataFrame({c: np.frombuffer(b"".join(b[k] for b in blocks), kind) for k, (c, kind) in enumerate(self._KINDS.items())})
        due = held["us"] <= timerValues.getCurrentWatermarkInMs() * 1000
        if not due.any():
            return
        self.waiting.clear()
        if not due.all():
            self._wait(held[~due])
        yield self._summed(held[due].sort_values([*_CHANNEL, "us", "sample_idx"], kind="stable"))


def running_integral(samples: DataFrame, threshold: float, dt: float, late: str | None = None, groups: int = GROUPS) -> DataFrame:
    """channel, sample_idx, integral of samples (channel, sample_idx, value).

    Without ``late`` the samples of a channel must come in order of batches and
    are given out at once. With it, samples also have ``ts`` and may come up to
    ``late`` behind the latest one seen in any channel: a sample is given out in
    order of time, then number, once the watermark has passed it; what comes
    later than that is dropped. The state holds the samples of that delay.
    Values that are null or NaN count as 0; rows without a time are dropped.
    Channels are kept in ``groups`` groups, so that a batch takes as many calls and
    not one per channel; a stream that goes on must keep the number.
    """
    group = F.pmod(F.xxhash64("channel"), F.lit(groups)).alias("group")
    told = [group, F.col("channel").isNull().alias("blank"), F.coalesce(F.col("channel").cast("long"), F.lit(0)).alias("channel"), "sample_idx", "value"]
    out = "channel long, sample_idx long, integral double"
    if late is None:
        return samples.select(*told).groupBy("group").transformWithStateInPandas(_Integral(threshold, dt), out, "Append", "None")
    timed = samples.filter("ts is not null").select(*told, "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return timed.groupBy("group").transformWithStateInPandas(_OrderedIntegral(threshold, dt), out, "Append", "EventTime")


def assign_stream(peaks: DataFrame, offset_s: float, period_s: float, tol_s: float) -> DataFrame:
    """packet, channel, peak_s: earliest peak within ``tol_s`` of each expected
    arrival, given out once the packet's window has closed; later peaks are dropped."""
    t = F.unix_micros("ts") / 1e6
    packet = F.round((t - offset_s) / period_s).cast("long")
    placed = peaks.select("channel", t.alias("t"), packet.alias("packet")).filter(F.abs(F.col("t") - offset_s - F.col("packet") * period_s) <= tol_s)
    target = placed.withColumn("target_ts", F.timestamp_micros(((offset_s + F.col("packet") * period_s) * 1e6).cast("long")))
    grouped = target.withWatermark("target_ts", f"{tol_s} seconds").groupBy(F.window("target_ts", f"{period_s} seconds"), "packet", "channel")
    return grouped.agg(F.min("t").alias("peak_s")).select("packet", "channel", "peak_s")


def assign_to_expected(peaks: DataFrame, expected: DataFrame, tol_s: float, late: str) -> DataFrame:
    """packet, channel, target_ts, peak_ts: the earliest peak within ``tol_s`` of each expected arrival.

    ``peaks`` is a stream of (channel, ts), ``expected`` one of (packet, channel,
    target_ts), so that a change of the period is followed as it comes. Rows of
    both may come up to ``late`` behind the latest one of their stream; what
    comes later is dropped. Peaks and arrivals wait for each other only while the
    watermarks allow a match, and an arrival is given out once both streams have
    passed it. Arrivals without a peak and rows without a time or channel give nothing.
    """
    p = peaks.filter("ts is not null").select(F.col("channel").alias("__c"), "ts").withWatermark("ts", late)
    x = expected.filter("target_ts is not null").select("packet", "channel", "target_ts").withWatermark("target_ts", late)
    tol = F.expr(f"make_dt_interval(0, 0, 0, {tol_s})")
    met = p.join(x, (F.col("__c") == F.col("channel")) & (F.col("ts") >= F.col("target_ts") - tol) & (F.col("ts") <= F.col("target_ts") + tol))
    # the peak's time is a number from here on: one event time is left
    timed = met.select("packet", "channel", "target_ts", F.unix_micros("ts").alias("us"))
    first = timed.groupBy(F.window("target_ts", f"{max(tol_s, 1)} seconds"), "packet", "channel", F.unix_micros("target_ts").alias("target")).agg(F.min("us").alias("us"))
    return first.select("packet", "channel", F.timestamp_micros("target").alias("target_ts"), F.timestamp_micros("us").alias("peak_ts"))
