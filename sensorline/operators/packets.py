"""Packet decoding as batch jobs: hop selection, deinterleaving, Viterbi, CRC, fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHIPS, TONES = 176, 26
#: Pilot chips before the data, interleaver step, code polynomials and memory.
PILOT_CHIPS, INTERLEAVE_STEP = 32, 13
POLYNOMIALS, MEMORY = (0b111101011, 0b101110001), 8
#: Receptions that are decoded together: their costs fit in a core's cache.
TOGETHER = 512
CRC_POLY = 0x107
#: First bit and number of bits of each field of a 64-bit packet.
FIELDS = {
    "version": (0, 4), "mobility": (4, 1), "schedule": (5, 1), "txRxFlag": (6, 1), "canForward": (7, 1),
    "classUserID": (8, 8), "appType": (16, 6), "appData": (22, 34), "crc8": (56, 8),
}


def extract_receptions(samples: DataFrame, arrivals: DataFrame, length: int) -> DataFrame:
    """packet, channel, samples: ``length`` values from each arrival on; 0 where there is no sample."""
    from sensorline.operators.conditioning import window_around

    points = arrivals.select("channel", "packet", F.col("sample_idx").alias("at"))
    cut = window_around(samples, points, 0, length).groupBy("packet", "channel").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rel").cast("int").alias("rel"), "value"))).alias("m"))
    held = arrivals.select("packet", "channel").distinct().join(cut, ["packet", "channel"], "left")
    fill = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return held.select("packet", "channel", F.coalesce(fill, F.array_repeat(F.lit(0.0), length)).alias("samples"))


def chip_dft(receptions: DataFrame, fs: float, f_min: float, df: float, chips: int = CHIPS, tones: int = TONES) -> DataFrame:
    """channel, packet, chip, bin, re, im: correlation of each chip with e^{+2 pi i f t}
    at ``tones`` frequencies f_min + bin * df; a matrix product over all chips of a batch."""
    per_chip = round(fs / df)
    t = np.arange(per_chip) / fs
    tone = np.exp(2j * np.pi * np.outer(t, f_min + df * np.arange(tones)))

    @F.pandas_udf("array<double>")
    def bins(x: pd.Series) -> pd.Series:
        def one(v):
            full = np.zeros(chips * per_chip)
            v = np.asarray(v, float)[: len(full)]
            full[: len(v)] = v
            y = full.reshape(chips, per_chip) @ tone
            return np.stack([y.real, y.imag], -1).ravel()

        return pd.Series([one(v) for v in x])

    flat = receptions.select("channel", "packet", bins("samples").alias("y"))
    pairs = flat.select("channel", "packet", "y", F.explode(F.sequence(F.lit(0), F.lit(chips * tones - 1))).alias("i"))
    return pairs.select("channel", "packet", F.floor(F.col("i") / tones).cast("int").alias("chip"), (F.col("i") % tones).alias("bin"), F.get("y", 2 * F.col("i")).alias("re"), F.get("y", 2 * F.col("i") + 1).alias("im"))


def reception_snr(bins: DataFrame, hop: DataFrame, shift: int = 6) -> DataFrame:
    """channel, packet, snr_db, noise_rms: energy in the permitted bins of the hop
    pattern (chip, slot; bins 2*slot and 2*slot + 1) over the energy in the same
    pattern ``shift`` chips on. The first chip of each half is left out."""
    n = hop.agg(F.count("*").alias("n"))  # one row
    rolled = hop.join(F.broadcast(n)).select(((F.col("chip") + shift) % F.col("n")).alias("chip"), F.col("slot").alias("noise_slot"))
    pattern = hop.join(rolled, "chip").filter(F.col("chip") != 0)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    met = bins.join(F.broadcast(pattern), "chip")
    half = F.floor(F.col("bin") / 2)
    g = met.groupBy("channel", "packet").agg(F.sum(F.when(half == F.col("slot"), power)).alias("s"), F.sum(F.when(half == F.col("noise_slot"), power)).alias("z"))
    return g.select("channel", "packet", F.when((F.col("s") > 0) & (F.col("z") > 0), 10 * F.log10(F.col("s") / F.col("z"))).alias("snr_db"), F.sqrt("z").alias("noise_rms"))


def stack_receptions(bins: DataFrame, snr: DataFrame, min_snr: float = 3.0) -> DataFrame:
    """packet, chip, bin, level: sum over channels of magnitude / noise of receptions with enough SNR."""
    good = snr.filter((F.col("snr_db") >= min_snr) & (F.col("noise_rms") > 0)).select("channel", "packet", "noise_rms")
    level = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("noise_rms")
    return bins.join(good, ["channel", "packet"]).groupBy("packet", "chip", "bin").agg(F.sum(level).alias("level"))


def hop_bits(bins: DataFrame, hop: DataFrame) -> DataFrame:
    """channel, packet, chip, bit: 1 if the upper of the two permitted bins is the stronger."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    met = bins.join(F.broadcast(hop), "chip").filter(F.floor(F.col("bin") / 2) == F.col("slot"))
    return met.groupBy("channel", "packet", "chip").agg(F.max_by((F.col("bin") % 2).cast("int"), F.struct(power.alias("p"), -F.col("bin"))).alias("bit"))


def deinterleave(bits: DataFrame, keys: tuple[str, ...] = ("channel", "packet"), n: int = CHIPS - PILOT_CHIPS, q: int = INTERLEAVE_STEP, skip: int = PILOT_CHIPS) -> DataFrame:
    """keys, bits: chips after the pilot, the i-th put to place (i * q) mod n."""
    moved = bits.filter(F.col("chip") >= skip).select(*keys, F.pmod((F.col("chip") - skip) * q, F.lit(n)).alias("at"), "bit")
    return moved.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"]).alias("bits"))


def viterbi(coded: np.ndarray, n_bits: int) -> np.ndarray:
    """Bits (receptions x n_bits) of hard-decided code bits (receptions x 2 * (n_bits + MEMORY)).

    Costs lie as states x receptions, so a step is a few passes over rows of
    neighbours. State s comes from 2s and 2s + 1 (modulo the states); ties take the even one.
    """
    states, steps = 1 << MEMORY, n_bits + MEMORY
    register = np.arange(2 * states)  # new bit above the memory
    out = np.stack([[bin(r & p).count("1") & 1 for r in register] for p in POLYNOMIALS], 1)
    sent = (out[:, 0] << 1 | out[:, 1]).reshape(states, 2)
    x = coded.reshape(len(coded), steps, 2).transpose(1, 2, 0)
    cost = np.full((states, len(coded)), 10_000, np.int16)
    cost[0] = 0
    came = np.empty((steps, states, len(coded)), bool)
    for k in range(steps):
        miss = np.stack([(x[k, 0] != (s >> 1)).astype(np.int16) + (x[k, 1] != (s & 1)) for s in range(4)])
        even = np.concatenate([cost[0::2]] * 2) + miss[sent[:, 0]]
        odd = np.concatenate([cost[1::2]] * 2) + miss[sent[:, 1]]
        np.less(odd, even, out=came[k])
        cost = np.minimum(even, odd)
    state, row = np.zeros(len(coded), np.int64), np.arange(len(coded))
    bits = np.empty((steps, len(coded)), np.int32)
    for k in range(steps - 1, -1, -1):
        bits[k] = state >> (MEMORY - 1)
        state = (state << 1 | came[k, state, row]) & (states - 1)
    return bits[:n_bits].T


def convolutional_decode(coded: DataFrame, keys: tuple[str, ...] = ("channel", "packet"), n_bits: int = 64) -> DataFrame:
    """keys, bits: hard-decision Viterbi decoding of the rate 1/2 code.

    Some hundred receptions advance through the 256 states together. Missing code
    bits count as 0, surplus ones do not count; a null among them is an error.
    """
    width = 2 * (n_bits + MEMORY)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keys))
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("null among the code bits")
            x = np.zeros((len(column), width), np.int8)
            held = np.arange(width) < size[:, None]
            x[held] = flat.to_numpy()[((np.cumsum(size) - size)[:, None] + np.arange(width))[held]]
            bits = np.concatenate([viterbi(x[a : a + TOGETHER], n_bits) for a in range(0, len(x), TOGETHER)] or [np.zeros((0, n_bits), np.int32)])
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_bits), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, "bits"])

    kinds = ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in keys)
    return coded.select(*keys, "bits").mapInArrow(run, f"{kinds}, bits array<int>")


def bits_to_long(bits: Column) -> Column:
    """Number of a run of bits, the first one highest; more than 64 bits are an error."""
    number = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))
    return F.when(F.size(bits) > 64, F.raise_error(F.lit("more than 64 bits")).cast("long")).otherwise(number)


def crc8(bits: Column) -> Column:
    """CRC-8 (x^8 + x^2 + x + 1) of the bits."""

    def step(acc, b):
        top = F.shiftright(acc, 7).bitwiseXOR(b.cast("int")).bitwiseAND(1)
        moved = F.shiftleft(acc, 1).bitwiseAND(0xFF)
        return F.when(top == 1, moved.bitwiseXOR(CRC_POLY & 0xFF)).otherwise(moved)

    return F.aggregate(bits, F.lit(0), step)


def crc8_valid(bits: Column) -> Column:
    """Whether the last 8 of 64 bits are the CRC of the first 56; all zeros are no packet."""
    some = F.exists(bits, lambda b: b != 0)
    return some & (crc8(F.slice(bits, 1, 56)) == bits_to_long(F.slice(bits, 57, 8)).cast("int"))


def unpack_fields(decoded: DataFrame, keys: tuple[str, ...] = ("channel", "packet")) -> DataFrame:
    """keys, the fields of a packet as numbers, and valid."""
    wide = ("appData",)
    return decoded.select(*keys, *[bits_to_long(F.slice("bits", a + 1, n)).cast("long" if f in wide else "int").alias(f) for f, (a, n) in FIELDS.items()], crc8_valid(F.col("bits")).alias("valid"))


def decode_packets(samples: DataFrame, arrivals: DataFrame, hop: DataFrame, fs: float, f_min: float, df: float) -> DataFrame:
    """Samples and arrivals to decoded packets."""
    length = round(fs / df) * CHIPS
    bins = chip_dft(extract_receptions(samples, arrivals, length), fs, f_min, df)
    return unpack_fields(convolutional_decode(deinterleave(hop_bits(bins, hop))))
