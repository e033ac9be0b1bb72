"""The signal path in blocks and cells against whole runs worked out in plain NumPy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.operators import detection, signal


def blocks(spark, channels, size):
    rows = [(c, k // size, k, [float(v) for v in x[k : k + size]]) for c, x in channels.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, "channel long, block_no long, start_sample long, samples array<double>")


def whole(df):
    out = {}
    for r in df.orderBy("channel", "start_sample").collect():
        out.setdefault(r.channel, []).extend(r.samples)
    return {c: np.array(v) for c, v in out.items()}


def recursion(sos, x):
    for b0, b1, b2, _, a1, a2 in sos:
        y, s1, s2 = np.zeros(len(x)), 0.0, 0.0
        for n, v in enumerate(x):
            y[n] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[n] + s2, b2 * v - a2 * y[n]
        x = y
    return x


def analytic(x):
    n = len(x)
    gain = np.array([1.0 if k == 0 or 2 * k == n else 2.0 if 2 * k < n else 0.0 for k in range(n)])
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


@pytest.mark.parametrize("size", [64, 5000])
def test_bandpass_is_the_recursion_sample_by_sample(spark, size, monkeypatch):
    monkeypatch.setattr(signal, "SCAN_BLOCKS", 8)
    rng = np.random.default_rng(1)
    channels = {1: rng.standard_normal(3000), 2: rng.standard_normal(777), 3: np.ones(1)}
    sos = signal.butterworth_bandpass(10.0, 12.0, 100.0, 6)
    got = whole(signal.bandpass(blocks(spark, channels, size), 10.0, 12.0, 100.0, 6))
    for c, x in channels.items():
        assert np.abs(got[c] - recursion(sos, x)).max() < 1e-9


@pytest.mark.parametrize(("size", "tile"), [(64, 512), (1000, signal.TILE)])
def test_envelope_is_one_transform_over_the_run(spark, size, tile):
    """Run lengths with and without divisors (4999 is prime), slow parts and a constant among them."""
    rng = np.random.default_rng(2)
    channels = {1: rng.standard_normal(5000) + 3, 2: rng.standard_normal(4999), 3: np.zeros(10), 4: np.array([2.0]), 5: np.cos(np.arange(3986) / 600)}
    assert signal.grid_of(4999, tile).exact is False and signal.grid_of(5000, tile).exact is True
    got = whole(signal.envelope(blocks(spark, channels, size), tile))
    for c, x in channels.items():
        want = analytic(x)
        assert np.abs(got[c] - want / (want.max() or 1.0)).max() < 1e-9


def test_one_channel_is_many_tasks():
    g = signal.grid_of(72_250_000)
    assert g.exact and -(-g.cols // signal._tiles(g.cols, g.rows, signal.TILE)) >= 32


def test_long_templates_are_correlated_across_blocks(spark):
    rng = np.random.default_rng(3)
    x, ref = rng.standard_normal(2000), rng.standard_normal(300)
    got = whole(signal.matched_filter(blocks(spark, {1: x}, 64), ref.tolist()))
    assert np.abs(got[1] - np.correlate(x, ref, "valid")).max() < 1e-9
    assert whole(signal.matched_filter(blocks(spark, {1: x[:100]}, 64), ref.tolist()))[1].size == 0


def test_tails_are_the_samples_before_a_block(spark):
    x = np.arange(1000.0)
    for length in (1, 63, 64, 65, 400):
        for r in signal._with_tail(blocks(spark, {1: x}, 64), length).collect():
            assert r.tail == x[max(0, r.start_sample - length) : r.start_sample].tolist()


def peaks(at, v, height, prominence, distance):
    """Peaks of one channel by comparison with every sample."""
    tops, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i] > v[i - 1] and j + 1 < len(v) and v[j + 1] < v[i] and v[i] >= height:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (-v[p], p)):
        if all(abs(at[p] - at[q]) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        a = p
        while a and v[a - 1] <= v[p]:
            a -= 1
        b = p
        while b + 1 < len(v) and v[b + 1] <= v[p]:
            b += 1
        rise = v[p] - max(min(v[a : p + 1]), min(v[p : b + 1]))
        if rise >= prominence:
            out.append((int(at[p]), v[p], rise))
    return out


def test_peaks_equal_brute_force_for_any_cells(spark):
    rng = np.random.default_rng(4)
    shapes = {1: rng.integers(0, 9, 500), 2: np.cumsum(rng.integers(-1, 2, 700)), 3: [1, 2, 2, 2, 1], 4: [3] * 50, 5: [k % 7 + k // 7 for k in range(300)], 6: [5]}
    series = {c: (np.cumsum(rng.integers(1, 4, len(v))) if c % 2 else np.arange(len(v)), np.array(v, float)) for c, v in shapes.items()}
    rows = [(c, int(a), float(x)) for c, (at, v) in series.items() for a, x in zip(at, v)] + [(1, -5, None)]
    df = spark.createDataFrame(rows, "channel long, sample_idx long, value double").repartition(5).cache()
    for cell, distance, height, prominence in ((16, 7, 2.0, 1.0), (5, 40, -50.0, 2.0), (detection.CELL, 1, 3.0, 0.0)):
        got = sorted(map(tuple, detection.find_peaks(df, height, prominence, distance, cell).collect()))
        assert got == sorted((c, *p) for c, (at, v) in series.items() for p in peaks(at, v, height, prominence, distance))
    tops = detection.local_maxima(df, 0.0, cell=16).cache()
    for distance in (3, 25):
        kept = sorted(map(tuple, detection.keep_distant(tops, distance, zone=2 * distance).collect()))
        assert kept == sorted((c, p, x) for c, (at, v) in series.items() for p, x, _ in peaks(at, v, 0.0, -1e9, distance))
    assert detection.find_peaks(df.limit(0), 1.0, 1.0, 3).count() == 0


def test_a_long_channel_is_many_cells(spark):
    n = 3_000_000
    series = spark.range(n).select(F.lit(7).alias("channel"), F.col("id").alias("sample_idx"), (F.abs(F.xxhash64("id")) % 1000 / 1.0).alias("value"))
    assert detection._cells(series, detection.CELL).count() == -(-n // detection.CELL) >= 32
    found = detection.find_peaks(series, 900.0, 500.0, 2000).collect()
    at = sorted(r.peak for r in found)
    assert len(at) > 500 and min(b - a for a, b in zip(at, at[1:])) >= 2000
