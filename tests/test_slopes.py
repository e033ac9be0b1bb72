"""Median slopes against all pairs."""

import numpy as np
import pytest

from sensorline.operators import doa, slopes


def _all_pairs(s, t):
    ds = s[None] - s[:, None]
    v = np.sort(((t[None] - t[:, None])[ds > 0]) / ds[ds > 0])
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if len(v) else np.nan


@pytest.mark.parametrize("kind", ["noise", "line", "outliers", "flat", "ties", "few places", "far", "two lines"])
@pytest.mark.parametrize("n", [2, 3, 40, 65, 300, 1176])
def test_equal_to_all_pairs_bit_for_bit(kind, n):
    for seed in range(3):
        rng = np.random.default_rng([seed, n])
        s, noise = np.sort(rng.random(n) * 1000), rng.normal(size=n)
        t = {
            "noise": noise, "line": 3 + s / 1475, "outliers": s / 1475 + np.where(rng.random(n) < 0.3, noise, noise * 1e-4), "flat": np.full(n, 7.0),
            "ties": np.round(noise), "few places": noise, "far": 1e9 + s * 1e-3 + noise * 1e-2, "two lines": np.where(rng.random(n) < 0.5, s, -s),
        }[kind]
        s = np.round(s / 100) if kind == "few places" else s
        mixed = rng.permutation(n)
        assert np.array_equal(slopes.median_slope(s[mixed], t[mixed]), _all_pairs(s, t), equal_nan=True)


def test_noisy_groups_are_selected_and_digits_agree():
    rng = np.random.default_rng(5)
    s = np.sort(rng.random(1176) * 4704)
    t = s / 1475 + rng.normal(size=1176) * 1e-3
    pairs = 1176 * 1175 // 2
    wanted = [(pairs - 1) // 2, pairs // 2]
    got = slopes._selected(s, t, pairs, wanted)
    assert got is not None and got == slopes._by_digits(s, t, wanted)
    big = np.sort(rng.random(50_000))
    found = slopes.median_slope(big, 2 * big + rng.normal(size=50_000))
    assert found == pytest.approx(2, abs=0.1)


def test_fit_takes_long_short_and_broken_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(1, 0, c, float(c), c / 1475 + float(rng.normal()) * 1e-3) for c in range(200)]
    rows += [(2, 0, 0, 1.0, 2.0), (2, 0, 1, 1.0, 3.0), (3, 0, 0, 0.0, 1.0), (3, 0, 1, 2.0, 5.0), (3, 0, 2, None, 9.0), (3, 0, 3, 4.0, None), (3, 0, 4, 5.0, float("nan"))]
    points = spark.createDataFrame(rows, "packet long, subarray_id long, channel int, s double, t double")
    got = {r.packet: r for r in doa.theil_sen_fit(points).collect()}
    s, t = np.arange(200.0), np.array([r[4] for r in rows[:200]])
    assert set(got) == {1, 3}
    assert got[1].slope == _all_pairs(s, t) and got[1].n == 200
    assert got[1].intercept == np.median(t - got[1].slope * s)
    assert (got[3].slope, got[3].intercept, got[3].n) == (2.0, 1.0, 2)
    assert doa.theil_sen_fit(points.filter("packet > 9")).count() == 0
