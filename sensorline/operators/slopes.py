"""Median of the slopes of all pairs of points, by counting inversions."""

from __future__ import annotations

import numpy as np

#: Points up to which all pairs are formed at once.
FEW = 64
#: Slopes sampled per point, and middle pairs held per point.
SAMPLES, HELD = 32, 64
_UNIT = float(np.finfo(float).eps)


def _turned(v: np.ndarray, slack: float, listed: bool):
    """Pairs i < j with v[j] < v[i] + slack: their number, or with ``listed`` the pairs
    (then v[j] <= v[i] + slack). Halves of growing blocks are searched level by level:
    a level is one sort and one search."""
    n = len(v)
    place = np.arange(n)
    ranks = np.unique(np.concatenate([v, v + slack]), return_inverse=True)[1]
    own, limit = ranks[:n], ranks[n:]
    count, found, width = 0, [], 1
    while width < n:
        block, right = place // (2 * width), (place // width) % 2 == 1
        there = place[right]
        there = there[np.lexsort((own[there], block[there]))]
        keys = block[there] * (2 * n + 1) + own[there]
        left = place[~right]
        start = np.searchsorted(keys, block[left] * (2 * n + 1), "left")
        stop = np.searchsorted(keys, block[left] * (2 * n + 1) + limit[left], "right" if listed else "left")
        many = np.maximum(stop - start, 0)
        count += int(many.sum())
        if listed:
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)
            found.append((np.repeat(left, many), there[at]))
        width *= 2
    if not listed:
        return count
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (place[:0], place[:0])


def _chunks(s: np.ndarray, t: np.ndarray, size: int = 1 << 16):
    """Slopes of all pairs of points in order of s, some rows of pairs at a time."""
    n = len(s)
    rows = max(1, size // n)
    for begin in range(0, n - 1, rows):
        a = np.arange(begin, min(begin + rows, n - 1))
        ds, dt = s[None, begin + 1 :] - s[a, None], t[None, begin + 1 :] - t[a, None]
        rising = ds > 0  # in order of s, so a later point lies to the right or at the same place
        yield dt[rising] / ds[rising]


def _by_digits(s: np.ndarray, t: np.ndarray, wanted: list[int]) -> list[float]:
    """Slopes of the ranks ``wanted``: four passes over all pairs fix 16 bits of the answer each."""

    def keys(slopes: np.ndarray) -> np.ndarray:
        bits = (slopes + 0.0).view(np.uint64)
        return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))

    out = []
    for rank in wanted:
        prefix, left = 0, rank
        for level in range(3, -1, -1):
            total = np.zeros(1 << 16, np.int64)
            for part in _chunks(s, t):
                k = keys(part)
                if level < 3:
                    k = k[k >> np.uint64(16 * (level + 1)) == np.uint64(prefix)]
                total += np.bincount((k >> np.uint64(16 * level)).astype(np.int64) & 0xFFFF, minlength=1 << 16)
            upto = np.cumsum(total)
            digit = int(np.searchsorted(upto, left, "right"))
            left -= int(upto[digit] - total[digit])
            prefix = prefix << 16 | digit
        bits = prefix ^ (1 << 63) if prefix >> 63 else ~prefix & (1 << 64) - 1
        out.append(float(np.array([bits], np.uint64).view(float)[0]))
    return out


def _selected(s: np.ndarray, t: np.ndarray, pairs: int, wanted: list[int]) -> list[float] | None:
    """Slopes of the ranks ``wanted``, or None where too many lie too close together.

    Sampled slopes give bounds about the median. Pairs that are below or above them
    beyond doubt of rounding are counted as inversions of t - bound * s; all others
    are listed and their slopes worked out. The three numbers must add up.
    """
    n = len(s)
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, n, (2, SAMPLES * n))
    ds = s[b] - s[a]
    sample = np.sort((t[b] - t[a])[ds != 0] / ds[ds != 0])
    if not len(sample):
        return None
    middle, reach = len(sample) / 2, 1.5 * np.sqrt(len(sample))
    lo, hi = sample[max(0, int(middle - reach))], sample[min(len(sample) - 1, int(middle + reach))]
    doubt = lambda m: 8 * _UNIT * (np.abs(t).max() + abs(m) * (np.abs(s).max() + np.ptp(s)))
    low, high, e_lo, e_hi = t - lo * s, t - hi * s, doubt(lo), doubt(hi)
    down = np.lexsort((-t, s))  # at one place the higher first: never above
    below, above = _turned(low, -e_lo, False), _turned(-high[down], -e_hi, False)
    if not (below <= wanted[0] and wanted[-1] < pairs - above) or pairs - below - above > HELD * n + n ** 1.5:
        return None
    order = np.lexsort((s, low))
    x, y = _turned(high[order], e_hi, True)
    near = np.searchsorted(low[order], low[order] + e_lo, "right") - np.arange(n) - 1
    if near.sum() > HELD * n:
        return None
    x2 = np.repeat(np.arange(n), near)
    y2 = x2 + 1 + np.arange(len(x2)) - np.repeat(np.cumsum(near) - near, near)
    p, q = np.concatenate([order[x], order[y2]]), np.concatenate([order[y], order[x2]])
    held = (s[q] > s[p]) & (high[q] <= high[p] + e_hi) & (low[q] >= low[p] - e_lo)
    p, q = p[held], q[held]
    if below + above + len(p) != pairs:
        return None
    slopes = np.sort((t[q] - t[p]) / (s[q] - s[p]))
    return [float(slopes[k - below]) for k in wanted]


def median_slope(s: np.ndarray, t: np.ndarray) -> float:
    """Median of (t_b - t_a) / (s_b - s_a) over all pairs with s_b > s_a, bit for bit
    as if all were sorted; NaN if there is none. Memory grows with n to the power
    1.5 at most; lines so straight that rounding alone parts their slopes take time
    in n squared and memory in n."""
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    ties = np.unique(s, return_counts=True)[1]
    pairs = len(s) * (len(s) - 1) // 2 - int((ties * (ties - 1) // 2).sum())
    if pairs == 0:
        return float("nan")
    wanted = [(pairs - 1) // 2, pairs // 2]
    if len(s) <= FEW:
        slopes = np.sort(np.concatenate(list(_chunks(s, t))))
        got = [slopes[k] for k in wanted]
    else:
        got = _selected(s, t, pairs, wanted) or _by_digits(s, t, wanted)
    return float((got[0] + got[1]) / 2)
