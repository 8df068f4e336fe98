"""Local regression over evenly spaced points, for one or many series of the same length at once."""

from __future__ import annotations

#: Numbers held at once.
HELD = 1 << 21


def neighbourhoods(n: int, q: int, at):
    """(places, weights) of the q nearest points to each of ``at``: tricube of the distance over that of the furthest one."""
    import numpy as np

    m = min(q, n)
    start = np.clip(np.floor(at).astype(np.int64) - (m - 1) // 2, 0, n - m)
    x = start[:, None] + np.arange(m)[None, :]
    h = np.maximum(at - start, start + m - 1 - at) + max(0, (q - n) // 2)
    r = np.abs(x - at[:, None])
    h = h[:, None]
    w = (1 - (r / np.where(h > 0, h, 1)) ** 3) ** 3
    return x, np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, w, 0.0))


def loess(v, q: int, rho=None, at=None):
    """Lines fitted to the q nearest points of each place; ``v`` and the weights ``rho`` are (series, points).

    The window slides with the place, so the work is q for each place, whatever the length of the series. Where all weights are zero the value stays.
    """
    import numpy as np

    v = np.atleast_2d(v)
    n = v.shape[1]
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, dtype=float)
    out = np.empty((len(v), len(at)))
    width = max(1, HELD // (len(v) * min(q, n)))
    for a in range(0, len(at), width):
        t = at[a : a + width]
        x, w = neighbourhoods(n, q, t)
        near = v[:, x]
        w = w[None] if rho is None else w[None] * np.atleast_2d(rho)[:, x]
        s = w.sum(axis=2)
        safe = np.where(s > 0, s, 1)
        mean = (w * x).sum(axis=2) / safe
        off = x[None] - mean[:, :, None]
        spread = (w * off * off).sum(axis=2) / safe
        slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (t[None] - mean) / np.where(spread > 0, spread, 1), 0.0)
        fit = (w * (1 + slope[:, :, None] * off) * near).sum(axis=2) / safe
        out[:, a : a + width] = np.where(s > 0, fit, v[:, np.clip(t.astype(np.int64), 0, n - 1)])
    return out


def _means(v, k: int):
    """Means of k neighbours by running sums."""
    import numpy as np

    total = np.concatenate([[0.0], np.cumsum(v - v.mean())])
    return (total[k:] - total[:-k]) / k + v.mean()


def _cycles(v, rho, period: int, q: int):
    """Every place of the cycle smoothed over the cycles, and one cycle more at both ends."""
    import numpy as np

    n = len(v)
    out = np.empty(n + 2 * period)
    long = n % period
    for first, last in ((0, long), (long, period)):  # those with one point more
        if first == last:
            continue
        own = np.arange(first, last)[:, None] + period * np.arange(-(-(n - first) // period))[None, :]
        at = np.arange(-1.0, own.shape[1] + 1)
        places = np.arange(first, last)[:, None] + period * np.arange(own.shape[1] + 2)[None, :]
        out[places] = loess(v[own], q, rho[own], at)
    return out


def decompose(y, period: int, rounds: int, seasonal: int = 7):
    """(trend, seasonal part): two inner passes (five without robust rounds), then ``rounds`` times with weights by the residuals."""
    import numpy as np

    n = len(y)
    odd = lambda x: int(np.ceil(x)) | 1
    q_trend, q_low = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period)
    trend, part, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(rounds + 1):
        for _ in range(2 if rounds else 5):
            cycle = _cycles(y - trend, rho, period, seasonal)
            low = loess(_means(_means(_means(cycle, period), period), 3), q_low)[0]
            part = cycle[period : period + n] - low
            trend = loess(y - part, q_trend, rho)[0]
        if k < rounds:
            r = np.abs(y - trend - part)
            h = 6 * np.median(r)
            rho = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / (h or 1)) ** 2) ** 2, 0.0))
    return trend, part
