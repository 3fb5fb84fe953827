"""Standard errors of a mean, robust to autocorrelation: Bartlett weights, automatic bandwidth, prewhitening."""

from __future__ import annotations

import numpy as np


def ar1(e: np.ndarray) -> tuple[float, np.ndarray]:
    """Coefficient of e on its own last value, without a constant, and the residuals."""
    below = float(e[:-1] @ e[:-1])
    rho = float(e[:-1] @ e[1:]) / below if below > 0 else 0.0
    return rho, e[1:] - rho * e[:-1]


def bandwidth(e: np.ndarray, prewhite: int = 1) -> float:
    """The automatic bandwidth of Newey and West (1994) for the Bartlett kernel."""
    n = len(e)
    m = int(np.floor((3 if prewhite else 4) * (n / 100) ** (2 / 9)))
    u = ar1(e)[1] if prewhite else e
    k = len(u)
    m = min(m, k - 1)
    autocovariance = np.asarray([u[: k - j] @ u[j:] / k for j in range(m + 1)])
    s0 = autocovariance[0] + 2 * autocovariance[1:].sum()
    s1 = 2 * (np.arange(1, m + 1) * autocovariance[1:]).sum()
    return 0.0 if s0 == 0 else float(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))


def newey_west_se(series: np.ndarray, lag: int | None = None, prewhite: int = 1, adjust: bool = False) -> float:
    """Of the mean of a series in the order of time; NaN values are left out."""
    y = np.asarray(series, float)
    y = y[~np.isnan(y)]
    n = len(y)
    if n < 2:
        return float("nan")
    e = y - y.mean()
    if e @ e == 0:
        return 0.0
    lags = int(np.floor(bandwidth(e, prewhite))) if lag is None else int(lag)
    rho, u = ar1(e) if prewhite else (0.0, e)
    total = float(u @ u)
    for j in range(1, min(lags, len(u) - 1) + 1):
        total += 2 * (1 - j / (lags + 1)) * float(u[:-j] @ u[j:])
    if prewhite:
        total /= (1 - rho) ** 2
    if adjust:
        total *= n / (n - 1)
    return float(np.sqrt(total / n**2)) if total >= 0 else float("nan")
