"""Small matrix maths on aggregated moments.

Nothing here touches observation rows: inputs are the one-row-per-group sums that
Spark aggregates (a few hundred doubles at most), outputs are coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Moments:
    """Sums over a group of rows of features (with gaps) and a label (without).

    ``s`` and ``S`` hold sums and cross products over present values, ``M[i, j]``
    the sum of variable i where feature j is missing, ``N[i, j]`` the rows where
    both are missing. From these the moments after mean imputation follow exactly,
    so one pass over the data serves any imputation value.
    """

    n: float
    s: np.ndarray
    S: np.ndarray
    M: np.ndarray
    N: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def unpack(cls, n, sums, lows, highs) -> Moments:
        p = len(lows)
        d = p + 1
        it = iter(np.asarray(sums, dtype=float))
        s = np.array([next(it) for _ in range(d)])
        S = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                S[i, j] = S[j, i] = next(it)
        M = np.zeros((d, p))
        for j in range(p):
            for i in range(d):
                if i != j:
                    M[i, j] = next(it)
        N = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                N[i, j] = N[j, i] = next(it)
        to_float = lambda values: np.array([np.nan if v is None else float(v) for v in values])
        return cls(float(n), s, S, M, N, to_float(lows), to_float(highs))

    def __add__(self, other: Moments) -> Moments:
        return Moments(
            self.n + other.n,
            self.s + other.s,
            self.S + other.S,
            self.M + other.M,
            self.N + other.N,
            np.fmin(self.low, other.low),
            np.fmax(self.high, other.high),
        )

    def feature_means(self) -> np.ndarray:
        p = len(self.low)
        present = self.n - np.diag(self.N)
        return np.divide(self.s[:p], present, out=np.zeros(p), where=present > 0)

    def second_moments(self, impute: np.ndarray) -> np.ndarray:
        """Second-moment matrix of (1, features, label) once gaps hold ``impute``."""
        p = len(self.low)
        missing = np.diag(self.N)
        A = np.zeros((p + 2, p + 2))
        A[0, 0] = self.n
        A[0, 1:] = self.s
        A[0, 1 : p + 1] += missing * impute
        inner = self.S.copy()
        inner[:, :p] += self.M * impute[None, :]
        inner[:p, :] += (self.M * impute[None, :]).T
        inner[:p, :p] += self.N * np.outer(impute, impute)
        A[1:, 1:] = inner
        A[1:, 0] = A[0, 1:]
        return A


def affine(A: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Second moments after every feature x becomes (x - low) / span; span 0 maps to 0."""
    p = len(low)
    factor = np.divide(1.0, span, out=np.zeros(p), where=span > 0)
    T = np.eye(p + 2)
    T[np.arange(1, p + 1), np.arange(1, p + 1)] = factor
    T[1 : p + 1, 0] = -low * factor
    return T @ A @ T.T


def covariance(A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred second moments (sums, not averages) and means of (features, label)."""
    n = A[0, 0]
    mean = A[0, 1:] / n
    return A[1:, 1:] - n * np.outer(mean, mean), mean


def solve_ridge(A: np.ndarray, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Slopes and intercept of least squares with an unpenalised intercept."""
    C, mean = covariance(A)
    p = len(mean) - 1
    G = C[:p, :p] + alpha * np.eye(p)
    g = C[:p, p]
    try:
        if np.linalg.cond(G) > 1e13:
            raise np.linalg.LinAlgError
        beta = np.linalg.solve(G, g)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(G, g, rcond=1e-12)[0]
    return beta, float(mean[p] - beta @ mean[:p])


def solve_lasso(A: np.ndarray, alpha: float, sweeps: int = 10_000, tol: float = 1e-14) -> tuple[np.ndarray, float]:
    """Coordinate descent on the objective SSE / (2n) + alpha * sum(abs(beta))."""
    C, mean = covariance(A)
    p = len(mean) - 1
    n = A[0, 0]
    G, g = C[:p, :p] / n, C[:p, p] / n
    beta = np.zeros(p)
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(p):
            if G[j, j] <= 0:
                continue
            rho = g[j] - G[j] @ beta + G[j, j] * beta[j]
            beta[j] = math.copysign(max(abs(rho) - alpha, 0.0), rho) / G[j, j]
        if np.max(np.abs(beta - before), initial=0.0) < tol:
            break
    return beta, float(mean[p] - beta @ mean[:p])


def squared_error(A: np.ndarray, beta: np.ndarray, intercept: float) -> float:
    w = np.concatenate([[-intercept], -beta, [1.0]])
    return float(max(w @ A @ w, 0.0))


def r_squared(A: np.ndarray, beta: np.ndarray, intercept: float) -> float:
    C, _ = covariance(A)
    total = C[-1, -1]
    error = squared_error(A, beta, intercept)
    if total <= 0:
        return 1.0 if error == 0 else 0.0
    return float(1.0 - error / total)


def normal_two_sided(statistic: float) -> float:
    return math.erfc(abs(statistic) / math.sqrt(2.0))


def student_two_sided(statistic: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta."""
    if math.isinf(statistic):
        return 0.0
    return _beta_inc(df / 2.0, 0.5, df / (df + statistic * statistic))


def student_quantile(prob: float, df: float) -> float:
    """Upper quantile of Student's t (prob > 0.5), by bisection on the tail."""
    target = 2.0 * (1.0 - prob)
    low, high = 0.0, 1.0
    while student_two_sided(high, df) > target:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if student_two_sided(mid, df) > target else (low, mid)
    return (low + high) / 2.0


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_fraction(b, a, 1.0 - x) * front / b
    return _beta_fraction(a, b, x) * front / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d or tiny)
        c = 1.0 + even / c or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d or tiny)
        c = 1.0 + odd / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h
