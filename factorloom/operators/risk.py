"""Covariance estimates and portfolio weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_covariance(df: DataFrame, key: str, date: str, x: str) -> DataFrame:
    """Sample covariance and count of every pair of keys over their common dates (both orders and the diagonal).

    The pairs are the result; use `gram` where a dense matrix is wanted.
    """
    t = df.where(F.col(x).isNotNull()).select(date, F.col(key).alias("a"), F.col(x).alias("xa"))
    u = t.select(date, F.col("a").alias("b"), F.col("xa").alias("xb"))
    return t.join(u, date).groupBy("a", "b").agg(F.covar_samp("xa", "xb").alias("covariance"), F.count(F.lit(1)).alias("n"))


#: Most names of a dense matrix that may come to the driver (32 MB); more need the pairs as a table.
DENSE = 2000


def gram(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of an array<double> column of fixed length, at most DENSE long.

    Each partition folds its rows into one dim x dim block, row by row of the matrix as one
    array; the blocks are summed per matrix row in a second aggregate, so dim arrays of dim
    numbers reach the driver. Vectors of another length or with a missing value don't count.
    """
    if dim > DENSE:
        raise ValueError(f"{dim} names make too large a matrix for the driver; use pairwise_covariance")
    schema = pa.schema([("i", pa.int32()), ("g", pa.list_(pa.float64())), ("s", pa.float64()), ("n", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            v = b.column(0)
            v = v.filter(pc.fill_null(pc.equal(pc.list_value_length(v), dim), False))
            m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            m = m[~np.isnan(m).any(1)]
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        rows = pa.ListArray.from_arrays(pa.array(np.arange(dim + 1) * dim, pa.int32()), pa.array(g.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), rows, pa.array(s), pa.array(np.full(dim, n), pa.int64())], schema=schema)

    parts = df.select(vector).mapInArrow(fold, "i int, g array<double>, s double, n bigint")
    # summed element by element, so that a matrix row stays one array
    each = parts.select("i", "s", "n", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = each.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("g"), F.first("s").alias("s"), F.first("n").alias("n")).collect()
    out, sums = np.zeros((dim, dim)), np.zeros(dim)
    for r in rows:
        out[r["i"]], sums[r["i"]] = r["g"], r["s"]
    return int(rows[0]["n"]) if rows else 0, sums, out


def prepare(x: np.ndarray, prices: bool = False, scale: bool = False, missing: str = "fill", centre: bool = True) -> np.ndarray | np.ma.MaskedArray:
    """Returns (rows) of names (columns) made ready: from prices, in percent if scale, missing ones as 0 (fill), masked (mask) or kept (ignore), centred."""
    if missing not in ("fill", "mask", "ignore"):
        raise ValueError(f"unknown treatment {missing}")
    x = np.array(x, float)
    if prices:
        x = x[1:] / x[:-1] - 1
    if scale:
        x = x * 100
    y = np.nan_to_num(x) if missing == "fill" else np.ma.masked_invalid(x) if missing == "mask" else x
    return y - np.mean(y, axis=0) if centre else y


def empirical(x: np.ndarray | np.ma.MaskedArray) -> np.ndarray:
    """Population covariance of centred returns; with masked cells each pair over its own rows."""
    if isinstance(x, np.ma.MaskedArray):
        there = (~np.ma.getmaskarray(x)).astype(float)
        v = x.filled(0.0)
        return v.T @ v / np.maximum(there.T @ there, 1)
    return x.T @ x / len(x)


def as_correlation(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    return cov / np.outer(d, d)


def single_index(x: np.ndarray, market: np.ndarray) -> np.ndarray:
    """Covariance of the one-factor model: betas times the market's variance, and each residual's own variance (sample)."""
    m = market - market.mean()
    beta = m @ (x - x.mean(0)) / (m @ m)
    rest = x - x.mean(0) - np.outer(m, beta)
    return np.outer(beta, beta) * m.var(ddof=1) + np.diag(rest.var(axis=0, ddof=1))


def portfolio_of_estimators(x: np.ndarray, market: np.ndarray) -> np.ndarray:
    """Mean of the sample covariance, its diagonal and the single-index one."""
    s = np.cov(x, rowvar=False)
    return (s + np.diag(np.diag(s)) + single_index(x, market)) / 3


def shrink(x: np.ndarray, alpha: float | str = "lw", target: str | np.ndarray = "const_var") -> np.ndarray:
    """Covariance (population moments of centred x, rows are observations) shrunk towards a target.

    alpha: a number, lw (the intensity of least expected loss for the target) or oas (the
    approximating intensity, for const_var, with a plus sign in both brackets). target:
    const_var, const_corr, single_factor (the mean of the names as market) or a matrix,
    which needs a number.
    """
    x = x - x.mean(0)
    t, p = x.shape
    s = x.T @ x / t
    d = np.sqrt(np.diag(s))
    squares = x**2
    # sum of the asymptotic variances of the sample's entries, and of their covariances with the target's
    phi = squares.T @ squares / t - s**2
    if isinstance(target, np.ndarray):
        f, rho = target, 0.0
    elif target == "const_var":
        f, rho = np.eye(p) * np.trace(s) / p, 0.0
    elif target == "const_corr":
        r = ((s / np.outer(d, d)).sum() - p) / (p * (p - 1))
        f = r * np.outer(d, d)
        np.fill_diagonal(f, np.diag(s))
        theta = (x**3).T @ x / t - np.diag(s)[:, None] * s
        np.fill_diagonal(theta, 0)
        rho = np.trace(phi) + r * (np.outer(1 / d, d) * theta).sum()
    elif target == "single_factor":
        m = x.mean(1)
        c, v = x.T @ m / t, m @ m / t
        f = np.outer(c, c) / v
        np.fill_diagonal(f, np.diag(s))
        z = x * m[:, None]
        one = squares.T @ z / t - c[:, None] * s
        three = z.T @ z / t - v * s
        off = lambda a: a.sum() - np.trace(a)
        rho = np.trace(phi) + 2 * off(one * c[None, :]) / v - off(three * np.outer(c, c)) / v**2
    else:
        raise ValueError(f"unknown target {target}")
    if alpha == "lw":
        gap = np.sum((s - f) ** 2)
        alpha = float(np.clip((phi.sum() - rho) / gap / t, 0, 1)) if gap > 0 else 0.0
    elif alpha == "oas":
        a, b = np.sum(s**2), np.trace(s) ** 2
        alpha = float((1 - 2 / p) * (a + b) / ((t + 1 - 2 / p) * (a + b / p)))
    return (1 - alpha) * s + alpha * f


def threshold(r: np.ndarray, at: float, kind: str = "soft") -> np.ndarray:
    """Correlations thresholded off the diagonal: hard (small ones become 0), soft (all shrink) or scad (small ones shrink, large ones stay)."""
    a = np.abs(r)
    shrunk = np.sign(r) * np.maximum(a - at, 0)
    if kind == "hard":
        out = np.where(a > at, r, 0.0)
    elif kind == "soft":
        out = shrunk
    elif kind == "scad":
        # fixed value: 3.7, the usual constant of the penalty
        out = np.where(a < 2 * at, shrunk, np.where(a < 3.7 * at, (2.7 * r - 3.7 * np.sign(r) * at) / 1.7, r))
    else:
        raise ValueError(f"unknown threshold {kind}")
    np.fill_diagonal(out, 1.0)
    return out


def poet(x: np.ndarray, factors: int = 0, level: float = 1.0, kind: str = "soft") -> np.ndarray:
    """Covariance of principal factors plus thresholded residual correlations; the threshold is level times its rate of convergence."""
    t, p = x.shape
    s = x.T @ x / t
    values, vectors = np.linalg.eigh(s)
    common = vectors[:, p - factors :] * values[p - factors :] @ vectors[:, p - factors :].T if factors else np.zeros_like(s)
    rest = s - common
    rate = (1 / np.sqrt(p) if factors else 0.0) + np.sqrt(np.log(p) / t)
    d = np.sqrt(np.maximum(np.diag(rest), 1e-18))
    return common + threshold(rest / np.outer(d, d), rate * level, kind) * np.outer(d, d)


def structured(x: np.ndarray, factors: int = 10, model: str = "pca", rounds: int = 1000) -> np.ndarray:
    """Covariance of latent factors plus residual variances: principal components, or factor analysis fitted by expectation maximisation."""
    x = x - x.mean(0)
    t, p = x.shape
    s = x.T @ x / t
    values, vectors = np.linalg.eigh(s)
    top = vectors[:, p - factors :]
    if model == "pca":
        load, scores = top, x @ top
    elif model == "fa":
        load = top * np.sqrt(np.maximum(values[p - factors :], 0))
        own = np.maximum(np.diag(s - load @ load.T), 1e-12)
        before = -np.inf
        for _ in range(rounds):
            g = np.linalg.inv(np.eye(factors) + (load / own[:, None]).T @ load)
            w = g @ (load / own[:, None]).T  # scores of an observation
            second = g + w @ s @ w.T
            load = s @ w.T @ np.linalg.inv(second)
            own = np.maximum(np.diag(s - load @ w @ s), 1e-12)
            like = -np.linalg.slogdet(load @ load.T + np.diag(own))[1] - np.trace(np.linalg.solve(load @ load.T + np.diag(own), s))
            if like - before < 1e-9:
                break
            before = like
        g = np.linalg.inv(np.eye(factors) + (load / own[:, None]).T @ load)
        scores = x @ (g @ (load / own[:, None]).T).T
    else:
        raise ValueError(f"unknown model {model}")
    rest = x - scores @ load.T
    return load @ np.atleast_2d(np.cov(scores.T)) @ load.T + np.diag(rest.var(axis=0))


def to_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and sum to 1."""
    u = np.sort(w)[::-1]
    c = np.cumsum(u) - 1
    k = np.flatnonzero(u - c / np.arange(1, len(w) + 1) > 0)[-1]
    return np.maximum(w - c[k] / (k + 1), 0)


def to_box(w: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The nearest weights within [lo, hi] that sum to 1, by bisection on the common shift."""
    a, b = (w - hi).min() - 1, (w - lo).max() + 1
    for _ in range(100):
        c = (a + b) / 2
        a, b = (c, b) if np.clip(w - c, lo, hi).sum() > 1 else (a, c)
    return np.clip(w - (a + b) / 2, lo, hi)


def optimise(mean: np.ndarray, cov: np.ndarray, objective: str = "variance", steps: int = 3000, bounds: tuple[float, float] = (0.0, 1.0)) -> np.ndarray:
    """Weights of sum 1 within bounds: equal, least annual deviation (variance), or greatest annual mean less 20 deviations (sharpe).

    Projected gradient with a step that shrinks whenever the objective would grow. Bounds of
    (-1, 1) allow short positions.
    """
    n = len(mean)
    if objective == "equal":
        return np.full(n, 1 / n)
    if n * bounds[0] > 1 or n * bounds[1] < 1:
        raise ValueError("no weights of sum 1 lie within the bounds")
    nearest = to_simplex if bounds == (0.0, 1.0) else lambda v: to_box(v, *bounds)
    w, rate = np.full(n, 1 / n), 1.0

    def value(v: np.ndarray) -> float:
        risk = float(np.sqrt(max(252 * v @ cov @ v, 1e-18)))
        return risk if objective == "variance" else float(-252 * mean @ v + 20 * risk)

    best = value(w)
    for _ in range(steps):
        risk = np.sqrt(max(252 * w @ cov @ w, 1e-18))
        grad = 252 * cov @ w / risk
        if objective != "variance":
            grad = -252 * mean + 20 * grad
        trial = nearest(w - rate * grad)
        if (v := value(trial)) < best - 1e-14:
            w, best, rate = trial, v, rate * 1.2
        elif (rate := rate / 2) < 1e-12:
            break
    return w


def low_rank(x: np.ndarray, factors: int, threshold: float = 0.0, kind: str = "soft") -> np.ndarray:
    """Covariance of `factors` principal components plus the residual covariance.

    threshold 0 keeps only the residuals' variances (structured estimate); otherwise residual
    correlations below it become 0 (hard) or all shrink towards 0 by it (soft).
    """
    x = x - x.mean(0)
    t = len(x)
    s = x.T @ x / t
    values, vectors = np.linalg.eigh(s)
    top = vectors[:, -factors:] if factors else np.zeros((x.shape[1], 0))
    common = top * values[-factors:] @ top.T if factors else np.zeros_like(s)
    rest = s - common
    if not threshold:
        return common + np.diag(np.diag(rest))
    d = np.sqrt(np.maximum(np.diag(rest), 1e-18))
    corr = rest / np.outer(d, d)
    off = np.where(np.abs(corr) > threshold, corr, 0.0) if kind == "hard" else np.sign(corr) * np.maximum(np.abs(corr) - threshold, 0)
    np.fill_diagonal(off, 1.0)
    return common + off * np.outer(d, d)


def risk_attribution(weights: np.ndarray, exposures: np.ndarray, factor_cov: np.ndarray, specific: np.ndarray) -> dict[str, object]:
    """Variance of a portfolio under a factor model: total, factor and specific parts, and each factor's share."""
    e = exposures.T @ weights
    factor, own = float(e @ factor_cov @ e), float(weights**2 @ specific)
    total = factor + own
    return {"total": total, "factor": factor, "specific": own, "by_factor": (e * (factor_cov @ e)) / total if total else np.zeros(len(e))}


def stress(weights: np.ndarray, exposures: np.ndarray, shocks: dict[str, np.ndarray]) -> dict[str, float]:
    """Return of a portfolio under each scenario of factor shocks."""
    e = exposures.T @ weights
    return {k: float(e @ v) for k, v in shocks.items()}
