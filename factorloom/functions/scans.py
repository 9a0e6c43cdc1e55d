"""Recursive indicators along a ticker's rows: pandas/numpy functions for the scan template.

Each takes a ticker's rows in date order, the input columns, the name of the output and its
parameters, and returns the rows with the output added. Missing values are NaN here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def _smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing seeded with the mean of the first n values; NaN before; gaps carry the state."""
    out, state, seed = np.full(len(x), np.nan), None, []
    for i, v in enumerate(x):
        if np.isnan(v):
            continue
        if state is None:
            seed.append(v)
            if len(seed) == n:
                state = float(np.mean(seed))
        else:
            state += alpha * (v - state)
        if state is not None:
            out[i] = state
    return out


def ewma(pdf: pd.DataFrame, x: str, out: str, window: int, half_life: float | None = None) -> pd.DataFrame:
    """Exponentially weighted mean from the first value; half_life defaults to window // 4 (0: the value itself)."""
    hl = window // 4 if half_life is None else half_life
    return pdf.assign(**{out: pdf[x] if not hl else pdf[x].ewm(alpha=1 - 0.5 ** (1 / hl), adjust=False).mean()})


def ema(pdf: pd.DataFrame, x: str, out: str, window: int) -> pd.DataFrame:
    """Exponential mean of weight 2 / (n + 1), seeded with the simple mean."""
    return pdf.assign(**{out: _smooth(pdf[x].to_numpy(float), window, 2 / (window + 1))})


def smma(pdf: pd.DataFrame, x: str, out: str, window: int) -> pd.DataFrame:
    """Smoothed (Wilder) mean of weight 1 / n."""
    return pdf.assign(**{out: _smooth(pdf[x].to_numpy(float), window, 1 / window)})


def dema(pdf: pd.DataFrame, x: str, out: str, window: int) -> pd.DataFrame:
    """Double exponential mean: 2 ema - ema of ema."""
    a = 2 / (window + 1)
    e = _smooth(pdf[x].to_numpy(float), window, a)
    return pdf.assign(**{out: 2 * e - _smooth(e, window, a)})


def tema(pdf: pd.DataFrame, x: str, out: str, window: int) -> pd.DataFrame:
    """Triple exponential mean."""
    a = 2 / (window + 1)
    e1 = _smooth(pdf[x].to_numpy(float), window, a)
    e2 = _smooth(e1, window, a)
    return pdf.assign(**{out: 3 * e1 - 3 * e2 + _smooth(e2, window, a)})


def macd(pdf: pd.DataFrame, x: str, out: str, window: int = 12, slow: int = 26) -> pd.DataFrame:
    """Fast less slow exponential mean."""
    v = pdf[x].to_numpy(float)
    return pdf.assign(**{out: _smooth(v, window, 2 / (window + 1)) - _smooth(v, slow, 2 / (slow + 1))})


def rsi(pdf: pd.DataFrame, x: str, out: str, window: int = 14) -> pd.DataFrame:
    """Relative strength index with Wilder smoothing; 100 if nothing fell, NaN if nothing moved."""
    v = pdf[x].dropna()
    step = v.diff().to_numpy(float)
    up, down = _smooth(np.maximum(step, 0), window, 1 / window), _smooth(np.maximum(-step, 0), window, 1 / window)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(up + down > 0, 100 * up / (up + down), np.nan)
    return pdf.assign(**{out: pd.Series(r, v.index).reindex(pdf.index)})


def trix(pdf: pd.DataFrame, x: str, out: str, window: int = 15) -> pd.DataFrame:
    """Percent change of a triply smoothed mean."""
    a, e = 2 / (window + 1), pdf[x].to_numpy(float)
    for _ in range(3):
        e = _smooth(e, window, a)
    return pdf.assign(**{out: 100 * pd.Series(e, pdf.index).pct_change(fill_method=None)})


def kama(pdf: pd.DataFrame, x: str, out: str, window: int = 10, fast: int = 2, slow: int = 30) -> pd.DataFrame:
    """Adaptive mean: the efficiency of the last n steps sets the weight."""
    v = pdf[x].dropna()
    move = v.diff(window).abs() / v.diff().abs().rolling(window).sum().replace(0, np.nan)
    weight = (move.fillna(0) * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
    res, state = np.full(len(v), np.nan), np.nan
    for i, (p, w) in enumerate(zip(v.to_numpy(), weight.to_numpy(), strict=True)):
        if i == window - 1:
            state = v.iloc[: i + 1].mean()
        elif i >= window:
            state += w * (p - state)
        res[i] = state
    return pdf.assign(**{out: pd.Series(res, v.index).reindex(pdf.index)})


def laguerre(pdf: pd.DataFrame, x: str, out: str, window: int = 0, gamma: float = 0.5) -> pd.DataFrame:
    """Laguerre filter of four stages."""
    res, stages = np.full(len(pdf), np.nan), None
    for i, p in enumerate(pdf[x].to_numpy(float)):
        if np.isnan(p):
            continue
        if stages is None:
            stages = [p] * 4
        else:
            new = [(1 - gamma) * p + gamma * stages[0]]
            for j in range(1, 4):
                new.append(-gamma * new[j - 1] + stages[j - 1] + gamma * stages[j])
            stages = new
        res[i] = (stages[0] + 2 * stages[1] + 2 * stages[2] + stages[3]) / 6
    return pdf.assign(**{out: res})


def trend_label(pdf: pd.DataFrame, x: str, out: str, window: int = 0, up: float = 0.05, down: float = 0.05) -> pd.DataFrame:
    """Extrema labelled along a zig-zag: 1 at a confirmed high, -1 at a confirmed low, else 0."""
    v = pdf[x].to_numpy(float)
    res = np.zeros(len(v))
    side, at = 0, None
    for i, p in enumerate(v):
        if np.isnan(p):
            res[i] = np.nan
            continue
        if at is None:
            at = lo = hi = i
            continue
        if side >= 0 and p >= v[hi]:
            hi = i
        if side <= 0 and p <= v[lo]:
            lo = i
        if side >= 0 and p <= v[hi] * (1 - down):
            res[hi], side, lo = 1, -1, i
        elif side <= 0 and p >= v[lo] * (1 + up):
            res[lo], side, hi = -1, 1, i
    return pdf.assign(**{out: res})


def stop_exit(pdf: pd.DataFrame, x: str, out: str, window: int = 0, stop: float = 0.1, trailing: bool = True) -> pd.DataFrame:
    """1 where a position opened on the first value (again after each exit) hits its stop, trailing the high or fixed."""
    res, ref = np.zeros(len(pdf)), None
    for i, p in enumerate(pdf[x].to_numpy(float)):
        if np.isnan(p):
            continue
        if ref is None:
            ref = p
        elif p <= ref * (1 - stop):
            res[i], ref = 1, None
        elif trailing:
            ref = max(ref, p)
    return pdf.assign(**{out: res})


SCANS = {f.__name__: f for f in (ewma, ema, smma, dema, tema, macd, rsi, trix, kama, laguerre, trend_label, stop_exit)}


def adx(pdf: pd.DataFrame, high: str, low: str, close: str, out: str, window: int = 14) -> pd.DataFrame:
    """Average directional index with Wilder smoothing; rows with a missing price carry the state."""
    t = pdf[[high, low, close]].dropna()
    up, down = t[high].diff(), -t[low].diff()
    before = t[close].shift()
    tr = pd.concat([t[high] - t[low], (t[high] - before).abs(), (t[low] - before).abs()], axis=1).max(axis=1).where(before.notna())
    plus, minus = up.where((up > down) & (up > 0), 0.0).where(before.notna()), down.where((down > up) & (down > 0), 0.0).where(before.notna())
    a = 1 / window
    s, p, m = (_smooth(v.to_numpy(float), window, a) for v in (tr, plus, minus))
    with np.errstate(invalid="ignore", divide="ignore"):
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.where(np.isnan(s), np.nan, 0.0))
    return pdf.assign(**{out: pd.Series(_smooth(dx, window, a), t.index).reindex(pdf.index)})


def parabolic_sar(pdf: pd.DataFrame, high: str, low: str, out: str, window: int = 0, step: float = 0.02, most: float = 0.2) -> pd.DataFrame:
    """Stop-and-reverse level: follows the trend's extreme ever faster, never into the last two rows' range."""
    h, lo = pdf[high].to_numpy(float), pdf[low].to_numpy(float)
    res = np.full(len(pdf), np.nan)
    rising, sar, best, rate, past = True, None, None, step, []
    for i in range(len(pdf)):
        if np.isnan(h[i]) or np.isnan(lo[i]):
            continue
        if sar is None:
            sar, best = lo[i], h[i]
        else:
            sar += rate * (best - sar)
            sar = min([sar, *(x[1] for x in past[-2:])]) if rising else max([sar, *(x[0] for x in past[-2:])])
            if (lo[i] < sar) if rising else (h[i] > sar):
                rising, sar, best, rate = not rising, best, (lo[i] if rising else h[i]), step
            elif (h[i] > best) if rising else (lo[i] < best):
                best, rate = (h[i] if rising else lo[i]), min(rate + step, most)
        past.append((h[i], lo[i]))
        res[i] = sar
    return pdf.assign(**{out: res})


def heikin_open(pdf: pd.DataFrame, open_: str, high: str, low: str, close: str, out: str, window: int = 0) -> pd.DataFrame:
    """Open of the averaged bar: the middle of the averaged bar before; the first is the middle of its own."""
    res, before = np.full(len(pdf), np.nan), None
    for i, (o, h, lo, c) in enumerate(pdf[[open_, high, low, close]].to_numpy(float)):
        if np.isnan(o + h + lo + c):
            continue
        res[i] = (o + c) / 2 if before is None else (before[0] + before[1]) / 2
        before = res[i], (o + h + lo + c) / 4
    return pdf.assign(**{out: res})


def supertrend(pdf: pd.DataFrame, high: str, low: str, close: str, out: str, window: int = 10, width: float = 3.0) -> pd.DataFrame:
    """Trailing band of width * average true range that flips when the close crosses it."""
    t = pdf[[high, low, close]].dropna()
    before = t[close].shift()
    tr = pd.concat([t[high] - t[low], (t[high] - before).abs(), (t[low] - before).abs()], axis=1).max(axis=1)
    atr, mid, c = _smooth(tr.to_numpy(float), window, 1 / window), ((t[high] + t[low]) / 2).to_numpy(float), t[close].to_numpy(float)
    res, upper, lower, rising = np.full(len(t), np.nan), np.inf, -np.inf, True
    for i in range(len(t)):
        if np.isnan(atr[i]):
            continue
        u, d = mid[i] + width * atr[i], mid[i] - width * atr[i]
        upper = u if u < upper or i and c[i - 1] > upper else upper
        lower = d if d > lower or i and c[i - 1] < lower else lower
        rising = c[i] >= lower if rising else c[i] > upper
        res[i] = lower if rising else upper
    return pdf.assign(**{out: pd.Series(res, t.index).reindex(pdf.index)})


def renko_level(pdf: pd.DataFrame, x: str, out: str, window: int = 0, brick: float = 1.0) -> pd.DataFrame:
    """Level of the last finished brick of a fixed size."""
    res, level = np.full(len(pdf), np.nan), None
    for i, v in enumerate(pdf[x].to_numpy(float)):
        if np.isnan(v):
            continue
        level = v if level is None else level + brick * np.trunc((v - level) / brick)
        res[i] = level
    return pdf.assign(**{out: res})


def triple_barrier(pdf: pd.DataFrame, x: str, out: str, window: int = 10, up: float = 0.05, down: float = 0.05) -> pd.DataFrame:
    """1 if the value first rises by `up` within the next rows, -1 if it first falls by `down`, else 0; NaN near the end."""
    v = pdf[x].to_numpy(float)
    res = np.full(len(v), np.nan)
    for i in range(len(v) - window):
        if np.isnan(v[i]):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead = v[i + 1 : i + window + 1] / v[i] - 1
        hits = np.flatnonzero((ahead >= up) | (ahead <= -down))
        res[i] = 0 if not len(hits) else 1 if ahead[hits[0]] >= up else -1
    return pdf.assign(**{out: res})


def zero_lag_ema(pdf: pd.DataFrame, x: str, out: str, window: int = 12) -> pd.DataFrame:
    """Exponential mean of the value plus its change over half the window."""
    v = pdf[x] + (pdf[x] - pdf[x].shift((window - 1) // 2))
    return pdf.assign(**{out: _smooth(v.to_numpy(float), window, 2 / (window + 1))})


def tsi(pdf: pd.DataFrame, x: str, out: str, window: int = 25, fast: int = 13) -> pd.DataFrame:
    """True strength index: doubly smoothed change over doubly smoothed absolute change."""
    d = pdf[x].dropna().diff()
    twice = lambda s: _smooth(_smooth(s.to_numpy(float), window, 2 / (window + 1)), fast, 2 / (fast + 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = 100 * twice(d) / twice(d.abs())
    return pdf.assign(**{out: pd.Series(r, d.index).reindex(pdf.index)})


def zero_lag_indicator(pdf: pd.DataFrame, x: str, out: str, window: int = 12, most: int = 50) -> pd.DataFrame:
    """Error-correcting exponential mean: of the gains -most/10 to most/10 the one of least error, the first of equals."""
    v = pdf[x].to_numpy(float)
    mean, alpha = _smooth(v, window, 2 / (window + 1)), 2 / (window + 1)
    gains = np.arange(-most, most + 1) / 10
    res, state = np.full(len(v), np.nan), None
    for i, (p, e) in enumerate(zip(v, mean, strict=True)):
        if np.isnan(p) or np.isnan(e):
            continue
        if state is None:
            state = e
        else:
            tried = alpha * (e + gains * (p - state)) + (1 - alpha) * state
            state = tried[np.argmin(np.abs(p - tried))]
        res[i] = state
    return pdf.assign(**{out: res})


def hurst(pdf: pd.DataFrame, x: str, out: str, window: int = 40, first: int = 10) -> pd.DataFrame:
    """Exponent by which the deviation of differences grows with their lag (first to half the window), over full windows of known values."""
    v = pdf[x].to_numpy(float)
    res = np.full(len(v), np.nan)
    lags = np.arange(first, window // 2)
    if len(v) >= window and len(lags) > 1:
        w = np.lib.stride_tricks.sliding_window_view(v, window)
        with np.errstate(divide="ignore", invalid="ignore"):
            tau = np.log10(np.sqrt(np.array([(w[:, k:] - w[:, :-k]).std(axis=1) for k in lags])))
        at = np.log10(lags) - np.log10(lags).mean()
        res[window - 1 :] = 2 * (at @ tau) / (at @ at)
    return pdf.assign(**{out: np.where(np.isfinite(res), res, np.nan)})


def ewm_std(pdf: pd.DataFrame, x: str, out: str, window: int, adjust: bool = False) -> pd.DataFrame:
    """Exponentially weighted deviation of span `window`, corrected for bias."""
    return pdf.assign(**{out: pdf[x].ewm(span=window, adjust=adjust).std()})


def ewm_mean(pdf: pd.DataFrame, x: str, out: str, window: int, adjust: bool = False) -> pd.DataFrame:
    """Exponentially weighted mean of span `window` from the first value on."""
    return pdf.assign(**{out: pdf[x].ewm(span=window, adjust=adjust).mean()})


def rsi_from_steps(pdf: pd.DataFrame, x: str, out: str, window: int = 14) -> pd.DataFrame:
    """Relative strength index whose averages begin with the first window - 1 steps, a bar earlier than rsi's."""
    step = pdf[x].dropna().diff().iloc[1:]
    ups, downs = (_smooth(v.to_numpy(float), window - 1, 1 / window) for v in (step.clip(lower=0), -step.clip(upper=0)))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(ups + downs > 0, 100 * ups / (ups + downs), np.nan)
    # the bar that completes the first average has no value yet
    r[: window - 1] = np.nan
    return pdf.assign(**{out: pd.Series(r, step.index).reindex(pdf.index)})


def trend_position(pdf: pd.DataFrame, x: str, out: str, window: int = 0, up: float = 0.05, down: float = 0.05, mode: str = "binary") -> pd.DataFrame:
    """Where a row stands between its zig-zag's extrema: binary (1 while rising to a high), scaled (0 at the low to 1 at the high) or change (share to the next extreme)."""
    marks = trend_label(pdf, x, "_m", 0, up, down)["_m"].to_numpy(float)
    v = pdf[x].to_numpy(float)
    res = np.full(len(v), np.nan)
    ends = [i for i, m in enumerate(marks) if m in (1, -1)]
    for a, b in zip(ends, ends[1:], strict=False):
        lo, hi = min(v[a], v[b]), max(v[a], v[b])
        for i in range(a, b):
            if np.isnan(v[i]):
                continue
            res[i] = float(marks[b] == 1) if mode == "binary" else (v[i] - lo) / (hi - lo) if mode == "scaled" else v[b] / v[i] - 1
    return pdf.assign(**{out: res})


SCANS |= {f.__name__: f for f in (zero_lag_indicator, hurst, ewm_mean, ewm_std, rsi_from_steps, trend_position, adx, parabolic_sar, heikin_open, supertrend, renko_level, triple_barrier, zero_lag_ema, tsi)}
#: Scans that see later rows only.
AHEAD_SCANS = ("triple_barrier",)
#: How many columns a scan reads, where it is more than one.
SCAN_COLUMNS = {"adx": ("high", "low", "close"), "parabolic_sar": ("high", "low"), "heikin_open": ("open_", "high", "low", "close"), "supertrend": ("high", "low", "close")}
