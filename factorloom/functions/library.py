"""Indicators that are compositions: name -> (parameters with defaults, formula of the parameters).

Capital names are parameters: those without a default take panel values, the others constants.
"""

from __future__ import annotations

TR = "true_range(H, L, C)"
R = "pct_change(X, 1)"
#: Mean true range of logarithms over A rows.
LTR_MEAN = "ts_mean(log_true_range(H, L, C), A)"

LIBRARY: dict[str, tuple[tuple[tuple[str, float | None], ...], str]] = {
    "momentum": ((("X", None), ("N", 10)), "X - delay(X, N)"),
    "hma": ((("X", None), ("N", 9)), "wma(2 * wma(X, floor(N / 2)) - wma(X, N), floor(sqrt(N)))"),
    "dpo": ((("X", None), ("N", 20)), "X - delay(ts_mean(X, N), N / 2 + 1)"),
    "envelope_upper": ((("X", None), ("N", 20), ("P", 3)), "ts_mean(X, N) * (1 + P / 100)"),
    "envelope_lower": ((("X", None), ("N", 20), ("P", 3)), "ts_mean(X, N) * (1 - P / 100)"),
    "bollinger_width": ((("X", None), ("N", 20)), "4 * ts_stddev_pop(X, N) / ts_mean(X, N)"),
    "keltner_upper": ((("H", None), ("L", None), ("C", None), ("N", 20), ("K", 2)), f"ts_mean((H + L + C) / 3, N) + K * ts_mean({TR}, N)"),
    "keltner_lower": ((("H", None), ("L", None), ("C", None), ("N", 20), ("K", 2)), f"ts_mean((H + L + C) / 3, N) - K * ts_mean({TR}, N)"),
    "donchian_mid": ((("H", None), ("L", None), ("N", 20)), "(ts_max(H, N) + ts_min(L, N)) / 2"),
    "ichimoku_tenkan": ((("H", None), ("L", None), ("N", 9)), "(ts_max(H, N) + ts_min(L, N)) / 2"),
    "ichimoku_kijun": ((("H", None), ("L", None), ("N", 26)), "(ts_max(H, N) + ts_min(L, N)) / 2"),
    "ichimoku_senkou_a": ((("H", None), ("L", None), ("N", 9), ("M", 26)), "delay(((ts_max(H, N) + ts_min(L, N)) / 2 + (ts_max(H, M) + ts_min(L, M)) / 2) / 2, M)"),
    "ichimoku_senkou_b": ((("H", None), ("L", None), ("N", 52), ("M", 26)), "delay((ts_max(H, N) + ts_min(L, N)) / 2, M)"),
    "ultimate_oscillator": (
        (("H", None), ("L", None), ("C", None), ("A", 7), ("B", 14), ("D", 28)),
        "100 * (4 * ts_sum(C - min(L, delay(C, 1)), A) / ts_sum(" + TR + ", A) + 2 * ts_sum(C - min(L, delay(C, 1)), B) / ts_sum(" + TR + ", B) + ts_sum(C - min(L, delay(C, 1)), D) / ts_sum(" + TR + ", D)) / 7",
    ),
    "vortex_plus": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"ts_sum(abs(H - delay(L, 1)), N) / ts_sum({TR}, N)"),
    "vortex_minus": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"ts_sum(abs(L - delay(H, 1)), N) / ts_sum({TR}, N)"),
    "plus_di": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"100 * ts_sum(H - delay(H, 1) > delay(L, 1) - L ? max(H - delay(H, 1), 0) : 0, N) / ts_sum({TR}, N)"),
    "minus_di": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"100 * ts_sum(delay(L, 1) - L > H - delay(H, 1) ? max(delay(L, 1) - L, 0) : 0, N) / ts_sum({TR}, N)"),
    "chaikin_money_flow": ((("H", None), ("L", None), ("C", None), ("V", None), ("N", 20)), "ts_sum(((C - L) - (H - C)) / (H - L) * V, N) / ts_sum(V, N)"),
    "accumulation_distribution": ((("H", None), ("L", None), ("C", None), ("V", None)), "cumulative(((C - L) - (H - C)) / (H - L) * V / 1000000)"),
    "force_index": ((("C", None), ("V", None), ("N", 13)), "ts_mean(delta(C, 1) * V / 1000000, N)"),
    "ease_of_movement": ((("H", None), ("L", None), ("V", None), ("N", 14)), "ts_mean(delta((H + L) / 2, 1) * (H - L) / (V / 1000000), N)"),
    "money_flow_index": ((("H", None), ("L", None), ("C", None), ("V", None), ("N", 14)), "100 * ts_sum(delta((H + L + C) / 3, 1) > 0 ? (H + L + C) / 3 * V : 0, N) / (ts_sum(delta((H + L + C) / 3, 1) > 0 ? (H + L + C) / 3 * V : 0, N) + ts_sum(delta((H + L + C) / 3, 1) < 0 ? (H + L + C) / 3 * V : 0, N))"),
    "kst": ((("X", None),), "ts_mean(roc(X, 10), 10) + 2 * ts_mean(roc(X, 15), 10) + 3 * ts_mean(roc(X, 20), 10) + 4 * ts_mean(roc(X, 30), 15)"),
    "awesome_oscillator": ((("H", None), ("L", None), ("N", 5), ("M", 34)), "ts_mean((H + L) / 2, N) - ts_mean((H + L) / 2, M)"),
    "acceleration": ((("H", None), ("L", None), ("N", 5), ("M", 34)), "ts_mean((H + L) / 2, N) - ts_mean((H + L) / 2, M) - ts_mean(ts_mean((H + L) / 2, N) - ts_mean((H + L) / 2, M), N)"),
    "pretty_good_oscillator": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"(C - ts_mean(C, N)) / ts_mean({TR}, N)"),
    "chande_momentum": ((("X", None), ("N", 14)), "100 * (ts_sum(max(delta(X, 1), 0), N) - ts_sum(max(0 - delta(X, 1), 0), N)) / (ts_sum(max(delta(X, 1), 0), N) + ts_sum(max(0 - delta(X, 1), 0), N))"),
    "rsi_simple": ((("X", None), ("N", 14)), "100 * ts_sum(max(delta(X, 1), 0), N) / (ts_sum(max(delta(X, 1), 0), N) + ts_sum(max(0 - delta(X, 1), 0), N))"),
    "efficiency_ratio": ((("X", None), ("N", 10)), "abs(X - delay(X, N)) / ts_sum(abs(delta(X, 1)), N)"),
    "vertical_horizontal_filter": ((("X", None), ("N", 28)), "(ts_max(X, N) - ts_min(X, N)) / ts_sum(abs(delta(X, 1)), N)"),
    "choppiness": ((("H", None), ("L", None), ("C", None), ("N", 14)), f"100 * log(ts_sum({TR}, N) / (ts_max(H, N) - ts_min(L, N))) / log(N)"),
    "ulcer_index": ((("X", None), ("N", 14)), "sqrt(ts_mean(power(100 * (X / ts_max(X, N) - 1), 2), N))"),
    "historical_volatility": ((("X", None), ("N", 20)), "ts_stddev(log(X / delay(X, 1)), N) * sqrt(252)"),
    "parkinson_volatility": ((("H", None), ("L", None), ("N", 20)), "sqrt(ts_mean(power(log(H / L), 2), N) / (4 * log(2)))"),
    "garman_klass_volatility": ((("O", None), ("H", None), ("L", None), ("C", None), ("N", 20)), "sqrt(ts_mean(0.5 * power(log(H / L), 2) - (2 * log(2) - 1) * power(log(C / O), 2), N))"),
    "rogers_satchell_volatility": ((("O", None), ("H", None), ("L", None), ("C", None), ("N", 20)), "sqrt(ts_mean(log(H / C) * log(H / O) + log(L / C) * log(L / O), N))"),
    "pivot_point": ((("H", None), ("L", None), ("C", None)), "(delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3"),
    "pivot_r1": ((("H", None), ("L", None), ("C", None)), "2 * (delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 - delay(L, 1)"),
    "pivot_s1": ((("H", None), ("L", None), ("C", None)), "2 * (delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 - delay(H, 1)"),
    "fibonacci_r1": ((("H", None), ("L", None), ("C", None)), "(delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 + 0.382 * (delay(H, 1) - delay(L, 1))"),
    "up_days": ((("X", None), ("N", 10)), "ts_sum(delta(X, 1) > 0 ? 1 : 0, N)"),
    "down_days": ((("X", None), ("N", 10)), "ts_sum(delta(X, 1) < 0 ? 1 : 0, N)"),
    "rolling_total_return": ((("X", None), ("N", 20)), "X / delay(X, N) - 1"),
    "rolling_annualized": ((("X", None), ("N", 20)), f"power(ts_prod(1 + {R}, N), 252 / N) - 1"),
    "rolling_sharpe": ((("X", None), ("N", 20)), f"ts_mean({R}, N) / ts_stddev({R}, N) * sqrt(252)"),
    "rolling_sortino": ((("X", None), ("N", 20)), f"ts_mean({R}, N) / sqrt(ts_mean(power(min({R}, 0), 2), N)) * sqrt(252)"),
    "rolling_omega": ((("X", None), ("N", 20)), f"ts_sum(max({R}, 0), N) / ts_sum(max(0 - {R}, 0), N)"),
    "rolling_max_drawdown": ((("X", None), ("N", 20)), "ts_max_drawdown(X, N)"),
    "rolling_downside_risk": ((("X", None), ("N", 20)), f"sqrt(ts_mean(power(min({R}, 0), 2), N)) * sqrt(252)"),
    "overnight_gap": ((("O", None), ("C", None)), "O / delay(C, 1) - 1"),
    "intraday_return": ((("O", None), ("C", None)), "C / O - 1"),
    "amihud_illiquidity": ((("C", None), ("A", None), ("N", 20)), "ts_mean(abs(pct_change(C, 1)) / (A / 1000000), N)"),
    "volume_ratio_rolling": ((("V", None), ("N", 20)), "V / ts_mean(V, N)"),
    "distance_to_high": ((("C", None), ("H", None), ("N", 60)), "C / ts_max(H, N) - 1"),
    "distance_to_low": ((("C", None), ("L", None), ("N", 60)), "C / ts_min(L, N) - 1"),
    "intraday_intensity": ((("H", None), ("L", None), ("C", None), ("V", None), ("N", 14)), "ts_sum((2 * C - H - L) / (H - L) * V, N) / ts_sum(V, N)"),
    "close_to_close_trend": ((("X", None), ("N", 20)), "(X - ts_mean(X, N)) / ts_stddev(X, N)"),
    "autocorrelation": ((("X", None), ("N", 20)), f"ts_corr({R}, delay({R}, 1), N)"),
    "volume_price_correlation": ((("C", None), ("V", None), ("N", 10)), "0 - ts_corr(C, V, N)"),
    "heikin_close": ((("O", None), ("H", None), ("L", None), ("C", None)), "(O + H + L + C) / 4"),
    "trend_strength_rank": ((("X", None), ("N", 10)), "cs_rank(X / delay(X, N) - 1)"),
    # bar-vector indicators: scores squashed by the normal distribution to -50..50
    "normal_score": ((("X", None), ("S", 1)), "100 * normal_cdf(S * X) - 50"),
    "close_minus_ma": ((("H", None), ("L", None), ("C", None), ("N", 20), ("A", 20), ("S", 1)), f"normal_score((log(C) - delay(ts_mean(log(C), N), 1)) / ({LTR_MEAN} * sqrt(N + 1)), S)"),
    # the short sum takes two steps more than it is divided by, and the long one counts those twice, as in the studied definition
    "price_change_oscillator": ((("H", None), ("L", None), ("C", None), ("N", 5), ("M", 4), ("S", 4)), "normal_score((ts_sum(abs(log(C / delay(C, 1))), N + 2) / N - (ts_sum(abs(log(C / delay(C, 1))), N + 2) + delay(ts_sum(abs(log(C / delay(C, 1))), N * M - N), N)) / (N * M)) / ((0.36 + 1 / N + 0.7 * log(0.5 * M) / 1.609) * ts_mean(log_true_range(H, L, C), N * M)), S)"),
    "volume_weighted_ma_ratio": ((("C", None), ("V", None), ("N", 20), ("S", 1)), "normal_score(1000 * log(N * ts_sum(C * V, N) / (ts_sum(V, N) * ts_sum(C, N))) / sqrt(N), S)"),
    "normalized_on_balance_volume": ((("C", None), ("V", None), ("N", 20), ("S", 0.6)), "normal_score(ts_sum(sign(delta(C, 1)) * V, N) / ts_sum(V, N) * sqrt(N), S)"),
    "delta_on_balance_volume": ((("C", None), ("V", None), ("N", 20), ("D", 1), ("S", 0.6)), "delta(normalized_on_balance_volume(C, V, N, S), D)"),
    "normalized_positive_volume_index": ((("C", None), ("V", None), ("N", 20), ("W", 250), ("S", 0.5)), "normal_score(ts_sum(V > delay(V, 1) ? log(C / delay(C, 1)) : 0, N) / (ts_stddev_pop(log(C / delay(C, 1)), W) * sqrt(N)), S)"),
    "normalized_negative_volume_index": ((("C", None), ("V", None), ("N", 20), ("W", 250), ("S", 0.5)), "normal_score(ts_sum(V < delay(V, 1) ? log(C / delay(C, 1)) : 0, N) / (ts_stddev_pop(log(C / delay(C, 1)), W) * sqrt(N)), S)"),
    "volume_momentum": ((("V", None), ("N", 10), ("M", 2), ("S", 3)), "normal_score(log(ts_mean(V, N) / ts_mean(V, N * M)) / power(M, 0.3333333333333333), S)"),
    "money_flow": ((("H", None), ("L", None), ("C", None), ("V", None), ("N", 20)), "100 * ts_sum(H > L ? (2 * C - H - L) / (H - L) * V : 0, N) / ts_sum(V, N)"),
    "price_volume_fit": ((("C", None), ("V", None), ("N", 20), ("S", 9)), "normal_score(ts_linreg(log(C), log(V + 1), N, 'beta'), S)"),
    "linear_deviation": ((("X", None), ("N", 20), ("S", 0.6)), "normal_score(ts_poly_deviation(X, N, 1), S)"),
    "quadratic_deviation": ((("X", None), ("N", 20), ("S", 0.6)), "normal_score(ts_poly_deviation(X, N, 2), S)"),
    "cubic_deviation": ((("X", None), ("N", 20), ("S", 0.6)), "normal_score(ts_poly_deviation(X, N, 3), S)"),
    "linear_trend": ((("X", None), ("H", None), ("L", None), ("C", None), ("N", 20), ("A", 20), ("S", 1)), f"normal_score(ts_poly_trend(X, N, 1) / ({LTR_MEAN} * (N - 1)), S)"),
    "quadratic_trend": ((("X", None), ("H", None), ("L", None), ("C", None), ("N", 20), ("A", 20), ("S", 1)), f"normal_score(ts_poly_trend(X, N, 2) / ({LTR_MEAN} * (N - 1)), S)"),
    "cubic_trend": ((("X", None), ("H", None), ("L", None), ("C", None), ("N", 20), ("A", 20), ("S", 1)), f"normal_score(ts_poly_trend(X, N, 3) / ({LTR_MEAN} * (N - 1)), S)"),
    "aroon_diff": ((("H", None), ("L", None), ("N", 25)), "aroon_up(H, N) - aroon_down(L, N)"),
    "percent_rank": ((("X", None), ("N", 50)), "ts_share_below(X, N)"),
    "dv2": ((("H", None), ("L", None), ("C", None), ("N", 252), ("M", 2)), "100 * ts_share_below(ts_mean(C / ((H + L) / 2) - 1, M), N)"),
    "rmi": ((("X", None), ("N", 20), ("M", 5)), "100 * smma(max(delta(X, M), 0), N) / (smma(max(delta(X, M), 0), N) + smma(max(0 - delta(X, M), 0), N))"),
    "fractal_high": ((("H", None),), "only_if(delay(H, 2) == ts_max(H, 5), delay(H, 2))"),
    "fractal_low": ((("L", None),), "only_if(delay(L, 2) == ts_min(L, 5), delay(L, 2))"),
    "heikin_delta": ((("O", None), ("H", None), ("L", None), ("C", None)), "(O + H + L + C) / 4 - heikin_open(O, H, L, C)"),
    "dickson_mean": ((("X", None), ("N", 14), ("Q", 9)), "(zero_lag_indicator(X, N) + hma(X, Q)) / 2"),
    "oscillator": ((("X", None), ("N", 30)), "X - ts_mean(X, N)"),
    "ulcer_performance": ((("X", None), ("N", 14)), f"ts_mean({R}, N) / (ulcer_index(X, N) / 100)"),
    "macd_signal": ((("X", None), ("N", 12), ("M", 26), ("Q", 9)), "ema(macd(X, N, M), Q)"),
    "macd_histogram": ((("X", None), ("N", 12), ("M", 26), ("Q", 9)), "macd(X, N, M) - ema(macd(X, N, M), Q)"),
    "price_oscillator": ((("X", None), ("N", 12), ("M", 26)), "ema(X, N) - ema(X, M)"),
    "percentage_price_oscillator": ((("X", None), ("N", 12), ("M", 26)), "100 * (ema(X, N) - ema(X, M)) / ema(X, M)"),
    "trix_signal": ((("X", None), ("N", 15), ("Q", 9)), "ema(trix(X, N), Q)"),
    "stochastic_rsi": ((("X", None), ("N", 14), ("M", 14)), "100 * (rsi(X, N) - ts_min(rsi(X, N), M)) / (ts_max(rsi(X, N), M) - ts_min(rsi(X, N), M))"),
    "sortino_population": ((("X", None), ("N", 20)), f"ts_mean({R}, N) / ts_stddev_pop({R}, N) * sqrt(N)"),
    "demark_pivot": ((("O", None), ("H", None), ("L", None), ("C", None)), "(delay(C, 1) < delay(O, 1) ? delay(H, 1) + 2 * delay(L, 1) + delay(C, 1) : delay(C, 1) > delay(O, 1) ? 2 * delay(H, 1) + delay(L, 1) + delay(C, 1) : delay(H, 1) + delay(L, 1) + 2 * delay(C, 1)) / 4"),
    "fibonacci_s1": ((("H", None), ("L", None), ("C", None)), "(delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 - 0.382 * (delay(H, 1) - delay(L, 1))"),
    "pivot_r2": ((("H", None), ("L", None), ("C", None)), "(delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 + delay(H, 1) - delay(L, 1)"),
    "pivot_s2": ((("H", None), ("L", None), ("C", None)), "(delay(H, 1) + delay(L, 1) + delay(C, 1)) / 3 - (delay(H, 1) - delay(L, 1))"),
    "information_ratio_rolling": ((("X", None), ("Y", None), ("N", 20)), "ts_mean(pct_change(X, 1) - pct_change(Y, 1), N) / ts_stddev(pct_change(X, 1) - pct_change(Y, 1), N)"),
    "rolling_beta": ((("X", None), ("Y", None), ("N", 20)), "ts_cov(pct_change(X, 1), pct_change(Y, 1), N) / ts_cov(pct_change(Y, 1), pct_change(Y, 1), N)"),
    "rolling_calmar": ((("X", None), ("N", 20)), "(power(ts_prod(1 + pct_change(X, 1), N), 252 / N) - 1) / abs(ts_max_drawdown(X, N))"),
    "rolling_tail_ratio": ((("X", None), ("N", 40)), "abs(ts_quantile(pct_change(X, 1), N, 0.95)) / abs(ts_quantile(pct_change(X, 1), N, 0.05))"),
    "rolling_value_at_risk": ((("X", None), ("N", 40)), "ts_quantile(pct_change(X, 1), N, 0.05)"),
    "price_intensity": ((("O", None), ("H", None), ("L", None), ("C", None), ("S", 0.8)), "normal_score((C - O) / true_range(H, L, C), S)"),
    "macd_score": ((("H", None), ("L", None), ("C", None), ("N", 12), ("M", 26), ("S", 1)), "normal_score((ewm_mean(C, N) - ewm_mean(C, M)) / (sqrt(0.5 * (M - N)) * ts_mean(true_range(H, L, C), M)), S)"),
    "detrended_rsi": ((("X", None), ("A", 5), ("B", 20), ("N", 30)), "ts_linreg(rsi_from_steps(X, A), rsi_from_steps(X, B), N, 'resid')"),
}
