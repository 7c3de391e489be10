"""Mined price, volume and flow formulas, in plain text.

Fixed values. Besides prices they read columns of a vendor's panel: ``turn_rate``, ``amount``,
``change_pct``, ``rocttm``, ``net_flow``, ``vroc12``, ``reinstatement``, ``main_flow``, ``main_flow20``,
``large_flow``, ``vol60``, ``tvsd20``, ``beta`` and ``size``. Deviations are of the population.
"""

from __future__ import annotations

from quantloom.functions.dsl import call, col, parse
from quantloom.functions.expr import Expr

FORMULAS: dict[str, str] = {
    "intraday_strength": "(close - open) / open",
    "price_volume_var40": "rolling_var(close / ts_wma(volume, 5), 40)",
    "volume_ema40": "ts_ema(volume, 40)",
    "close_low_var10": "rolling_var(close * low, 10)",
    "vwap_corr_inverse_high_lag10": "delay(ts_corr(vwap, 1 / high, 30), 10)",
    "vwap_over_low_min10": "2 * vwap / ts_min(low, 10)",
    "volume_sum5": "ts_sum(volume, 5)",
    "volume": "volume * 1",
    "log1p_inverse_turnover_pressure": "log(1 + 10 / (volume * (high + 2)))",
    "close_over_high": "close / high",
    "open_high_cov5_wma5": "ts_wma(ts_cov(open, high, 5), 5)",
    "vwap_minus_high": "vwap - high",
    "nested_cov_open": "ts_cov(open, ts_cov(vwap, low, 30), 5)",
    "low_pctchange_momentum": "ts_change(ts_min(ts_wma(low, 10), 50), 20)",
    "volume_high_corr_strength": "ts_corr(volume, high, 20) * ts_sum(volume, 30)",
    "volume_flow_sine_skew": "-1 * (sin(ts_mean(close / delay(close, 1) - 1, 5)) * cs_skew(vwap) * ts_median(ts_sum(bool(close > open), 10), 20) + log(1 + ts_max(rolling_std(high - low, 3), 60)) * (ts_max(ts_mean(volume, 5), 20) / ts_mean(volume, 20)))",
    "change_pct_decaymax_volume_standardized": "-1 * cs_standardize(ts_max(decay_linear(close / delay(close, 1) - 1, 20) * log(1 + volume), 3))",
    "round_ema_ma_vol_sharpe_spread": "round(ts_ema(close, 10) / ts_mean(close, 5), 1) * (rolling_std(close / delay(close, 1) - 1, 120) - rolling_std(close / delay(close, 1) - 1, 20)) + (rolling_sharpe(close / delay(close, 1) - 1, 120) - rolling_sharpe(close / delay(close, 1) - 1, 20))",
    "rank_normalize_log_regression_residual": "-1 * cs_standardize(rank(log(1 + clip_lower(cs_regression_residual(close, 1 / turn_rate), -0.999999999))))",
    "ts_rank_close_maxsum_percentage_avdiff": "-1 * ts_rank_pct(close, 20) * ((ts_max(ts_sum(high, 5), 20) - ts_median(close, 20)) + ts_av_diff(close, 20))",
    "rank_normalize_log_returns_rocttm": "rank(cs_standardize(log(clip_lower(ts_returns(close, 15) + rocttm, 0.000000000001))))",
    "rank_corr_rank_mean_close_volume_turnrate": "-1 * rank(ts_corr(rank(ts_mean(close, 15)), rank(ts_mean(volume, 15)), 10)) * rank(ts_mean(change_pct, 15)) * rank(ts_mean(turn_rate, 15)) * rank(ts_mean(volume, 15))",
    "turn_rate_mean_ratio": "-1 * (ts_mean(turn_rate, 20) / ts_mean(turn_rate, 120))",
    "close_30d_return": "-1 * (close / delay(close, 30) - 1)",
    "wma_high_open_spread": "-1 * ts_wma(high - open, 5)",
    "max_drawdown_net_flow": "-1 * rolling_max_drawdown(net_flow, 15)",
    "price_liquidity_preference": "-1 * rank(close) * rank(volume)",
    "volume_stability_adjustment": "ts_change(vol60, 5) - ts_change(tvsd20, 5)",
    "liquidity_quality_filter": "rank(volume) * (1 - rank(rolling_std(close, 10)))",
    "direction_strength_times_volatility": "-1 * rank(ts_sum(close - open, 15)) * rank(rolling_std(close, 15))",
    "open_close_momentum_resonance": "(ts_mean(open, 10) - ts_mean(close, 10)) * rank(delta(close, 10))",
    "short_term_volatility_adjusted_return": "rank(ts_sum(close - open, 15)) * (1 - rank(rolling_std(close, 15)))",
    "inverse_volatility_covariance": "-1 * ts_cov(vroc12, rolling_std(rank(close), 15), 20)",
    "double_volatility_ratio": "rolling_std(reinstatement, 35) / rolling_std(tvsd20, 35)",
    "momentum_flow_decay": "decay_linear(vroc12, 10) + decay_linear(main_flow20, 10)",
    "flow_diff_decay": "decay_linear(abs(rank(main_flow20)) - abs(rank(large_flow)), 15)",
    "momentum_liquidity_flow": "decay_linear(vol60, 10) * ts_change(main_flow20, 10)",
    "main_flow_decay_volatility_synergy": "decay_linear(main_flow20, 10) * vol60",
    "main_large_flow_rank_synergy": "rank(ts_rank_pct(main_flow20, 30) * decay_linear(large_flow, 15))",
    "main_large_flow_decay_spread": "decay_linear(main_flow20, 5) - decay_linear(large_flow, 5)",
    "beta_size_ir_spread": "ts_ir(beta, 20) - ts_ir(size, 20)",
    "main_flow_volatility_synergy": "ts_rank_pct(main_flow20, 10) * vol60",
    "flow_rank_decay": "decay_linear(rank(main_flow20 - large_flow), 15)",
    "flow_decay_pctchange": "ts_change(decay_linear(main_flow20, 6), 3)",
    "rank_close_delta_cumulative": "-1 * ts_sum(delta(rank(close), 1), 40)",
    "abs_reinstatement_flow_momentum": "abs(reinstatement) * decay_linear(main_flow20, 15)",
    "main_flow_decay_10d": "decay_linear(main_flow20, 10)",
    "price_momentum_flow_volatility_inverse_coupling": "-1 * rank(close / delay(close, 15)) * rank(rolling_std(main_flow, 15))",
    "close_rank_decay_vroc": "-1 * ts_change(rank(close), 10) * decay_linear(vroc12, 60)",
    "price_main_flow_volatility_negative": "-1 * rank(rolling_std(close, 10)) * rank(rolling_std(main_flow, 10))",
    "price_volume_volatility_negative": "-1 * rank(rolling_std(close, 10)) * rank(rolling_std(volume, 10))",
    "close_mean_volume_turnrate_reversal": "-1 * rank(close / ts_mean(close, 20)) * rank(ts_mean(volume, 20)) * rank(ts_mean(turn_rate, 20))",
    "liquidity_stability_factor": "-1 * ts_mean(rank(turnover), 10)",
    "signedpower_change_pct_mean": "-1 * ts_mean(signedpower(change_pct, 2), 30)",
    "weighted_price_vwap_volatility": "-1 * rolling_std((close - vwap) * volume, 10)",
    "breakout_reversal_condition": "(ts_mean(close, 35) < close) ? (-1 * delta(close, 10)) : 0",
    "volume_close_covariance_negative": "-1 * ts_cov(delta(volume, 1), delta(close, 1), 30)",
    "reversal_turnrate": "-1 * (close / delay(close, 5) * turn_rate)",
    "signedpower_turnrate_rank_close": "-1 * signedpower(rank(rolling_std(turn_rate, 14)), 2) * ts_rank_pct(close, 30)",
    "volume_amount_relative_strength": "rank(ts_sum(volume, 30)) / rank(ts_sum(turnover, 30))",
    "regression_residual_volatility": "-1 * rolling_std(cs_regression_residual(close, volume), 20)",
    "risk_adjusted_momentum_6m_12m": "(rank((close / delay(close, 126) - 1) / rolling_std(close / delay(close, 1) - 1, 126)) + rank((close / delay(close, 252) - 1) / rolling_std(close / delay(close, 1) - 1, 252))) / 2",
}


def low_peer_correlation(ret: Expr, n: int = 252) -> Expr:
    """Minus the correlation of a return with the mean return of all other codes; half a window of days suffices."""
    others = (call("cs_sum", ret) - call("fillna", ret, 0.0)) / (call("cs_count", ret) - call("bool", call("notna", ret)))
    return -call("ts_corr", ret, others, n, n // 2)


def factor(name: str) -> Expr:
    if name == "low_correlation_252d":
        return low_peer_correlation(call("pct_change", col("close"), 1))
    return parse(FORMULAS[name])


def names() -> list[str]:
    return [*FORMULAS, "low_correlation_252d"]
