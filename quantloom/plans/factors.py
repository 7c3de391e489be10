"""Queries of the expression language: one per operator, and the formula libraries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import alpha101, dsl, gtja191, mined, signals
from quantloom.functions.dsl import call, col, parse
from quantloom.functions.expr import Expr, Frame, lower
from quantloom.functions.render import render
from quantloom.plans import panels

PANELS = {"daily": (panels.daily, panels.DAILY_SQL), "monthly": (panels.monthly, panels.MONTHLY_SQL), "indexed": (panels.indexed, panels.INDEXED_SQL), "flows": (panels.flows, panels.FLOWS_SQL), "accounts": (panels.accounts, panels.ACCOUNTS_SQL)}


def shown(x):
    """Values as single precision after rounding: engines differ in the last bits of a sum."""
    x = x.cast("double")
    return F.round(F.when(F.abs(x) > 1e30, F.signum(x) * 1e30).otherwise(x), 7).cast("float").cast("double")


def shown_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"CAST(CAST(round(CASE WHEN abs({x}) > 1e30 THEN sign({x}) * 1e30 ELSE {x} END, 7) AS FLOAT) AS DOUBLE)"


def plan(panel: str, factors: dict[str, Expr]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = Frame() if panel in ("monthly", "accounts") else Frame(classes=panels.CLASSES)
        out = lower(PANELS[panel][0](spark, sf_dir), factors, frame)
        return out.select("date_", "code", *(shown(F.col(n)).alias(n) for n in factors))

    return run


def text(panel: str, factors: dict[str, Expr]) -> str:
    return render(PANELS[panel][1], factors, wrap=shown_sql)


#: Formulas whose values need days with more than one trade, which the monthly panel has.
SPREAD_101, SPREAD_191 = (66,), (60, 87)

close, open_, high, low, volume, ret, vwap = (col(c) for c in ("close", "open", "high", "low", "volume", "ret", "vwap"))
#: A column with missing cells.
holes = call("where", close, close > open_)

SHAPES: dict[str, tuple[str, dict[str, Expr]]] = {
    # flagship: five-row momentum ranked across codes
    "factor_momentum_rank": ("daily", {"factor": call("cs_rank", call("pct_change", close, 5))}),
    "row_arithmetic": ("daily", {"added": open_ + close, "less": high - low, "times": ret * 2.0, "share": close / volume, "powered": ret**2, "negated": -ret}),
    "row_maths": ("daily", {"absolute": call("abs", ret), "logged": call("log", ret), "exponent": call("exp", call("clip", ret, -3.0, 3.0)), "root": call("sqrt", ret), "signum": call("sign", ret), "signed": call("signed_power", ret, 0.5)}),
    "row_predicates": ("daily", {n: call("bool", e) for n, e in {"lt": open_ < close, "le": open_ <= close, "gt": ret > 0.0, "ge": ret >= 0.0, "eq": open_ == close, "ne": ret != 0.0, "both": (open_ < close) & (ret > 0.0), "either": (open_ < close) | (ret > 0.0), "neither": ~(open_ < close)}.items()}),
    "row_choice": ("daily", {"clipped": call("clip", ret, -0.1, 0.1), "floor": call("clip_lower", ret, 0.0), "cap": call("clip_upper", ret, 0.0), "filled": call("fillna", ret, 0.0), "kept": call("where", ret, ret > 0.0), "masked": call("mask", ret, ret > 0.0), "chosen": call("ifelse", ret > 0.0, close, open_), "swapped": call("replace", call("sign", ret), -1.0, 0.0), "missing": call("bool", call("isna", holes)), "present": call("bool", call("notna", holes)), "larger": call("max", open_, close), "smaller": call("min", open_, close)}),
    "ts_aggregates": ("daily", {f"ts_{n}": call(f"ts_{n}", close, 10) for n in ("sum", "mean", "min", "max", "median")}),
    "ts_spread": ("daily", {"std0": call("rolling_std", ret, 20), "std1": call("ts_std", ret, 20, 1), "var0": call("rolling_var", ret, 20), "var1": call("ts_var", ret, 20, 1)}),
    "ts_moments": ("daily", {"skew": call("ts_skew", ret, 20), "kurt": call("ts_kurt", ret, 20)}),
    "ts_quantiles": ("daily", {"low": call("ts_quantile", close, 20, 0.25), "high": call("ts_quantile", close, 20, 0.9)}),
    "ts_with_holes": ("daily", {"strict": call("ts_mean", holes, 5), "loose": call("ts_mean", holes, 5, 2), "counted": call("ts_count", holes, 5, 1)}),
    "ts_shifts": ("daily", {"lagged": call("lag", close, 3), "led": call("lead", close, 3), "diff": call("diff", close, 2), "change": call("pct_change", close, 5)}),
    "ts_positions": ("daily", {"argmax": call("ts_argmax", close, 10), "argmin": call("ts_argmin", close, 10), "ranked": call("ts_rank", close, 10)}),
    "ts_pairs": ("daily", {"corr": call("ts_corr", close, volume, 10), "cov": call("ts_cov", ret, volume, 10), "beta": call("ts_beta", ret, call("delta", volume, 1), 10)}),
    "ts_product": ("daily", {"product": call("ts_product", ret + 1.0, 5)}),
    "ts_weighted": ("daily", {"decay": call("decay_linear", close, 7), "slope": call("ts_slope", close, 8)}),
    "ts_cumulative": ("daily", {"total": call("cumsum", volume), "highest": call("cummax", close), "lowest": call("cummin", close), "seen": call("cumcount", holes), "fall": call("drawdown", close)}),
    "ts_fills": ("daily", {"forward": call("ffill", holes), "forward2": call("ffill", holes, 2), "backward": call("bfill", holes), "backward2": call("bfill", holes, 2)}),
    "ts_scores": ("daily", {"z": call("ts_zscore", close, 20), "band": dsl.bollinger(close, 20), "sharpe": call("ts_sharpe", ret, 20)}),
    "ts_indicators": ("daily", {"rsi": dsl.rsi(close), "range": call("ts_mean", dsl.true_range(high, low, close), 14), "momentum": dsl.momentum(close, 20, 5), "volatility": dsl.volatility(close, 20)}),
    "cs_ranks": ("monthly", {"rank": call("rank", close), "raw": call("cs_rank_raw", close), "centered": call("rank_centered", close), "of_holes": call("rank", holes)}),
    "cs_standard": ("monthly", {"demeaned": call("demean", close), "z": call("zscore", close), "robust": dsl.robust_zscore(close), "minmax": call("minmax_scale", close), "l1": call("l1_normalize", close), "l2": call("l2_normalize", close), "scaled": call("scale", close)}),
    "cs_winsorize": ("monthly", {"by_quantile": call("winsorize_quantile", close, 0.1, 0.9), "by_mad": dsl.winsorize_mad(close, 1.0)}),
    "cs_buckets": ("monthly", {"quantile": call("cs_quantile", close, 5), "qcut": call("cs_qcut", close, 4), "top": call("top", close, 3), "bottom": call("bottom", close, 3)}),
    "cs_regression": ("monthly", {"residual": call("cs_residual", close, volume), "corr": call("cs_corr", close, volume)}),
    "cs_totals": ("monthly", {"mean": call("cs_mean", close), "total": call("cs_sum", volume), "n": call("cs_count", holes), "std": call("cs_std", close)}),
    "group_aggregates": ("monthly", {n: call(f"group_{n}", close) for n in ("mean", "min", "max", "sum", "median", "std", "count")}),
    "group_standard": ("monthly", {"demeaned": call("group_demean", close), "z": call("group_zscore", close), "rank": call("group_rank", close), "filled": call("group_fill", holes)}),
    "neutralize_industry_size": ("monthly", {"neutral": dsl.neutralize_size(close, call("log", col("cap")))}),
    "ts_least": ("daily", {"std": call("ts_std", holes, 10, 1, 3), "var": call("ts_var", holes, 10, 0, 3), "skew": call("ts_skew", holes, 10, 4), "kurt": call("ts_kurt", holes, 10, 5), "z": call("rolling_zscore", holes, 10, least=3), "rank": call("ts_rank", holes, 10, 3), "corr": call("ts_corr", holes, volume, 10, 4), "cov": call("ts_cov", holes, volume, 10, 4), "beta": call("ts_beta", holes, volume, 10, 4), "half": call("ts_quantile", holes, 10, 0.5, 2), "sharpe": call("ts_sharpe", ret, 20, least=5)}),
    "ts_returns": ("daily", {"change": call("ts_change", holes, 2), "momentum": call("ts_momentum", close, 20, 5), "plain": call("ts_returns", close, 3), "logged": call("ts_returns", close, 3, 0), "grown": call("cumulative_return", call("clip", call("fillna", ret, 0.0), -0.01, 0.01)), "apart": call("ts_av_diff", close, 10), "scaled": call("ts_scale", ret, 10), "expanding": call("expanding_zscore", close)}),
    "ts_risk": ("daily", {"volatility": call("rolling_volatility", ret, 20, 252), "sortino": call("rolling_sortino", ret, 20), "sharpe": call("rolling_sharpe", ret, 20, rate=0.02), "ir": call("ts_ir", ret, 20), "fall": call("rolling_max_drawdown", close, 10), "beta": call("rolling_beta", ret, call("cs_mean", ret), 20)}),
    "ts_clipped": ("daily", {"whole": call("ts_winsorize", close, 0.05, 0.95), "rolling": call("ts_winsorize", close, 0.1, 0.9, 20), "mad": call("ts_winsorize_mad", close, 20, 1.0)}),
    "ts_recursive_deviation": ("daily", {"wide": call("ewm_std", close, alpha=0.5), "holes": call("ewm_std", holes, alpha=0.6), "mean": call("decay_exponential", close, 2.0)}),
    "ts_conditional": ("daily", {"added": call("sumif", volume, close > open_, 10), "counted": call("count", close > open_, 10), "high": call("highday", close, 10), "low": call("lowday", close, 10), "loose": call("combo", holes, 10), "product": call("cumprod", call("clip", call("fillna", ret, 0.0), -0.01, 0.01) + 1.0), "back": call("lead", close, 2), "ema": call("ts_ema", close, 5)}),
    "cs_dispatch": ("monthly", {"mad": call("winsorize_cross_section", close, "mad", n_mad=1.0), "quantile": call("winsorize_cross_section", close, "quantile", 0.1, 0.9), **{f"as_{m}": call("normalize_cross_section", close, m) for m in ("zscore", "robust_zscore", "rank", "rank_centered", "minmax", "l1", "l2", "demean")}, "bound": call("normalize_cross_section", close, "zscore", clip=1.0)}),
    "cs_neutral": ("monthly", {**{f"by_{m}": call("neutralize_cross_section", close, m) for m in ("group_zscore", "group_demean", "regression", "group_regression")}, "line": call("neutralize_cross_section", close, "regression", volume), "both": call("industry_size_regression_residual", close, col("cap")), "clipped": call("neutralize_industry_size", close, call("log", col("cap"))), "chain": call("preprocess_cross_section", close, "mad", "group_demean", "zscore")}),
    "cs_scaled": ("monthly", {"pos": call("cs_minmax_pos", close), "neg": call("cs_minmax_neg", close), "masked": call("col_minmax_pos", close, close > open_), "masked_neg": call("col_minmax_neg", close, close > open_), "skew": call("cs_skew", close), "standard": call("cs_standardize", close), "down": call("rank_desc", close), "bucket": call("bucketize_quantiles", close, 4), "best": call("top_n", close, 3), "worst": call("bottom_n", close, 3), "quantile": call("cs_quantile_value", close, 0.3)}),
    "group_more": ("monthly", {"weighted": call("group_weighted_mean", close, volume), "back": call("group_backfill", holes, 5, 1.5)}),
    "class_neutral": ("daily", {c: Expr("group_demean", (close,), by=c) for c in ("sector", "industry", "subindustry")}),
    "ts_recursive": ("daily", {"ewm": dsl.ewm(close, span=10), "of_holes": dsl.ewm(holes, alpha=0.3), "half": dsl.ewm(close, halflife=5)}),
    "formula_parsed": ("daily", {"factor": parse("(close > open) ? rank(delta(close, 1) / delay(close, 1)) : -1 * ts_rank(volume, 5)")}),
}


def alpha_queries() -> dict[str, tuple[str, dict[str, Expr]]]:
    out = {f"alpha101_{n:03d}": ("monthly" if n in SPREAD_101 else "daily", {f"alpha_{n}": alpha101.alpha(n)}) for n in alpha101.FORMULAS}
    out["gtja191_spread"] = ("monthly", {f"alpha_{n}": gtja191.alpha(n) for n in SPREAD_191})
    out["gtja191_index"] = ("indexed", {f"alpha_{n}": gtja191.alpha(n) for n in gtja191.NEED_INDEX})
    own = [n for n in gtja191.FORMULAS if n not in gtja191.NEED_INDEX and n not in SPREAD_191]
    # several formulas a query: what they share is planned once
    for at in range(0, len(mined.names()), 8):
        out[f"mined_{at // 8 + 1:02d}"] = ("flows", {n: mined.factor(n) for n in mined.names()[at : at + 8]})
    listed = list(signals.FORMULAS)
    for at in range(0, len(listed), 10):
        out[f"signals_{at // 10 + 1:02d}"] = ("accounts", {n: signals.signal(n) for n in listed[at : at + 10]})
    for at in range(0, len(own), 6):
        some = own[at : at + 6]
        out[f"gtja191_{some[0]:03d}_{some[-1]:03d}"] = ("daily", {f"alpha_{n}": gtja191.alpha(n) for n in some})
    return out


def shapes() -> dict[str, tuple[str, dict[str, Expr]]]:
    return {**SHAPES, **alpha_queries()}
