"""The names users call: operators, their aliases, composed operators, and a formula parser.

``call(name, x, ...)`` finds an operator by any of its names. Operands come first;
what an operator takes beyond them are parameters. :func:`parse` reads formulas as
they are printed in the literature: ``-1 * correlation(rank(open), rank(volume), 10)``.
"""

from __future__ import annotations

import inspect
import math
import re
from collections.abc import Callable

from quantloom.functions import ops  # noqa: F401  fills the table of operators
from quantloom.functions.expr import OPS, Expr, as_expr, col, lit

#: Other names of operators. The value may bind parameters.
ALIASES: dict[str, str] = {
    "rolling_abs": "abs", "ts_abs": "abs", "rolling_sign": "sign", "ts_sign": "sign", "ln": "log", "signedpower": "signed_power",
    "rolling_sum": "ts_sum", "sum": "ts_sum", "rolling_mean": "ts_mean", "mean": "ts_mean", "sma": "ts_mean", "rolling_min": "ts_min", "rolling_max": "ts_max",
    "rolling_median": "ts_median", "median": "ts_median", "rolling_prod": "ts_product", "ts_prod": "ts_product", "product": "ts_product",
    "rolling_skew": "ts_skew", "rolling_kurt": "ts_kurt", "rolling_rank": "ts_rank", "rolling_corr": "ts_corr", "corr": "ts_corr", "correlation": "ts_corr",
    "rolling_cov": "ts_cov", "cov": "ts_cov", "covariance": "ts_cov", "stddev": "ts_std", "lag": "delay", "shift": "delay", "ts_delay": "delay", "rolling_delay": "delay",
    "diff": "delta", "ts_delta": "delta", "rolling_delta": "delta", "ts_pct_change": "pct_change", "rolling_pct_change": "pct_change", "returns": "pct_change",
    "rolling_wma": "decay_linear", "ts_wma": "decay_linear", "wma": "decay_linear", "ts_arg_max": "ts_argmax", "ts_arg_min": "ts_argmin", "rolling_quantile": "ts_quantile",
    "rolling_count": "ts_count", "rolling_sharpe": "ts_sharpe", "rolling_information_ratio": "ts_sharpe", "ts_backfill": "ffill", "ts_fill": "ffill", "regression_slope": "ts_slope", "slope": "ts_slope", "bigger": "max2", "smaller": "min2",
    "rank": "cs_rank", "cs_rank_pct": "cs_rank", "rank_pct": "cs_rank", "rank_centered": "cs_rank_centered", "demean": "cs_demean", "zscore": "cs_zscore", "scale": "cs_scale",
    "cs_scale_minmax": "cs_minmax", "minmax_scale": "cs_minmax", "l1_normalize": "cs_l1", "l2_normalize": "cs_l2", "winsorize_quantile": "cs_winsorize", "top": "cs_top", "bottom": "cs_bottom",
    "indneutralize": "group_demean", "neutralize": "group_demean", "neutralize_by_group": "group_demean", "group_scale": "group_zscore", "group_neutralize": "group_demean",
    "residual": "cs_residual", "cs_regression_residual": "cs_residual", "ts_covariance": "ts_cov", "rolling_beta": "ts_beta", "ts_regbeta": "ts_beta", "ts_pctchange": "pct_change", "ts_std_dev": "ts_std", "ts_decay_linear": "decay_linear",
    "ts_rank_pct": "ts_rank", "rolling_rank_pct": "ts_rank", "rolling_ir": "ts_sharpe", "rolling_mean_return": "ts_mean", "annualized_sharpe": "ts_sharpe", "rolling_sortino": "ts_sortino", "skew": "ts_skew", "kurt": "ts_kurt",
    "rolling_max_drawdown": "ts_max_drawdown", "drawdown_series": "drawdown", "ma": "ts_mean", "cross_sectional_max": "cs_max", "cross_sectional_min": "cs_min", "combo_a": "combo", "shift_back": "lead", "backshift": "lead", "max": "max2", "min": "min2", "nan_to_zero": "fillna", "astype_bool": "bool",
}

COMPOSED: dict[str, Callable[..., Expr]] = {}


def composed(f):
    COMPOSED[f.__name__.rstrip("_")] = f
    return f


@composed
def winsorize_mad(x: Expr, n_mad: float = 3.0) -> Expr:
    """Clip at the date's median and so many scaled median absolute deviations around it."""
    mid = Expr("cs_median", (x,))
    reach = Expr("cs_median", (Expr("abs", (Expr("cs_median_dev", (x,)),)),)) * (n_mad * ops.MAD)
    return Expr("clip", (x, mid - reach, mid + reach))


@composed
def robust_zscore(x: Expr) -> Expr:
    dev = Expr("cs_median_dev", (x,))
    return dev / (Expr("cs_median", (Expr("abs", (dev,)),)) * ops.MAD)


@composed
def neutralize_size(x: Expr, size: Expr) -> Expr:
    """Residual on group dummies and a size exposure: demean both in groups, then one line per date."""
    return Expr("cs_residual", (Expr("group_demean", (x,)), Expr("group_demean", (size,))))


@composed
def std(x: Expr, n: int, ddof: int = 0) -> Expr:
    return Expr("ts_std", (x,), n=n, ddof=ddof)


@composed
def var(x: Expr, n: int, ddof: int = 0) -> Expr:
    return Expr("ts_var", (x,), n=n, ddof=ddof)


rolling_std = COMPOSED["rolling_std"] = std
rolling_var = COMPOSED["rolling_var"] = var


def _filled(x: Expr) -> Expr:
    return Expr("ffill", (x,))


@composed
def ts_change(x: Expr, n: int = 1) -> Expr:
    """Change over n rows in proportion, of values filled forward."""
    return Expr("pct_change", (_filled(x),), n=n)


ts_return = COMPOSED["ts_return"] = COMPOSED["rolling_momentum"] = ts_change


@composed
def ts_returns(x: Expr, n: int = 1, mode: int = 1) -> Expr:
    """Plain (mode 1) or logarithmic (mode 0) return."""
    return Expr("pct_change", (x,), n=n) if mode else log_return(x, n)


@composed
def log_return(x: Expr, n: int = 1) -> Expr:
    return Expr("log", (x / Expr("delay", (x,), n=n),))


@composed
def ts_momentum(x: Expr, long: int = 252, short: int = 21) -> Expr:
    """Long change less the short one, of values filled forward."""
    return ts_change(x, long) - ts_change(x, short)


momentum_12m_1m = COMPOSED["momentum_12m_1m"] = ts_momentum


@composed
def cumulative_return(x: Expr) -> Expr:
    return Expr("cumprod", (x + 1.0,)) - 1.0


COMPOSED["cumulative_returns"] = cumulative_return


@composed
def rolling_zscore(x: Expr, n: int, ddof: int = 0, least: int | None = None) -> Expr:
    return Expr("ts_zscore", (x,), n=n, ddof=ddof, least=least)


@composed
def expanding_zscore(x: Expr, least: int = 20, ddof: int = 0) -> Expr:
    return Expr("ts_zscore", (x,), n=None, ddof=ddof, least=least)


@composed
def rank_desc(x: Expr) -> Expr:
    return Expr("cs_rank", (-x,))


@composed
def top_n(x: Expr, n: int) -> Expr:
    """The n largest values of a date, the others missing."""
    return Expr("where", (x, Expr("cs_top", (x,), n=n) > 0.0))


@composed
def bottom_n(x: Expr, n: int) -> Expr:
    return Expr("where", (x, Expr("cs_bottom", (x,), n=n) > 0.0))


@composed
def rolling_volatility(x: Expr, n: int, periods: int = 1, least: int | None = None) -> Expr:
    """Population deviation of returns, scaled to so many periods."""
    return Expr("ts_std", (x,), n=n, ddof=0, least=least) * math.sqrt(periods)


@composed
def annualized_volatility(x: Expr, n: int = 252, periods: int = 252) -> Expr:
    return rolling_volatility(x, n, periods)


@composed
def decay_exponential(x: Expr, halflife: float) -> Expr:
    return ewm(x, halflife=halflife)


@composed
def ewm_std(x: Expr, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> Expr:
    """Exponentially weighted deviation by span, half-life, or weight."""
    return Expr("ewm_std", (x,), weight=float(_weight(span, halflife, alpha)))


@composed
def ts_av_diff(x: Expr, n: int) -> Expr:
    return x - Expr("ts_mean", (x,), n=n)


@composed
def ts_scale(x: Expr, n: int, constant: float = 0.0) -> Expr:
    return x * float(n) / (Expr("ts_sum", (Expr("abs", (x,)),), n=n) + constant)


@composed
def ts_winsorize(x: Expr, low: float = 0.01, high: float = 0.99, n: int | None = None) -> Expr:
    """Clip at quantiles of a code's last n rows, or of all its rows."""
    lo, hi = (Expr("time_quantile", (x,), q=q) if n is None else Expr("ts_quantile", (x,), n=n, q=q, least=1) for q in (low, high))
    return Expr("clip", (x, lo, hi))


@composed
def ts_winsorize_mad(x: Expr, n: int, k: float = 5.0) -> Expr:
    """Clip at a window's median and so many scaled median deviations around it."""
    mid, wide = Expr("ts_median", (x,), n=n, least=1), Expr("ts_median_dev", (x,), n=n, least=1) * (k * ops.MAD)
    return Expr("clip", (x, mid - wide, mid + wide))


@composed
def cs_standardize(x: Expr) -> Expr:
    """Standard scores; dates without spread give 0."""
    return Expr("ifelse", (Expr("isna", (x,)), x, Expr("fillna", (Expr("cs_zscore", (x,)), 0.0))))


@composed
def sumif(x: Expr, condition: Expr, n: int) -> Expr:
    """Sum over the window's rows for which a condition holds."""
    return Expr("ts_sum", (Expr("ifelse", (condition, x, 0.0)),), n=n)


@composed
def combo(x: Expr, n: int = 250) -> Expr:
    return Expr("ts_mean", (x,), n=n, least=1)


@composed
def cs_minmax_pos(x: Expr) -> Expr:
    """Scaled to 0 to 1; dates without spread give one half."""
    return Expr("ifelse", (Expr("isna", (x,)), x, Expr("fillna", (Expr("cs_minmax", (x,)), 0.5))))


@composed
def cs_minmax_neg(x: Expr) -> Expr:
    return 1.0 - cs_minmax_pos(x)


@composed
def col_minmax_pos(x: Expr, mask: Expr | None = None) -> Expr:
    """Scaled by the least and largest value of the rows that a mask lets through."""
    return Expr("cs_minmax", (x if mask is None else Expr("where", (x, mask)),))


@composed
def col_minmax_neg(x: Expr, mask: Expr | None = None) -> Expr:
    return 1.0 - col_minmax_pos(x, mask)


@composed
def winsorize_cross_section(x: Expr, method: str = "mad", lower: float = 0.01, upper: float = 0.99, n_mad: float = 5.0) -> Expr:
    return winsorize_mad(x, n_mad) if method == "mad" else Expr("cs_winsorize", (x,), lower=lower, upper=upper)


winsorize_factor_panel = COMPOSED["winsorize_factor_panel"] = winsorize_cross_section


@composed
def normalize_cross_section(x: Expr, method: str = "zscore", clip: float | None = None, low: float = 0.0, high: float = 1.0) -> Expr:
    """One of the ways to put a date's values on a common scale."""
    ways = {"zscore": "cs_zscore", "rank": "cs_rank", "rank_centered": "cs_rank_centered", "l1": "cs_l1", "l2": "cs_l2", "demean": "cs_demean"}
    if method == "none":
        return x
    if method == "minmax":
        return Expr("cs_minmax", (x,), lo=low, hi=high)
    out = robust_zscore(x) if method == "robust_zscore" else Expr(ways[method], (x,))
    return out if clip is None else Expr("clip", (out, -clip, clip))


scale_factor_panel = COMPOSED["scale_factor_panel"] = normalize_cross_section


@composed
def neutralize_cross_section(x: Expr, method: str = "group_zscore", exposure: Expr | None = None) -> Expr:
    """Take a group's mean (and deviation), the line of an exposure, or both out of a date's values."""
    if method == "regression":
        return Expr("cs_demean", (x,)) if exposure is None else Expr("cs_residual", (x, exposure))
    if method == "group_regression":
        return Expr("group_demean", (x,)) if exposure is None else neutralize_size(x, exposure)
    return Expr({"group_zscore": "group_zscore", "group_demean": "group_demean"}[method], (x,))


neutralize_factor_panel = COMPOSED["neutralize_factor_panel"] = neutralize_cross_section


@composed
def preprocess_cross_section(x: Expr, winsorize: str | None = "mad", neutralize: str | None = None, normalize: str | None = "zscore", exposure: Expr | None = None) -> Expr:
    out = x if winsorize is None else winsorize_cross_section(x, winsorize)
    out = out if normalize is None else normalize_cross_section(out, normalize)
    return out if neutralize is None else neutralize_cross_section(out, neutralize, exposure)


@composed
def group_dummy_regression_residual(x: Expr) -> Expr:
    """Residual on dummies of the groups, which is the distance to the group's mean."""
    return Expr("group_demean", (x,))


COMPOSED["industry_regression_residual"] = COMPOSED["neutralize_industry"] = group_dummy_regression_residual


@composed
def industry_size_regression_residual(x: Expr, cap: Expr, logged: bool = True) -> Expr:
    return neutralize_size(x, Expr("log", (cap,)) if logged else cap)


@composed
def neutralize_industry_size(x: Expr, size: Expr, k: float = 5.0) -> Expr:
    """Clip, then the residual on group dummies and the standardised size."""
    return neutralize_size(winsorize_mad(x, k), Expr("cs_zscore", (size,)))


@composed
def bucketize_quantiles(x: Expr, q: int = 10) -> Expr:
    """Bucket 1 to q by percentile rank; ties are in one bucket."""
    return Expr("bucket", (Expr("cs_rank", (x,)),), n=q)


@composed
def adv(n: int) -> Expr:
    """Mean volume."""
    return Expr("ts_mean", (col("volume"),), n=n)


@composed
def momentum(x: Expr, n: int, skip: int = 0) -> Expr:
    near = Expr("delay", (x,), n=skip) if skip else x
    return near / Expr("delay", (x,), n=n) - 1


@composed
def volatility(x: Expr, n: int, periods: int = 252) -> Expr:
    return Expr("ts_std", (Expr("pct_change", (x,), n=1),), n=n, ddof=1) * math.sqrt(periods)


@composed
def bollinger(x: Expr, n: int = 20) -> Expr:
    return Expr("ts_zscore", (x,), n=n, ddof=0)


@composed
def rsi(x: Expr, n: int = 14) -> Expr:
    """Relative strength from plain means of gains and losses."""
    d = Expr("delta", (x,), n=1)
    gain, loss = Expr("ts_mean", (Expr("clip_lower", (d, 0.0)),), n=n), Expr("ts_mean", (Expr("clip_lower", (-d, 0.0)),), n=n)
    return 100.0 * gain / (gain + loss)


@composed
def true_range(high: Expr, low: Expr, close: Expr) -> Expr:
    before = Expr("delay", (close,), n=1)
    return Expr("max2", (high - low, Expr("max2", (Expr("abs", (high - before,)), Expr("abs", (low - before,))))))


@composed
def ewm(x: Expr, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> Expr:
    """Exponentially weighted mean by span, half-life, or weight."""
    return Expr("ewm_mean", (x,), weight=float(_weight(span, halflife, alpha)))


def _weight(span: float | None, halflife: float | None, alpha: float | None) -> float:
    return alpha if alpha is not None else 2.0 / (span + 1.0) if span is not None else 1.0 - 0.5 ** (1.0 / halflife)


for _name in ("rolling_ema", "ts_ema", "ema"):
    COMPOSED[_name] = lambda x, n: ewm(x, span=n)


@composed
def count(condition: Expr, n: int) -> Expr:
    """Rows of the window for which a condition holds."""
    return Expr("ts_sum", (Expr("bool", (condition,)),), n=n)


@composed
def highday(x: Expr, n: int) -> Expr:
    """Rows since the window's highest value."""
    return (n - 1.0) - Expr("ts_argmax", (x,), n=n)


@composed
def lowday(x: Expr, n: int) -> Expr:
    return (n - 1.0) - Expr("ts_argmin", (x,), n=n)


@composed
def event_backfill(x: Expr, limit: int) -> Expr:
    return Expr("ffill", (x,), limit=limit)


def call(name: str, *args, **params) -> Expr:
    """Build a node by any name of an operator."""
    if name in COMPOSED:
        return COMPOSED[name](*args, **params)
    name = ALIASES.get(name, name)
    if name not in OPS:
        raise AttributeError(f"no operator {name}")
    names = list(inspect.signature(OPS[name].build).parameters.values())[1:]
    operands = [p for p in names if p.name in ("x", "y", "a", "b", "c", "v", "lo", "hi", "old", "new") and not (p.name in ("lo", "hi", "a") and p.default is not p.empty)]
    count = len(operands)
    for p, value in zip(names[count:], args[count:], strict=False):
        params[p.name] = value
    return Expr(name, args[:count], **params)


_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)|([A-Za-z_][\w.]*)|(\|\||&&|<=|>=|==|!=|[-+*/^<>?:(),]))")


class _Parser:
    """Precedence: ?:, ||, &&, comparison, + -, * /, unary -, ^."""

    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if wanted and t not in wanted:
            raise ValueError(f"{t!r} where {' or '.join(wanted)} should stand")
        self.at += 1
        return t

    def whole(self):
        out = self.choice()
        if self.peek():
            raise ValueError(f"{self.peek()!r} left over")
        return out

    def choice(self):
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.choice()
        self.take(":")
        return Expr("ifelse", (test, yes, self.choice()))

    LEVELS = (("||",), ("&&",), ("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/"))
    NAMES = {"||": "or", "&&": "and", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "==": "eq", "!=": "ne", "+": "add", "-": "sub", "*": "mul", "/": "div"}

    def binary(self, n: int):
        if n == len(self.LEVELS):
            return self.unary()
        left = self.binary(n + 1)
        while self.peek() in self.LEVELS[n]:
            sign = self.take()
            right = self.binary(n + 1)
            if isinstance(left, float) and isinstance(right, float) and sign in "+-*/":
                left = {"+": left + right, "-": left - right, "*": left * right, "/": left / right if right else math.nan}[sign]
            else:
                left = Expr(self.NAMES[sign], (left, right))
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            x = self.unary()
            return -x
        base = self.atom()
        if self.peek() == "^":
            self.take()
            return Expr("pow", (base, self.unary()))
        return base

    def atom(self):
        t = self.take()
        if t == "(":
            out = self.choice()
            self.take(")")
            return out
        if re.fullmatch(r"\d+\.?\d*|\.\d+", t):
            return float(t)
        if self.peek() == "(":
            self.take("(")
            args = []
            while self.peek() not in (")", ""):
                args.append(self.choice())
                if self.peek() == ",":
                    self.take(",")
            self.take(")")
            return function(t.lower(), args)
        if m := re.fullmatch(r"adv(\d+)", t):
            return adv(int(m[1]))
        if t == "amount":
            return col("vwap") * col("volume")
        return col({"returns": "ret"}.get(t, t))


def function(name: str, args: list) -> Expr:
    """A function of a formula; window lengths are rounded to whole numbers, 1 at least."""
    if name in ("min", "max") and len(args) == 2 and isinstance(args[1], float):
        return call(f"ts_{name}", args[0], _window(args[1]))
    if name == "indneutralize":
        return Expr("group_demean", (args[0],), by=dict(args[1].params)["name"].rpartition(".")[2].lower())
    if name in ("scale",):
        return call("cs_scale", args[0], *(float(a) for a in args[1:]))
    if name == "sma" and len(args) == 3:
        return Expr("ewm_mean", (args[0],), weight=args[2] / args[1])
    if name in ("bigger", "smaller", "where", "mask", "replace", "fillna", "clip", "clip_lower", "clip_upper"):  # their numbers are values
        return call(name, *args)
    if name in ("signedpower",):
        return Expr("signed_power", (args[0], args[1]))
    return call(name, *(_window(a) if isinstance(a, float) and k else a for k, a in enumerate(args)))


def _window(length: float) -> int:
    return max(round(length), 1)


def parse(text: str) -> Expr:
    """The expression of a formula; columns are open, high, low, close, volume, vwap, returns, cap."""
    return as_expr(_Parser(text).whole())


__all__ = ["Expr", "call", "col", "lit", "parse"]
