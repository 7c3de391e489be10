"""Renders factor expressions as SQL, one common table expression per level.

The text is for another engine than Spark: each operator is stated anew with that
engine's own functions, so that results of the two can be held against each other.
"""

from __future__ import annotations

from collections.abc import Callable

from quantloom.functions.expr import Expr, windowed
from quantloom.functions.ops import reach

SQL: dict[str, Callable[..., str]] = {}

TIME = "PARTITION BY code ORDER BY date_"
CROSS = "PARTITION BY date_"
IN_GROUP = "PARTITION BY date_, industry"


def sql(name: str):
    def add(build):
        SQL[name] = build
        return build

    return add


def rows(n: int | None) -> str:
    return f"({TIME} ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int | None) -> str:
    return f"({TIME} ROWS BETWEEN CURRENT ROW AND {'UNBOUNDED' if n is None else n} FOLLOWING)"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def truth(x: str) -> str:
    return f"coalesce({x}, FALSE)"


def finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


for _name, _sign in (("add", "+"), ("sub", "-"), ("mul", "*")):
    SQL[_name] = lambda a, b, s=_sign: f"({a} {s} {b})"
for _name, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "=")):
    SQL[_name] = lambda a, b, s=_sign: truth(f"({a} {s} {b})")
for _name, _sign in (("and", "AND"), ("or", "OR")):
    SQL[_name] = lambda a, b, s=_sign: f"({a} {s} {b})"
SQL["ne"] = lambda a, b: f"coalesce({a} <> {b}, TRUE)"
SQL["not"] = lambda a: f"(NOT {a})"
SQL["div"] = lambda a, b: f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"
SQL["pow"] = lambda a, b: finite(f"pow(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")
SQL["signed_power"] = lambda a, b: f"(sign({a}) * pow(abs({a}), CAST({b} AS DOUBLE)))"
SQL["neg"] = lambda a: f"(-({a}))"
SQL["abs"] = lambda a: f"abs({a})"
SQL["log"] = lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)"
SQL["exp"] = lambda a: finite(f"exp({a})")
SQL["sqrt"] = lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)"
SQL["sign"] = lambda a: f"CAST(sign(CAST({a} AS DOUBLE)) AS DOUBLE)"
SQL["bool"] = lambda a: f"CAST({truth(a)} AS DOUBLE)"
SQL["ifelse"] = lambda c, a, b: f"(CASE WHEN {truth(c)} THEN {a} ELSE {b} END)"
SQL["where"] = lambda x, c: f"(CASE WHEN {truth(c)} THEN {x} END)"
SQL["mask"] = lambda x, c: f"(CASE WHEN NOT {truth(c)} THEN {x} END)"
SQL["fillna"] = lambda x, v: f"coalesce({x}, {v})"
SQL["isna"] = lambda x: f"({x} IS NULL)"
SQL["notna"] = lambda x: f"({x} IS NOT NULL)"
SQL["clip"] = lambda x, lo, hi: f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"
SQL["clip_lower"] = lambda x, lo: f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, {lo}) END)"
SQL["clip_upper"] = lambda x, hi: f"(CASE WHEN {x} IS NOT NULL THEN least({x}, {hi}) END)"
SQL["max2"] = lambda a, b: f"greatest({a}, {b})"
SQL["min2"] = lambda a, b: f"least({a}, {b})"
SQL["replace"] = lambda x, old, new: f"(CASE WHEN {x} = {old} THEN {new} ELSE {x} END)"
SQL["bucket"] = lambda x, n: f"CAST(CASE WHEN {x} IS NOT NULL THEN greatest(ceil(round({x} * {n}, 9)), 1) END AS DOUBLE)"
SQL["sin"] = lambda x: f"sin({x})"
SQL["round"] = lambda x, n: f"round({x}, {n})"


def full(x: str, n: int, e: str, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) OVER {rows(n)} >= {n if least is None else least} THEN {e} END)"


for _name, _agg in (("ts_sum", "sum"), ("ts_mean", "avg"), ("ts_min", "min"), ("ts_max", "max"), ("ts_product", "product"), ("ts_count", "count"), ("ts_median", "median")):
    SQL[_name] = lambda x, n, least=None, a=_agg: full(x, n, f"{a}({x}) OVER {rows(n)}", least)

SQL["ts_quantile"] = lambda x, n, q, least=None: full(x, n, f"quantile_cont({x}, {q!r}) OVER {rows(n)}", least)
SQL["ts_std"] = lambda x, n, ddof=1, least=None: full(x, n, f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) OVER {rows(n)}", least)
SQL["ts_var"] = lambda x, n, ddof=1, least=None: full(x, n, f"{'var_samp' if ddof else 'var_pop'}({x}) OVER {rows(n)}", least)
SQL["ts_skew"] = lambda x, n, least=None: full(x, n, f"CASE WHEN var_pop({x}) OVER {rows(n)} > 1e-12 AND count({x}) OVER {rows(n)} > 2 THEN skewness({x}) OVER {rows(n)} END", least)
SQL["ts_kurt"] = lambda x, n, least=None: full(x, n, f"CASE WHEN var_pop({x}) OVER {rows(n)} > 1e-12 AND count({x}) OVER {rows(n)} > 3 THEN kurtosis({x}) OVER {rows(n)} END", least)
SQL["ts_ir"] = lambda x, n, least=None: full(x, n, f"CASE WHEN stddev_pop({x}) OVER {rows(n)} > 1e-9 THEN (avg({x}) OVER {rows(n)}) / (stddev_pop({x}) OVER {rows(n)}) END", least)
SQL["ts_median_dev"] = lambda x, n, least=None: full(x, n, f"mad({x}) OVER {rows(n)}", least)
SQL["time_quantile"] = lambda x, q: f"quantile_cont({x}, {q!r}) OVER (PARTITION BY code)"
SQL["cs_skew"] = lambda x: f"(CASE WHEN count({x}) OVER ({CROSS}) > 2 AND var_pop({x}) OVER ({CROSS}) > 1e-12 THEN skewness({x}) OVER ({CROSS}) END)"
SQL["cs_quantile_value"] = lambda x, q: f"quantile_cont({x}, {q!r}) OVER ({CROSS})"
SQL["ts_argmax"] = lambda x, n: full(x, n, f"CAST(list_position(list({x}) OVER {rows(n)}, max({x}) OVER {rows(n)}) - 1 AS DOUBLE)")
SQL["ts_argmin"] = lambda x, n: full(x, n, f"CAST(list_position(list({x}) OVER {rows(n)}, min({x}) OVER {rows(n)}) - 1 AS DOUBLE)")


@sql("ts_zscore")
def _ts_zscore(x, n, ddof=1, least=None):
    sd = f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) OVER {rows(n)}"
    return full(x, n or 2, f"CASE WHEN {sd} > 1e-9 THEN ({x} - avg({x}) OVER {rows(n)}) / ({sd}) END", least) if n else f"(CASE WHEN count({x}) OVER {rows(n)} >= {least or 2} AND {sd} > 1e-9 THEN ({x} - avg({x}) OVER {rows(n)}) / ({sd}) END)"


@sql("ts_rank")
def _ts_rank(x, n, least=None):
    held = f"list({x}) OVER {rows(n)}"
    below, same = f"len(list_filter({held}, lambda e: e < {x}))", f"len(list_filter({held}, lambda e: e = {x}))"
    return full(x, n, f"CASE WHEN {x} IS NOT NULL THEN ({below} + ({same} + 1) / 2.0) / CAST(count({x}) OVER {rows(n)} AS DOUBLE) END", least)


def both(x: str, y: str) -> tuple[str, str]:
    return f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def _corr(x: str, y: str, over: str) -> str:
    sx, sy = f"stddev_samp({x}) OVER {over}", f"stddev_samp({y}) OVER {over}"
    return f"CASE WHEN {sx} > 1e-9 AND {sy} > 1e-9 THEN (covar_samp({x}, {y}) OVER {over}) / (({sx}) * ({sy})) END"


@sql("ts_corr")
def _ts_corr(x, y, n, least=None):
    x, y = both(x, y)
    return f"round({full(x, n, _corr(x, y, rows(n)), least)}, 9)"


@sql("ts_cov")
def _ts_cov(x, y, n, least=None):
    x, y = both(x, y)
    return full(x, n, f"covar_samp({x}, {y}) OVER {rows(n)}", least)


@sql("ts_beta")
def _ts_beta(y, x, n, least=None):
    y, x = both(y, x)
    return full(x, n, f"CASE WHEN var_samp({x}) OVER {rows(n)} > 1e-12 THEN (covar_samp({y}, {x}) OVER {rows(n)}) / (var_samp({x}) OVER {rows(n)}) END", least)


@sql("ts_slope")
def _ts_slope(x, n):
    terms = " + ".join(f"({n - 1 - i} - {(n - 1) / 2.0}) * " + (f"lag({x}, {i}) OVER ({TIME})" if i else x) for i in range(n))
    return full(x, n, f"({terms}) / {n * (n * n - 1) / 12.0!r}")


SQL["delay"] = lambda x, n: f"lag({x}, {n}) OVER ({TIME})"
SQL["lead"] = lambda x, n: f"lead({x}, {n}) OVER ({TIME})"
SQL["delta"] = lambda x, n: f"({x} - lag({x}, {n}) OVER ({TIME}))"
SQL["pct_change"] = lambda x, n: f"({x} / nullif(lag({x}, {n}) OVER ({TIME}), 0) - 1)"


@sql("decay_linear")
def _decay_linear(x, n):
    terms = " + ".join(f"{n - i}.0 * " + (f"lag({x}, {i}) OVER ({TIME})" if i else f"{x}") for i in range(n))
    return full(x, n, f"({terms}) / {n * (n + 1) / 2.0!r}")


@sql("ewm_mean")
def _ewm_mean(x, weight):
    held = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {rows(reach(weight))}"
    return f"(CASE WHEN {x} IS NOT NULL THEN list_reduce({held}, lambda a, v: a * {1 - weight!r} + v * {weight!r}) END)"


for _name, _agg in (("cumsum", "sum"), ("cumprod", "product"), ("cummax", "max"), ("cummin", "min")):
    SQL[_name] = lambda x, a=_agg: f"(CASE WHEN {x} IS NOT NULL THEN {a}({x}) OVER {rows(None)} END)"
SQL["cumcount"] = lambda x: f"CAST(count({x}) OVER {rows(None)} AS DOUBLE)"
SQL["ffill"] = lambda x, limit=None: f"last_value({x} IGNORE NULLS) OVER {rows(None if limit is None else limit + 1)}"
SQL["bfill"] = lambda x, limit=None: f"first_value({x} IGNORE NULLS) OVER {ahead(limit)}"


@sql("ts_sharpe")
def _ts_sharpe(x, n, periods=252, rate=0.0, least=None):
    sd = f"stddev_pop({x}) OVER {rows(n)}"
    return full(x, n, f"CASE WHEN {sd} > 1e-9 THEN (avg({x}) OVER {rows(n)} - {rate / periods!r}) / ({sd}) * {float(periods) ** 0.5!r} END", least)


@sql("ts_sortino")
def _ts_sortino(x, n, periods=252, rate=0.0, least=None):
    e = f"({x} - {rate / periods!r})"
    down = f"sqrt(avg(CASE WHEN {e} < 0 THEN {e} * {e} WHEN {e} IS NOT NULL THEN 0.0 END) OVER {rows(n)})"
    return full(x, n, f"CASE WHEN {down} > 1e-9 THEN (avg({e}) OVER {rows(n)}) / {down} * {float(periods) ** 0.5!r} END", least)


@sql("ts_max_drawdown")
def _ts_max_drawdown(x, n, least=None):
    held = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {rows(n)}"
    falls = f"list_transform({held}, lambda v, i: v / nullif(list_max(list_slice({held}, 1, i)), 0) - 1)"
    return full(x, n, f"list_min({falls})", least)


@sql("ewm_std")
def _ewm_std(x, weight):
    held = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {rows(reach(weight))}"
    n = f"len({held})"
    w = f"list_transform(range({n}), lambda i: CASE WHEN i = 0 THEN pow({1 - weight!r}, {n} - 1) ELSE {weight!r} * pow({1 - weight!r}, {n} - 1 - i) END)"
    mean = f"list_sum(list_transform({held}, lambda v, i: v * ({w})[i]))"
    square = f"list_sum(list_transform({held}, lambda v, i: ({w})[i] * pow(v - {mean}, 2)))"
    return f"(CASE WHEN {x} IS NOT NULL AND {n} > 1 THEN sqrt({square} / (1 - list_sum(list_transform({w}, lambda v: v * v)))) END)"


SQL["drawdown"] = lambda x: f"({x} / nullif(max({x}) OVER {rows(None)}, 0) - 1)"


def _rank(x: str, part: str) -> str:
    r = f"round(CAST({x} AS DOUBLE), 9)"
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER ({part} ORDER BY {r} NULLS LAST) + (count({x}) OVER ({part}, {r}) - 1) / 2.0 END)"


SQL["cs_rank_raw"] = lambda x: _rank(x, CROSS)
SQL["cs_rank"] = lambda x: f"({_rank(x, CROSS)} / count({x}) OVER ({CROSS}))"
SQL["cs_rank_centered"] = lambda x: f"({_rank(x, CROSS)} / count({x}) OVER ({CROSS}) - 0.5)"
SQL["cs_demean"] = lambda x: f"({x} - avg({x}) OVER ({CROSS}))"


@sql("cs_zscore")
def _cs_zscore(x, ddof=0):
    sd = f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) OVER ({CROSS})"
    return f"(CASE WHEN {sd} > 1e-9 THEN ({x} - avg({x}) OVER ({CROSS})) / ({sd}) END)"


SQL["cs_median"] = lambda x: f"median({x}) OVER ({CROSS})"
SQL["cs_median_dev"] = lambda x: f"({x} - median({x}) OVER ({CROSS}))"
SQL["cs_winsorize"] = lambda x, lower=0.01, upper=0.99: (
    f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {lower!r}) OVER ({CROSS})), quantile_cont({x}, {upper!r}) OVER ({CROSS})) END)"
)


@sql("cs_minmax")
def _cs_minmax(x, lo=0.0, hi=1.0):
    low, high = f"min({x}) OVER ({CROSS})", f"max({x}) OVER ({CROSS})"
    return f"(CASE WHEN {high} - {low} > 1e-9 THEN {lo!r} + ({x} - {low}) / ({high} - {low}) * {hi - lo!r} END)"


SQL["cs_l1"] = lambda x: f"({x} / nullif(sum(abs({x})) OVER ({CROSS}), 0))"
SQL["cs_l2"] = lambda x: f"({x} / nullif(sqrt(sum({x} * {x}) OVER ({CROSS})), 0))"
SQL["cs_scale"] = lambda x, a=1.0: f"({x} * {float(a)!r} / nullif(sum(abs({x})) OVER ({CROSS}), 0))"
SQL["cs_mean"] = lambda x: f"avg({x}) OVER ({CROSS})"
SQL["cs_sum"] = lambda x: f"sum({x}) OVER ({CROSS})"
SQL["cs_count"] = lambda x: f"CAST(count({x}) OVER ({CROSS}) AS DOUBLE)"
SQL["cs_max"] = lambda x: f"max({x}) OVER ({CROSS})"
SQL["cs_min"] = lambda x: f"min({x}) OVER ({CROSS})"
SQL["cs_std"] = lambda x, ddof=0: f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) OVER ({CROSS})"


def _place(x: str, down: bool = False) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN row_number() OVER ({CROSS} ORDER BY round(CAST({x} AS DOUBLE), 9) {'DESC' if down else 'ASC'} NULLS LAST, code) END)"


SQL["cs_quantile"] = lambda x, q=5: f"CAST(ceil({_place(x)} * {q} / CAST(count({x}) OVER ({CROSS}) AS DOUBLE)) AS DOUBLE)"
SQL["cs_qcut"] = lambda x, q=5: f"CAST(CASE WHEN count({x}) OVER ({CROSS}) > 1 THEN greatest(ceil(({_place(x)} - 1) * {q} / CAST(count({x}) OVER ({CROSS}) - 1 AS DOUBLE)), 1) - 1 END AS DOUBLE)"
SQL["cs_top"] = lambda x, n: f"CAST(coalesce({_place(x, True)} <= {n}, FALSE) AS DOUBLE)"
SQL["cs_bottom"] = lambda x, n: f"CAST(coalesce({_place(x)} <= {n}, FALSE) AS DOUBLE)"


@sql("cs_residual")
def _cs_residual(y, x):
    y, x = both(y, x)
    w = f"({CROSS})"
    slope = f"(CASE WHEN var_samp({x}) OVER {w} > 1e-12 THEN (covar_samp({y}, {x}) OVER {w}) / (var_samp({x}) OVER {w}) ELSE 0.0 END)"
    return f"({y} - avg({y}) OVER {w} - {slope} * ({x} - avg({x}) OVER {w}))"


@sql("cs_corr")
def _cs_corr(x, y):
    x, y = both(x, y)
    return f"({_corr(x, y, f'({CROSS})')})"


for _name, _agg in (("group_mean", "avg"), ("group_min", "min"), ("group_max", "max"), ("group_sum", "sum"), ("group_median", "median"), ("group_std", "stddev_pop")):
    SQL[_name] = lambda x, a=_agg: f"{a}({x}) OVER ({IN_GROUP})"
SQL["group_count"] = lambda x: f"CAST(count({x}) OVER ({IN_GROUP}) AS DOUBLE)"
CLASSES = {"sector": "sector", "industry": "industry", "subindustry": "subindustry"}
SQL["group_demean"] = lambda x, by=None: f"({x} - avg({x}) OVER (PARTITION BY date_, {CLASSES.get(by, 'industry')}))"
SQL["group_zscore"] = lambda x: f"(CASE WHEN stddev_pop({x}) OVER ({IN_GROUP}) > 1e-9 THEN ({x} - avg({x}) OVER ({IN_GROUP})) / (stddev_pop({x}) OVER ({IN_GROUP})) END)"
SQL["group_rank"] = lambda x: f"({_rank(x, IN_GROUP)} / count({x}) OVER ({IN_GROUP}))"
@sql("group_weighted_mean")
def _group_weighted_mean(x, y):
    x, y = both(x, y)
    return f"(sum({x} * {y}) OVER ({IN_GROUP}) / nullif(sum({y}) OVER ({IN_GROUP}), 0))"


@sql("group_backfill")
def _group_backfill(x, n, std=4.0):
    mean, sd = f"avg({x}) OVER {rows(n)}", f"stddev_samp({x}) OVER {rows(n)}"
    return f"coalesce(CASE WHEN {sd} IS NULL OR abs({x} - {mean}) <= {std!r} * ({sd}) THEN {x} END, first_value({x} IGNORE NULLS) OVER ({TIME} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING))"


SQL["group_fill"] = lambda x: f"coalesce({x}, median({x}) OVER ({IN_GROUP}))"


def render(panel: str, factors: dict[str, Expr], keep: tuple[str, ...] = ("date_", "code"), wrap: Callable[[str], str] = lambda x: x) -> str:
    """A query over the text of a panel query."""
    names: dict[str, str] = {}

    def text(e: Expr) -> str:
        if e._key in names:
            return names[e._key]
        params = dict(e.params)
        if e.op == "col":
            return params["name"]
        if e.op == "lit":
            return literal(params["value"])
        return SQL[e.op](*(text(a) for a in e.args), **params)

    parts, last = [f"p0 AS ({panel})"], "p0"
    for k, stage in enumerate(windowed(factors.values()), 1):
        made = {f"w_{len(names) + i}": e for i, e in enumerate(stage)}
        parts.append(f"p{k} AS (SELECT *, " + ", ".join(f"{text(e)} AS {n}" for n, e in made.items()) + f" FROM {last})")
        names |= {e._key: n for n, e in made.items()}
        last = f"p{k}"
    chosen = ", ".join([*keep, *(f"{wrap(text(e))} AS {n}" for n, e in factors.items())])
    return f"WITH {', '.join(parts)} SELECT {chosen} FROM {last}"
