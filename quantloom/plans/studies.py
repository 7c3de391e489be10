"""Queries of selection, states, Bayes and preparation, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import align, bayes, inference, prepare, scorecard, selection, states
from quantloom.plans.books import NAMED_SQL, named_returns
from quantloom.plans.panels import DAILY_SQL, MONTHLY_SQL, daily, monthly, table
from quantloom.plans.research import FACTOR_SQL, IC_SQL, P_SQL, QUERIES, _corr, factor_data, ic_spearman, query
from quantloom.plans.scoring import HORIZON_SQL, NAMES, STACK_SQL, WIDE_SQL, horizons, many, rank_sql, wide

# -- selection --------------------------------------------------------------

IC_NAMED_SQL = f"""
    WITH x AS (SELECT name, date_, CASE WHEN fwd_1 IS NOT NULL THEN factor END AS px, CASE WHEN factor IS NOT NULL THEN fwd_1 END AS py FROM ({STACK_SQL})),
    r AS (SELECT name, date_, {rank_sql('px', 'name, date_')} AS rx, {rank_sql('py', 'name, date_')} AS ry FROM x) SELECT name, date_, {_corr('rx', 'ry')} AS ic FROM r GROUP BY name, date_
"""


@query(IC_NAMED_SQL, ("ic",))
def ic_series(spark, sf_dir):
    return selection.ic_series(many(spark, sf_dir), "fwd_1")


@query(
    f"""WITH p AS (SELECT date_, {', '.join(f"max(CASE WHEN name = '{n}' THEN ic END) AS {n}" for n in NAMES)} FROM ({IC_NAMED_SQL}) GROUP BY date_)
        {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS corr FROM p" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])}""",
    ("corr",),
)
def ic_correlations(spark, sf_dir):
    return selection.ic_correlations(selection.ic_series(many(spark, sf_dir), "fwd_1"), NAMES)


@query(
    f"""SELECT name, avg(ret) * 252 AS growth, stddev_pop(ret) * sqrt(252) AS risk, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, avg(CAST(ret > 0 AS DOUBLE)) AS win_rate, count(ret) AS n FROM ({NAMED_SQL}) WHERE ret IS NOT NULL GROUP BY name""",
    ("growth", "risk", "sharpe", "win_rate"),
)
def return_stats(spark, sf_dir):
    return selection.return_stats(named_returns(spark, sf_dir))


@query()
def factors_selected(spark, sf_dir):
    """Choices by every rule from one correlation matrix: greedy, by average, independent set, representatives, gain."""
    data = many(spark, sf_dir)
    m = selection.matrix(selection.ic_correlations(selection.ic_series(data, "fwd_1"), NAMES))
    scores = {r["name"]: abs(r["fitness"] or 0.0) for r in scorecard.evaluate(data, "fwd_1").select("name", "fitness").collect()}  # a row per factor
    rules = {"greedy": selection.greedy, "average": selection.by_average, "independent": selection.independent, "representatives": selection.representatives}
    rows = [(rule, place, name) for rule, choose in rules.items() for place, name in enumerate(choose(scores, m, 0.5))]
    rows += [("gain", place, name) for place, (name, _) in enumerate(selection.by_gain(named_returns(spark, sf_dir), list(NAMES)))]
    return spark.createDataFrame(rows, "rule string, place int, name string")


# -- market states ----------------------------------------------------------

FEATURE_COLUMNS = ("market_return", "market_vol", "market_momentum")
FEATURES_SQL = f"""
    WITH d AS (SELECT date_, avg(ret) AS market_return, avg(close) AS p FROM ({MONTHLY_SQL}) GROUP BY date_)
    SELECT date_, market_return, CASE WHEN count(market_return) OVER w >= 6 THEN stddev_samp(market_return) OVER w END AS market_vol, p / nullif(lag(p, 6) OVER (ORDER BY date_), 0) - 1 AS market_momentum
    FROM d WINDOW w AS (ORDER BY date_ ROWS 5 PRECEDING)
"""


def market(spark, sf_dir):
    return states.features(monthly(spark, sf_dir), 6)


@query(FEATURES_SQL, FEATURE_COLUMNS)
def market_features(spark, sf_dir):
    return market(spark, sf_dir)


@query(
    f"""WITH s AS (SELECT date_, code, close, CASE WHEN count(close) OVER a >= 50 THEN avg(close) OVER a END AS m, CASE WHEN count(ret) OVER b >= 20 THEN stddev_samp(ret) OVER b END AS v FROM ({DAILY_SQL})
                   WINDOW a AS (PARTITION BY code ORDER BY date_ ROWS 49 PRECEDING), b AS (PARTITION BY code ORDER BY date_ ROWS 19 PRECEDING)),
        t AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY code) AS mid FROM s)
        SELECT date_, code, CASE WHEN close >= m AND v <= mid THEN 'bull_calm' WHEN close >= m AND v > mid THEN 'bull_wild' WHEN close < m AND v <= mid THEN 'bear_calm' WHEN close < m AND v > mid THEN 'bear_wild' END AS state FROM t"""
)
def regime_simple(spark, sf_dir):
    return states.simple_states(daily(spark, sf_dir))


#: A state that SQL can state too: the sign of the mean return, and of the momentum.
STATE_SQL = f"SELECT date_, CASE WHEN market_return > 0 THEN 'up' ELSE 'down' END AS state FROM ({FEATURES_SQL}) WHERE market_return IS NOT NULL"


def signs(spark, sf_dir):
    return market(spark, sf_dir).where("market_return is not null").select("date_", F.when(F.col("market_return") > 0, "up").otherwise("down").alias("state"))


BY_STATE_SQL = f"SELECT state, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS ir, avg(CAST(ic > 0 AS DOUBLE)) AS positive, count(ic) AS n FROM (SELECT s.state, i.ic_fwd_1 AS ic FROM ({IC_SQL}) i JOIN ({STATE_SQL}) s ON i.date_ = s.date_) GROUP BY state"


def ic_states(spark, sf_dir):
    return states.ic_by_state(ic_spearman(spark, sf_dir), "ic_fwd_1", signs(spark, sf_dir))


@query(BY_STATE_SQL, ("mean", "std", "ir", "positive"))
def ic_by_state(spark, sf_dir):
    return ic_states(spark, sf_dir)


@query(f"SELECT stddev_pop(mean) AS spread, 1 / (1 + stddev_pop(mean)) AS stability, CAST(max(sign(mean)) = min(sign(mean)) AS INTEGER) AS same_sign FROM ({BY_STATE_SQL})", ("spread", "stability"))
def ic_state_stability(spark, sf_dir):
    return states.state_stability(ic_states(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT s.date_, s.state, i.ic_fwd_1 AS ic FROM ({IC_SQL}) i JOIN ({STATE_SQL}) s ON i.date_ = s.date_),
        w AS (SELECT date_, state, lag(state) OVER (ORDER BY date_) AS was, avg(ic) OVER (ORDER BY date_ ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS "before", avg(ic) OVER (ORDER BY date_ ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS "after" FROM r)
        SELECT *, "after" - "before" AS change, CAST(sign("after") * sign("before") < 0 AS INTEGER) AS turned FROM w WHERE was IS NOT NULL AND was <> state""",
    ("before", "after", "change"),
)
def ic_around_changes(spark, sf_dir):
    return states.around_changes(ic_spearman(spark, sf_dir), "ic_fwd_1", signs(spark, sf_dir))


@query(f"SELECT p.date_, p.code, s.state FROM ({MONTHLY_SQL}) p LEFT JOIN ({STATE_SQL}) s ON p.date_ = s.date_")
def state_of_codes(spark, sf_dir):
    return states.with_states(monthly(spark, sf_dir).select("date_", "code"), signs(spark, sf_dir))


@query(f"SELECT b.* FROM ({BY_STATE_SQL}) b WHERE state = (SELECT max_by(state, date_) FROM ({STATE_SQL}))", ("mean", "std", "ir", "positive"))
def state_latest(spark, sf_dir):
    return states.latest(ic_states(spark, sf_dir), signs(spark, sf_dir))


@query(f"WITH p AS (SELECT lag(state) OVER (ORDER BY date_) AS before, state FROM ({STATE_SQL})), c AS (SELECT before, state, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY before, state) SELECT *, n / CAST(sum(n) OVER (PARTITION BY before) AS DOUBLE) AS share FROM c", ("share",))
def state_moves(spark, sf_dir):
    return states.state_moves(signs(spark, sf_dir))


@query(
    f"SELECT s.state, count(*) AS n, avg(f.market_return) AS market_return, avg(f.market_vol) AS market_vol, avg(f.market_momentum) AS market_momentum FROM ({FEATURES_SQL}) f JOIN ({STATE_SQL}) s ON f.date_ = s.date_ GROUP BY s.state",
    FEATURE_COLUMNS,
)
def state_summary(spark, sf_dir):
    return states.state_summary(signs(spark, sf_dir), market(spark, sf_dir), FEATURE_COLUMNS)


@query()
def market_states_kmeans(spark, sf_dir):
    return states.state_labels(market(spark, sf_dir))


@query()
def market_states_hidden(spark, sf_dir):
    return states.state_labels(market(spark, sf_dir), method="hidden")


@query(
    f"SELECT CASE WHEN volume >= 8000 THEN 'large' ELSE 'small' END AS slice, date_, {_corr('factor', 'fwd_1')} AS ic FROM (SELECT f.*, m.volume FROM ({FACTOR_SQL}) f JOIN ({MONTHLY_SQL}) m ON f.date_ = m.date_ AND f.code = m.code) GROUP BY ALL",
    ("ic",),
)
def ic_by_slice(spark, sf_dir):
    from quantloom.operators.evaluation import corr_of

    rows = factor_data(spark, sf_dir).join(monthly(spark, sf_dir).select("date_", "code", "volume"), ["date_", "code"])
    return states.slices(rows, F.when(F.col("volume") >= 8000, "large").otherwise("small"), lambda d, s: d.groupBy(s, "date_").agg(corr_of(F.col("factor"), F.col("fwd_1")).alias("ic")))


# -- many tests -------------------------------------------------------------


def tests(spark, sf_dir):
    ic = QUERIES["ic_by_group"](spark, sf_dir)
    x = F.col("ic_fwd_1")
    t = F.avg(x) / F.stddev_samp(x) * F.sqrt(F.count(x))
    return ic.groupBy(F.col("industry").cast("string").alias("name")).agg((1 / (1 + F.abs(t))).alias("p"))


P_NAMED_SQL = f"SELECT CAST(name AS VARCHAR) AS name, p FROM ({P_SQL})"


@query(f"SELECT least(avg(CAST(p > 0.5 AS DOUBLE)) / 0.5, 1) AS pi0 FROM ({P_NAMED_SQL})", ("pi0",))
def tests_null_share(spark, sf_dir):
    return bayes.null_share(tests(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) AS k, least(avg(CAST(p > 0.5 AS DOUBLE)) OVER () / 0.5, 1) AS pi0 FROM ({P_NAMED_SQL})),
        s AS (SELECT *, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS step, (SELECT sum(1.0 / i) FROM range(1, 100000) t(i) WHERE i <= m) AS h FROM r)
        SELECT name, p, least(step * h, 1) AS yekutieli, least(step * pi0, 1) AS q, least(step * h, 1) <= 0.05 AS yekutieli_found, least(step * pi0, 1) <= 0.05 AS q_found FROM s""",
    ("p", "yekutieli", "q"),
)
def tests_corrected(spark, sf_dir):
    return bayes.more_corrections(tests(spark, sf_dir))


def z_scores(spark, sf_dir):
    """A statistic per nation: mean coefficient of variation of its returns over its error."""
    x = F.col("ret")
    rows = monthly(spark, sf_dir).groupBy(F.col("code").cast("string").alias("name"), F.col("industry").cast("string").alias("family"))
    return rows.agg((F.avg(x) / F.stddev_samp(x) * F.sqrt(F.count(x))).alias("z"))


@query()
def tests_bayes(spark, sf_dir):
    return bayes.bayes_table(z_scores(spark, sf_dir))


@query()
def tests_bayes_families(spark, sf_dir):
    return bayes.hierarchical_table(z_scores(spark, sf_dir), "family")


@query()
def tests_bayes_errors(spark, sf_dir):
    return bayes.error_rates(bayes.bayes_table(z_scores(spark, sf_dir), alpha=0.9))


@query(
    f"""WITH w AS (SELECT name, date_, count(ic) OVER w AS n, avg(ic) OVER w AS m, var_samp(ic) OVER w / count(ic) OVER w AS e FROM ({IC_NAMED_SQL}) WINDOW w AS (PARTITION BY name ORDER BY date_ ROWS 23 PRECEDING)),
        s AS (SELECT *, greatest(m * m - e, 0) / nullif(greatest(m * m - e, 0) + e, 0) AS k FROM w)
        SELECT name, date_, CASE WHEN n >= 12 THEN m END AS mean, CASE WHEN n >= 12 AND e IS NOT NULL THEN k END AS shrink, CASE WHEN n >= 12 THEN k * m END AS posterior, CASE WHEN n >= 12 THEN sqrt(k * e) END AS posterior_sd FROM s""",
    ("mean", "shrink", "posterior", "posterior_sd"),
)
def alpha_rolling(spark, sf_dir):
    return bayes.rolling_alpha(selection.ic_series(many(spark, sf_dir), "fwd_1"), "ic", 24, 12)


@query()
def alpha_dynamic(spark, sf_dir):
    return bayes.dynamic_alpha(selection.ic_series(many(spark, sf_dir), "fwd_1"), "ic")


@query(
    f"""WITH p AS (SELECT name, date_, ic AS inside, lead(ic) OVER (PARTITION BY name ORDER BY date_) AS outside FROM ({IC_NAMED_SQL})), r AS (SELECT * FROM p WHERE inside IS NOT NULL AND outside IS NOT NULL),
        g AS (SELECT *, (outside * outside - (outside - inside) * (outside - inside)) / (2 * greatest(var_samp(outside) OVER (PARTITION BY name), 1e-12)) AS g FROM r)
        SELECT name, date_, inside, outside, 1 / (1 + exp(-least(greatest(sum(g) OVER (PARTITION BY name ORDER BY date_ ROWS UNBOUNDED PRECEDING), -700), 700))) AS belief FROM g""",
    ("inside", "outside", "belief"),
)
def alpha_hacking(spark, sf_dir):
    ic = selection.ic_series(many(spark, sf_dir), "fwd_1")
    pairs = ic.select("name", "date_", F.col("ic").alias("inside"), F.lead("ic").over(Window.partitionBy("name").orderBy("date_")).alias("outside"))
    return bayes.hacking_update(pairs, "inside", "outside")


@query()
def factor_convexity(spark, sf_dir):
    from quantloom.plans.scoring import portfolio_and_market

    return bayes.quadratic(portfolio_and_market(spark, sf_dir), "factor_return", "market")


@query(f"SELECT name, regr_slope(mean_ic, horizon) AS slope, min_by(mean_ic, horizon) AS first, max_by(mean_ic, horizon) AS last FROM ({HORIZON_SQL}) GROUP BY name", ("slope", "first", "last"))
def factor_decay(spark, sf_dir):
    return bayes.decay(horizons(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT ic_fwd_1 AS x, row_number() OVER (ORDER BY date_ DESC) <= 12 AS fresh FROM ({IC_SQL}) WHERE ic_fwd_1 IS NOT NULL),
        a AS (SELECT avg(x) FILTER (WHERE NOT fresh) AS history, avg(x) FILTER (WHERE fresh) AS recent, avg(x) FILTER (WHERE NOT fresh) / stddev_samp(x) FILTER (WHERE NOT fresh) AS history_ir, avg(x) FILTER (WHERE fresh) / stddev_samp(x) FILTER (WHERE fresh) AS recent_ir FROM r)
        SELECT *, recent - history AS gap, recent / nullif(history, 0) AS quotient FROM a""",
    ("history", "recent", "history_ir", "recent_ir", "gap", "quotient"),
)
def ic_recent(spark, sf_dir):
    return bayes.recent(ic_spearman(spark, sf_dir), "ic_fwd_1")


@query()
def ic_validated(spark, sf_dir):
    """Bootstrap interval and sign-flip p value of every factor's coefficients; seeded, one short series per task."""
    return inference.validated(selection.ic_series(many(spark, sf_dir), "fwd_1"), "ic", 500)


# -- preparation ------------------------------------------------------------

HOLES_SQL = f"SELECT date_, code, industry, CASE WHEN close > open THEN close END AS x FROM ({MONTHLY_SQL})"


def holes(spark, sf_dir):
    return monthly(spark, sf_dir).select("date_", "code", "industry", F.when(F.col("close") > F.col("open"), F.col("close")).alias("x"))


_BEHIND, _AHEAD = "(PARTITION BY code ORDER BY date_ ROWS UNBOUNDED PRECEDING)", "(PARTITION BY code ORDER BY date_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date_) AS k FROM ({HOLES_SQL})),
        e AS (SELECT *, last_value(x IGNORE NULLS) OVER {_BEHIND} AS a, last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER {_BEHIND} AS ka, first_value(x IGNORE NULLS) OVER {_AHEAD} AS b, first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER {_AHEAD} AS kb FROM k)
        SELECT date_, code, coalesce(x, a + (b - a) * (k - ka) / nullif(kb - ka, 0), a) AS x FROM e""",
    ("x",),
)
def fill_between(spark, sf_dir):
    return prepare.fill(holes(spark, sf_dir), "x", "interpolate").select("date_", "code", "x")


@query(f"SELECT date_, code, first_value(x IGNORE NULLS) OVER {_AHEAD} AS x FROM ({HOLES_SQL})", ("x",))
def fill_backward(spark, sf_dir):
    return prepare.fill(holes(spark, sf_dir), "x", "bfill").select("date_", "code", "x")


@query(f"SELECT date_, code, coalesce(x, -1.0) AS x FROM ({HOLES_SQL})", ("x",))
def fill_constant(spark, sf_dir):
    return prepare.fill(holes(spark, sf_dir), "x", "constant", -1.0).select("date_", "code", "x")


@query(
    f"""WITH m AS (SELECT date_, code, close, abs(close - median(close) OVER (PARTITION BY date_)) AS far FROM ({MONTHLY_SQL})), n AS (SELECT *, median(far) OVER (PARTITION BY date_) AS mad FROM m)
        SELECT date_, code, CASE WHEN far > 2.0 * 1.4826 * mad THEN NULL ELSE close END AS close FROM n""",
    ("close",),
)
def outliers_removed(spark, sf_dir):
    return prepare.without_outliers(monthly(spark, sf_dir).select("date_", "code", "close"), "close", "mad", 2.0)


@query(
    f"""SELECT date_, code, CAST(close < quantile_cont(close, 0.1) OVER (PARTITION BY date_) OR close > quantile_cont(close, 0.9) OVER (PARTITION BY date_) AS INTEGER) AS outlier FROM ({MONTHLY_SQL})"""
)
def outliers_quantile(spark, sf_dir):
    return prepare.outliers(monthly(spark, sf_dir).select("date_", "code", "close"), "close", "quantile", 0.1).drop("close")


BINNED_SQL = "SELECT c_custkey, c_mktsegment AS bin, CAST(c_acctbal < 1000 AS INTEGER) AS target FROM customer"


def binned(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("bin"), (F.col("c_acctbal") < 1000).cast("int").alias("target"))


@query(
    f"""WITH b AS ({BINNED_SQL}), s AS (SELECT bin, sum(1 - target) AS g, sum(target) AS d FROM b GROUP BY bin), t AS (SELECT sum(g) AS tg, sum(d) AS td FROM s)
        SELECT b.c_custkey, ln(((g + 0.5) / (tg + 0.5)) / ((d + 0.5) / (td + 0.5))) AS woe FROM b JOIN s ON b.bin = s.bin, t""",
    ("woe",),
)
def encode_woe(spark, sf_dir):
    return prepare.woe_encode(binned(spark, sf_dir), "bin", "target").select("c_custkey", "woe")


@query(f"WITH b AS ({BINNED_SQL}), s AS (SELECT bin, (sum(target) + (SELECT avg(target) FROM b) * 1.0) / (count(*) + 1.0) AS encoded FROM b GROUP BY bin) SELECT b.c_custkey, s.encoded FROM b JOIN s ON b.bin = s.bin", ("encoded",))
def encode_target(spark, sf_dir):
    return prepare.target_encode(binned(spark, sf_dir), "bin", "target").select("c_custkey", "encoded")


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS c_mktsegment_{i}" for i, v in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))) + " FROM customer")
def encode_one_hot(spark, sf_dir):
    values = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return prepare.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", values).drop("c_mktsegment")


@query(
    f"""WITH f AS (SELECT date_, code, industry, coalesce(x, median(x) OVER (PARTITION BY date_)) AS x FROM ({HOLES_SQL})), m AS (SELECT *, median(x) OVER d AS mid, abs(x - median(x) OVER d) AS far FROM f WINDOW d AS (PARTITION BY date_)),
        c AS (SELECT *, CASE WHEN x IS NOT NULL THEN least(greatest(x, mid - median(far) OVER d * 5 * 1.4826), mid + median(far) OVER d * 5 * 1.4826) END AS w FROM m WINDOW d AS (PARTITION BY date_)),
        n AS (SELECT *, w - avg(w) OVER (PARTITION BY date_, industry) AS z FROM c)
        SELECT date_, code, industry, CASE WHEN stddev_pop(z) OVER d > 1e-9 THEN (z - avg(z) OVER d) / (stddev_pop(z) OVER d) END AS x FROM n WINDOW d AS (PARTITION BY date_)""",
    ("x",),
)
def prepared(spark, sf_dir):
    return prepare.Preparer("x", "median", "mad", "group_demean", "zscore").transform(holes(spark, sf_dir))


@query()
def bins_supervised(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 3 == 0).cast("int").alias("target"))
    return prepare.bin_supervised(rows, "x", "target")


@query()
def bins_kmeans(spark, sf_dir):
    return prepare.bin_kmeans(monthly(spark, sf_dir).select("date_", "code", "close"), "close", 4)


@query()
def outliers_isolation(spark, sf_dir):
    return prepare.isolation(monthly(spark, sf_dir).select("date_", "code", "close", "volume"), ["close", "volume"])


# -- alignment --------------------------------------------------------------


@query("SELECT o_custkey AS code, " + ", ".join(f"sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(o_totalprice AS DOUBLE) END) AS \"{s}\"" for s in ("F", "O", "P")) + " FROM orders GROUP BY o_custkey", ("F", "O", "P"))
def long_to_wide(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("v"))
    return align.widen(rows, ["code"], "o_orderstatus", "v", ["F", "O", "P"], "sum")


@query(
    f"""SELECT date_, code, field, value FROM (SELECT date_, code, open, close FROM ({MONTHLY_SQL})) UNPIVOT INCLUDE NULLS (value FOR field IN (open, close))""",
    ("value",),
)
def wide_to_long(spark, sf_dir):
    return align.lengthen(monthly(spark, sf_dir).select("date_", "code", "open", "close"), ["date_", "code"], ["open", "close"], "field")


@query(
    f"""WITH d AS (SELECT date_, row_number() OVER (ORDER BY date_) AS k FROM (SELECT DISTINCT date_ FROM ({MONTHLY_SQL}))) SELECT date_, lead(date_, 2) OVER (ORDER BY k) AS later, CAST(k - 1 AS BIGINT) AS since FROM d"""
)
def calendar_steps(spark, sf_dir):
    return align.calendar_steps(align.sessions(monthly(spark, sf_dir)), 2)


@query(
    f"""SELECT date_, code, close * f AS close, open * f AS open FROM (SELECT *, exp(sum(ln(CASE WHEN month(date_) = 6 THEN 0.5 ELSE 1.0 END)) OVER (PARTITION BY code ORDER BY date_ DESC ROWS UNBOUNDED PRECEDING) - ln(CASE WHEN month(date_) = 6 THEN 0.5 ELSE 1.0 END)) AS f FROM ({MONTHLY_SQL}))""",
    ("close", "open"),
)
def adjusted_prices(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("split", F.when(F.month("date_") == 6, 0.5).otherwise(1.0))
    return align.adjusted(rows, "split", ["close", "open"]).select("date_", "code", "close", "open")


@query(f"SELECT date_, code, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date_) AS k FROM ({MONTHLY_SQL})) WHERE (k - 1) % 3 = 0", ("close",))
def every_third(spark, sf_dir):
    return align.stride(monthly(spark, sf_dir), 3).select("date_", "code", "close")


@query(
    f"""SELECT date_, code, side FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date_ ORDER BY round(factor, 9) DESC, code) <= greatest(1, floor(n * 0.2)) THEN 'top' WHEN row_number() OVER (PARTITION BY date_ ORDER BY round(factor, 9), code) <= greatest(1, floor(n * 0.2)) THEN 'bottom' END AS side
        FROM (SELECT *, count(*) OVER (PARTITION BY date_) AS n FROM ({FACTOR_SQL}) WHERE factor IS NOT NULL)) WHERE side IS NOT NULL"""
)
def fraction_buckets(spark, sf_dir):
    return align.fractions(factor_data(spark, sf_dir), "factor", 0.2).select("date_", "code", "side")


@query(f"SELECT date_, code, close FROM ({MONTHLY_SQL}) WHERE code IN (SELECT DISTINCT code FROM ({MONTHLY_SQL}) ORDER BY code LIMIT 5)", ("close",))
def limited_codes(spark, sf_dir):
    return align.limit_codes(monthly(spark, sf_dir), 5).select("date_", "code", "close")


@query(f"SELECT date_, code, close AS x, 'close' AS kind FROM ({MONTHLY_SQL}) UNION ALL SELECT date_, code, open, 'open' FROM ({MONTHLY_SQL})", ("x",))
def panels_union(spark, sf_dir):
    p = monthly(spark, sf_dir)
    return p.select("date_", "code", F.col("close").alias("x"), F.lit("close").alias("kind")).unionByName(p.select("date_", "code", F.col("open").alias("x"), F.lit("open").alias("kind")))


@query(f"SELECT date_ FROM (SELECT DISTINCT date_ FROM ({DAILY_SQL}) WHERE code < '2') EXCEPT SELECT DISTINCT date_ FROM ({DAILY_SQL}) WHERE code > '4'")
def dates_without(spark, sf_dir):
    p = daily(spark, sf_dir)
    return p.where("code < '2'").select("date_").distinct().subtract(p.where("code > '4'").select("date_"))


@query(
    """WITH c AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type) SELECT lower(trim(event_type)) AS name, concat_ws('_', event_type, CAST(CAST(n AS BIGINT) AS VARCHAR)) AS label, regexp_replace(event_type, '[aeiou]', '', 'g') AS plain, CAST(length(event_type) AS INTEGER) AS size FROM c"""
)
def text_functions(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.select(F.lower(F.trim("event_type")).alias("name"), F.concat_ws("_", "event_type", F.col("n").cast("string")).alias("label"), F.regexp_replace("event_type", "[aeiou]", "").alias("plain"), F.length("event_type").alias("size"))


@query(f"SELECT date_, code, {rank_sql('momentum', 'date_')} AS place FROM (SELECT date_, code, close AS momentum FROM ({MONTHLY_SQL}))", ("place",))
def cs_places(spark, sf_dir):
    from quantloom.operators.evaluation import mean_rank

    return monthly(spark, sf_dir).select("date_", "code", mean_rank(F.col("close"), ("date_",)).alias("place"))


RESIDUAL_SQL = f"""
    WITH p AS (SELECT date_, code, momentum AS y, reversal AS a, size AS b FROM ({WIDE_SQL}) WHERE momentum IS NOT NULL AND reversal IS NOT NULL AND size IS NOT NULL),
    d AS (SELECT *, y - avg(y) OVER w AS cy, a - avg(a) OVER w AS ca, b - avg(b) OVER w AS cb, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY date_)),
    s AS (SELECT *, sum(ca * ca) OVER w AS aa, sum(cb * cb) OVER w AS bb, sum(ca * cb) OVER w AS ab, sum(ca * cy) OVER w AS ay, sum(cb * cy) OVER w AS sy FROM d WINDOW w AS (PARTITION BY date_))
    SELECT date_, code, cy - (ay * bb - sy * ab) / (aa * bb - ab * ab) * ca - (sy * aa - ay * ab) / (aa * bb - ab * ab) * cb AS residual FROM s WHERE n >= 5
"""


@query(RESIDUAL_SQL, ("residual",))
def residuals_of_two(spark, sf_dir):
    return prepare.orthogonal(wide(spark, sf_dir), "momentum", ["reversal", "size"]).select("date_", "code", "residual")
