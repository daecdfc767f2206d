"""Registered queries over the derived bars: splits, forecasts, performance, portfolios and backtests."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import covariance as cov, forecast as fc, metrics as fm, performance as perf, splits as sp
from ..operators.boosting import Settings, split_gains
from ..operators.backtest import Config, backtest, curves, summary
from ..operators.optimize import Constraints, efficient_set, optimize
from ..shared import stored
from ..sources.bars import ORACLE as BARS, bars, prices
from ..sources.frames import aligned
from ..functions.features import names
from .panel_queries import FEATURED, RETURNS, panel_returns, rounded
from .registry import query

TRAIN = 0.75


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(bars(spark, sf_dir))


# Splits, on one feature that plain SQL makes: yesterday's return.
def simple_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.returns import simple

    rows = sp.with_targets(panel(spark, sf_dir).withColumn("ret", simple()))
    return sp.scaled(sp.numbered(rows, ["ret"], TRAIN), ["ret"])


SPLIT = BARS + f""", t AS (
  SELECT date, ticker, price, price / lag(price) OVER w - 1 AS ret, lead(price) OVER w / price - 1 AS target, lead(date) OVER w AS target_date, lead(price) OVER w AS actual_price
  FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)
), u AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS seq_no, count(*) OVER (PARTITION BY ticker) AS n FROM t WHERE ret IS NOT NULL AND target IS NOT NULL),
s AS (SELECT *, seq_no < ceil(n * {TRAIN}) AS is_train FROM u),
m AS (SELECT ticker, avg(ret) AS rm, stddev_pop(ret) AS rs, avg(target) AS ym, stddev_pop(target) AS ys, min(price) AS lo, max(price) AS hi FROM s WHERE is_train GROUP BY ticker)
"""


@query("splits_scaled", SPLIT + f"SELECT date, ticker, target_date, is_train, {r6('(ret - rm) / rs', 'ret_scaled')}, {r6('(target - ym) / ys', 'target_scaled')}, {r6('ym', 'y_mean')}, {r6('ys', 'y_scale')} FROM s JOIN m USING (ticker)")
def _split(spark, sf_dir):
    return rounded(simple_split(spark, sf_dir).select("date", "ticker", "target_date", "is_train", "ret_scaled", "target_scaled", "y_mean", "y_scale"))


@query("splits_min_max", SPLIT + f"SELECT date, ticker, {r6('(price - lo) / (hi - lo)', 'price_unit')} FROM s JOIN m USING (ticker)")
def _min_max(spark, sf_dir):
    return rounded(sp.min_max(simple_split(spark, sf_dir), "price").select("date", "ticker", "price_unit"))


@query("splits_validation", SPLIT + f", c AS (SELECT *, CAST(ceil(n * {TRAIN}) AS BIGINT) AS cut FROM s) SELECT date, ticker, is_train, is_train AND seq_no >= greatest(1, least(cut - 1, CAST(floor(cut * 0.85::DOUBLE) AS BIGINT))) AS is_validation FROM c")
def _validation(spark, sf_dir):
    return sp.validation(simple_split(spark, sf_dir), 0.15).select("date", "ticker", "is_train", "is_validation")


@query("splits_sequences", SPLIT + f", q AS (SELECT date, ticker, list(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS x FROM s) SELECT date, ticker, CAST(len(x) AS INTEGER) AS length, {r6('x[1]', 'oldest')}, {r6('list_avg(x)', 'mean')} FROM q WHERE len(x) = 30")
def _sequences(spark, sf_dir):
    rows = sp.sequences(simple_split(spark, sf_dir), ["ret"], 30)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0]) / F.size("x")
    return rounded(rows.select("date", "ticker", F.size("x").alias("length"), F.col("x")[0][0].alias("oldest"), mean.alias("mean")))


@query("lagged_sequences", BARS + ", q AS (SELECT date, ticker, price AS y, list(price) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM prices) SELECT date, ticker, x[1] AS first_x, x[5] AS last_x, y FROM q WHERE len(x) = 5")
def _lagged(spark, sf_dir):
    rows = sp.lagged(panel(spark, sf_dir), 5)
    return rows.select("date", "ticker", F.col("x")[0].alias("first_x"), F.col("x")[4].alias("last_x"), "y")


SCALED = [f"{n}_scaled" for n in (*names(), "target")]
def universe(form) -> str:
    """Split rows of the whole universe, each number as ``form`` puts it."""
    return FEATURED + f""", u AS (SELECT *, lead(price) OVER w / price - 1 AS target, lead(date) OVER w AS target_date, price AS prev_price, lead(price) OVER w AS actual_price FROM featured WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS seq_no, count(*) OVER (PARTITION BY ticker) AS n FROM u WHERE target IS NOT NULL AND {" AND ".join(f"{n} IS NOT NULL" for n in names())}),
s AS (SELECT *, seq_no < ceil(n * {TRAIN}) AS is_train FROM v),
m AS (SELECT ticker, count(*) FILTER (is_train) AS n_train, count(*) AS n_all, {", ".join(f"avg({n}) FILTER (is_train) AS m_{n}, stddev_pop({n}) FILTER (is_train) AS s_{n}" for n in (*names(), "target"))} FROM s GROUP BY ticker HAVING n_train >= {sp.LEAST_TRAIN} AND n_train < n_all)
SELECT date, ticker, target_date, is_train, prev_price, actual_price, {", ".join(form(f"({n} - m_{n}) / CASE WHEN s_{n} > {sp.TINY} THEN s_{n} ELSE 1 END", f"{n}_scaled") for n in (*names(), "target"))},
{form("m_target", "y_mean")}, {form(f"CASE WHEN s_target > {sp.TINY} THEN s_target ELSE 1 END", "y_scale")} FROM s JOIN m USING (ticker)"""


UNIVERSE = universe(r6)


@query("splits_universe", UNIVERSE)
def _universe(spark, sf_dir):
    rows, _ = sp.splits(panel(spark, sf_dir), TRAIN)
    return rounded(rows.select("date", "ticker", "target_date", "is_train", "prev_price", "actual_price", *SCALED, "y_mean", "y_scale"))


NAIVE = BARS + f""", f AS (
  SELECT ticker, date, lag(price) OVER w AS predicted, price AS actual, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY ticker) AS n FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)
), naive AS (SELECT ticker, date, predicted, actual FROM f WHERE n >= 200 AND seq >= ceil(n * {TRAIN}))
"""


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.naive(panel(spark, sf_dir), fc.Params(train=TRAIN))[0]


@query("forecast_naive", NAIVE + "SELECT * FROM naive")
def _naive(spark, sf_dir):
    return naive(spark, sf_dir)


@query("forecast_returns", NAIVE + f"SELECT ticker, date, predicted, actual, {r6('predicted / lag(predicted) OVER w - 1', 'predicted_return')}, {r6('actual / lag(actual) OVER w - 1', 'actual_return')} FROM naive WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def _forecast_returns(spark, sf_dir):
    return rounded(fc.returns_of(naive(spark, sf_dir)))


# Forecasts of tickers with different dates: some lack every third day.
LATE = ("LARGE", "MEDIUM", "SMALL")


@query("forecast_aligned", NAIVE + f", sparse AS (SELECT * FROM naive WHERE NOT (ticker IN {LATE} AND day(date) % 3 = 0)) SELECT date, ticker, predicted, actual FROM (SELECT DISTINCT date FROM sparse) CROSS JOIN (SELECT DISTINCT ticker FROM sparse) LEFT JOIN sparse USING (date, ticker)")
def _aligned(spark, sf_dir):
    some = naive(spark, sf_dir).where(~(F.col("ticker").isin(*LATE) & (F.dayofmonth("date") % 3 == 0)))
    return fc.outer_aligned(some)


# A forecast with calls of its own: halfway from the price before to the mean of the last five.
def half(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.windows import by_date

    mean = F.avg("actual").over(by_date().rowsBetween(-5, -1))
    return naive(spark, sf_dir).withColumn("predicted", F.round((F.col("predicted") + F.coalesce(mean, "predicted")) / 2, 6))


METRICS = NAIVE + """, half AS (SELECT ticker, date, actual, round((predicted + coalesce(avg(actual) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), predicted)) / 2, 6) AS predicted FROM naive),
e AS (SELECT *, lag(actual) OVER (PARTITION BY ticker ORDER BY date) AS before FROM half),
metrics AS (SELECT ticker, count(*) AS observations, sqrt(avg(pow(predicted - actual, 2))) AS rmse, avg(abs(predicted - actual)) AS mae,
  1 - sum(pow(predicted - actual, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs((actual - predicted) / actual)) * 100 AS mape,
  avg(CASE WHEN sign(predicted - before) <> 0 AND sign(actual - before) <> 0 THEN CASE WHEN sign(predicted - before) = sign(actual - before) THEN 1.0 ELSE 0.0 END END) AS directional_accuracy,
  avg(CASE WHEN before IS NOT NULL THEN abs(predicted - actual) END) / avg(abs(before - actual)) AS mase,
  greatest(0, least(100, 100 * (1 - sqrt(avg(pow(predicted - actual, 2))) / avg(actual)))) AS accuracy FROM e GROUP BY ticker)
"""
MEASURES = ("rmse", "mae", "r2", "mape", "directional_accuracy", "mase", "accuracy")


@query("forecast_metrics", METRICS + "SELECT ticker, observations, " + ", ".join(r6(m, m) for m in MEASURES) + " FROM metrics")
def _metrics(spark, sf_dir):
    return rounded(fm.metrics(half(spark, sf_dir)))


@query("forecast_metrics_summary", METRICS + f", long AS (UNPIVOT metrics ON {', '.join(MEASURES)} INTO NAME metric VALUE value) SELECT metric, {r6('avg(value)', 'mean')}, {r6('min(value)', 'low')}, {r6('max(value)', 'high')} FROM long GROUP BY metric")
def _metrics_summary(spark, sf_dir):
    return rounded(fm.summary(fm.metrics(half(spark, sf_dir))))


@query("forecast_gbt")
def _gbt(spark, sf_dir):
    return rounded(fc.boosted(panel(spark, sf_dir), fc.Params(trees=Settings(trees=8, leaves=15)))[0])


@query("forecast_gbt_each")
def _gbt_each(spark, sf_dir):
    return rounded(fc.boosted(panel(spark, sf_dir), fc.Params(pooled=False))[0])


# The first cuts of a tree over two features at edges that SQL knows too.
CUT = ("ret_lag_1", "mom_21")
EDGES = (-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5)
GAINS = f"""WITH universe AS ({universe(lambda expr, name: f"{expr} AS {name}")}), learnt AS (SELECT * FROM universe WHERE is_train),
base AS (SELECT avg(target_scaled) AS b FROM learnt),
points AS ({' UNION ALL '.join(f"SELECT '{c}_scaled' AS feature, {c}_scaled AS x, b - target_scaled AS g FROM learnt, base" for c in CUT)}),
edges AS (SELECT unnest({list(EDGES)}) AS edge, CAST(unnest(range({len(EDGES)})) AS INTEGER) AS cut),
sides AS (SELECT feature, cut, sum(g) FILTER (x <= edge) AS gl, count(*) FILTER (x <= edge) AS nl, sum(g) FILTER (x > edge) AS gr, count(*) FILTER (x > edge) AS nr, sum(g) AS ga, count(*) AS na FROM points, edges GROUP BY ALL)
SELECT feature, cut, {r6(' '.join(f"{sign} pow(greatest(abs({g}) - 0.1, 0), 2) / ({n} + 1)" for sign, g, n in (('', 'gl', 'nl'), ('+', 'gr', 'nr'), ('-', 'ga', 'na'))), 'gain')} FROM sides WHERE nl >= 40 AND nr >= 40"""


@query("boosting_split_gains", GAINS)
def _gains(spark, sf_dir):
    rows, _ = sp.splits(panel(spark, sf_dir), TRAIN)
    return rounded(split_gains(rows.where("is_train"), [f"{c}_scaled" for c in CUT], [np.array(EDGES)] * len(CUT), Settings()))


# Performance.
LONG = BARS + ", ratios AS (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM prices), series AS (SELECT ticker AS strategy, date, r FROM ratios WHERE r IS NOT NULL)"
PERFORMANCE = """, grown AS (SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY date) AS g FROM series),
peaks AS (SELECT *, g / max(g) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM grown),
stats AS (SELECT strategy, avg(r) * 252 AS ar, stddev_samp(r) * sqrt(252) AS av, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS ds, min(dd) AS md FROM peaks GROUP BY strategy)
"""
STATS = ", ".join((r6("ar", "annual_return"), r6("av", "annual_volatility"), r6("CASE WHEN av > 0 THEN ar / av ELSE 0 END", "sharpe"), r6("CASE WHEN ds > 0 THEN ar / ds ELSE 0 END", "sortino"), r6("md", "max_drawdown")))


def ticker_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.returns import simple_returns

    return simple_returns(panel(spark, sf_dir))


@query("performance_by_ticker", LONG + PERFORMANCE + f"SELECT strategy AS ticker, {STATS} FROM stats")
def _performance(spark, sf_dir):
    return rounded(perf.performance(ticker_returns(spark, sf_dir), "ticker"))


MIX = "CASE ticker WHEN 'ECONOMY' THEN 0.5 WHEN 'LARGE' THEN 0.3 WHEN 'SMALL' THEN 0.2 END"
MIXED = RETURNS + f""", w AS (SELECT DISTINCT 'Equal' AS strategy, ticker, 1.0::DOUBLE / 6 AS weight FROM returns UNION ALL SELECT DISTINCT 'Mix', ticker, CAST({MIX} AS DOUBLE) FROM returns WHERE {MIX} IS NOT NULL),
series AS (SELECT date, strategy, sum(r * weight) AS r FROM returns JOIN w USING (ticker) GROUP BY date, strategy)
"""


def mix(spark: SparkSession, returns: DataFrame) -> DataFrame:
    mixed = spark.createDataFrame([("Mix", t, w) for t, w in (("ECONOMY", 0.5), ("LARGE", 0.3), ("SMALL", 0.2), ("ABSENT", 9.0))], "strategy string, ticker string, weight double")
    return returns.select(F.lit("Equal").alias("strategy"), "ticker").distinct().withColumn("weight", F.lit(1.0) / 6).unionByName(mixed)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = panel_returns(spark, sf_dir)
    return perf.portfolio_returns(returns, F.broadcast(mix(spark, returns)))


@query("portfolio_returns", MIXED + f'SELECT date, strategy, {r6("r", chr(34) + "return" + chr(34))} FROM series')
def _mixed(spark, sf_dir):
    return rounded(mixed(spark, sf_dir))


@query("portfolio_performance", MIXED + PERFORMANCE + f"SELECT strategy, {STATS} FROM stats")
def _mixed_performance(spark, sf_dir):
    return rounded(perf.performance(mixed(spark, sf_dir)))


@query("portfolio_growth", MIXED + f"SELECT date, strategy, round(ln(product(1 + r) OVER (PARTITION BY strategy ORDER BY date)), 6) + 0.0 AS log_growth FROM series")
def _growth(spark, sf_dir):
    return rounded(mixed(spark, sf_dir).select("date", "strategy", F.ln(perf.growth()).alias("log_growth")))


@query("pick_by_risk", LONG + PERFORMANCE + f", placed AS (SELECT *, row_number() OVER (ORDER BY av, strategy) AS place, count(*) OVER () AS n FROM stats) SELECT strategy AS ticker, {STATS} FROM placed WHERE place = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1")
def _pick(spark, sf_dir):
    return rounded(perf.by_risk(perf.performance(ticker_returns(spark, sf_dir), "ticker"), 0.5, "ticker"))


@query("top_by_sharpe", LONG + PERFORMANCE + f"SELECT strategy AS ticker, {STATS} FROM stats ORDER BY CASE WHEN av > 0 THEN ar / av ELSE 0 END DESC, strategy LIMIT 4")
def _top(spark, sf_dir):
    return rounded(perf.top(perf.performance(ticker_returns(spark, sf_dir), "ticker"), 4, by="ticker"))


@query("weights_normalised", "SELECT strategy, ticker, round(weight / sum(weight) OVER (PARTITION BY strategy), 6) + 0.0 AS weight FROM (SELECT p_type AS strategy, p_brand AS ticker, sum(p_size)::DOUBLE AS weight FROM part GROUP BY ALL)")
def _normalised(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_type").alias("strategy"), F.col("p_brand").alias("ticker")).agg(F.sum("p_size").cast("double").alias("weight"))
    return rounded(perf.normalised(sizes))


# Covariance and weights.
COV = RETURNS + ", cov AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.r, b.r) AS cov FROM returns a JOIN returns b USING (date) GROUP BY i, j)"


@query("covariance", COV + f"SELECT i, j, {r6('cov', 'cov')} FROM cov")
def _covariance(spark, sf_dir):
    return rounded(cov.covariance(panel_returns(spark, sf_dir)))


GERBER = RETURNS + """, sd AS (SELECT ticker, stddev_samp(r) AS sd FROM returns GROUP BY ticker),
signs AS (SELECT date, ticker, sd, CASE WHEN r >= 0.5 * sd THEN 1 WHEN r <= -0.5 * sd THEN -1 ELSE 0 END AS s FROM returns JOIN sd USING (ticker)),
h AS (SELECT a.ticker AS i, b.ticker AS j, sum(a.s * b.s)::DOUBLE AS h, any_value(a.sd) AS si, any_value(b.sd) AS sj FROM signs a JOIN signs b USING (date) GROUP BY a.ticker, b.ticker),
gerber AS (SELECT h.i, h.j, h.h / sqrt(x.h * y.h) * h.si * h.sj AS cov FROM h JOIN h x ON x.i = h.i AND x.j = h.i JOIN h y ON y.i = h.j AND y.j = h.j)
"""


@query("gerber_covariance", GERBER + f"SELECT i, j, {r6('cov', 'cov')} FROM gerber")
def _gerber(spark, sf_dir):
    return rounded(cov.gerber(panel_returns(spark, sf_dir)))


@query("gerber_signs", RETURNS + f""", sds AS (SELECT ticker, stddev_pop(r) AS sd FROM returns GROUP BY ticker), same AS (SELECT a.ticker AS i, b.ticker AS j, avg(CASE WHEN sign(a.r) * sign(b.r) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM returns a JOIN returns b USING (date) GROUP BY ALL)
SELECT i, j, {r6('greatest(0, least(1, (p - 0.4) / 0.6)) * a.sd * b.sd', 'cov')} FROM same JOIN sds a ON a.ticker = i JOIN sds b ON b.ticker = j""")
def _signs(spark, sf_dir):
    return rounded(cov.gerber_signs(panel_returns(spark, sf_dir), 0.4))


@query("gerber_inverse_variance", GERBER + f"SELECT i AS ticker, {r6('(1 / cov) / sum(1 / cov) OVER ()', 'weight')} FROM gerber WHERE i = j")
def _inverse(spark, sf_dir):
    return rounded(cov.inverse_variance(cov.gerber(panel_returns(spark, sf_dir))))


@query("risk_contributions", COV + f", w AS (SELECT DISTINCT ticker, 1.0::DOUBLE / 6 AS weight FROM returns), parts AS (SELECT i AS ticker, sum(a.weight * cov * b.weight) AS part FROM cov JOIN w a ON a.ticker = i JOIN w b ON b.ticker = j GROUP BY i) SELECT 'Equal' AS strategy, ticker, {r6('part / sum(part) OVER ()', 'share')} FROM parts")
def _contributions(spark, sf_dir):
    returns = panel_returns(spark, sf_dir)
    weights = mix(spark, returns).where("strategy = 'Equal'")
    return rounded(cov.risk_contributions(F.broadcast(weights), cov.covariance(returns)))


@query("tail_mean", MIXED + f", k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY r, date) AS place, count(*) OVER (PARTITION BY strategy) * 0.05::DOUBLE AS k FROM series) SELECT strategy, {r6('-sum(r * greatest(0, least(1, k - place + 1))) / any_value(k)', 'cvar')} FROM k GROUP BY strategy")
def _tail(spark, sf_dir):
    return rounded(cov.tail_mean(mixed(spark, sf_dir)))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns from month to month, calmer than those from day to day."""
    month = F.trunc("date", "month")
    last = bars(spark, sf_dir).groupBy(month.alias("date"), "ticker").agg(F.round(F.avg("adj_close"), 6).alias("price"))
    from ..functions.returns import simple_returns

    return simple_returns(aligned(last))


@query("optimize_all")
def _optimize(spark, sf_dir):
    return rounded(optimize(monthly(spark, sf_dir)), 4)


TICKERS = "SELECT DISTINCT p_type AS ticker FROM part SEMI JOIN lineitem ON l_partkey = p_partkey"
#: Limits that bind: lower and upper bounds and a cap.
BOUND = Constraints(min_weight=0.12, max_weight=0.22, group_caps={"small": (("ECONOMY", "SMALL"), 0.29)})


@query("optimize_conditions", f"SELECT strategy, ticker, 0.0::DOUBLE AS residual FROM ({TICKERS}) CROSS JOIN (VALUES ('GMV'), ('Markowitz_MinVar'), ('RiskParity'), ('bounded'), ('capped')) AS s(strategy)")
def _conditions(spark, sf_dir):
    """How far solutions are from what makes them optimal, by the covariances that Spark makes, to four digits of the
    portfolio's variance: of least variance, without limits and where limits bind; and of equal risk."""
    returns = stored(monthly(spark, sf_dir), "monthly")
    matrix = cov.covariance(returns)
    weights = lambda name, c=Constraints(): optimize(returns, (name,), c).where("ticker IS NOT NULL").select("strategy", "ticker", "weight")
    named = lambda name, c: weights("Markowitz_MinVar", c).withColumn("strategy", F.lit(name))
    boxed = Constraints(min_weight=BOUND.min_weight, max_weight=BOUND.max_weight)
    parts = [
        cov.variance_residuals(weights("GMV"), matrix, -1.0, 1.0), cov.variance_residuals(weights("Markowitz_MinVar"), matrix, 0.0, 1.0),
        cov.variance_residuals(named("bounded", boxed), matrix, boxed.min_weight, boxed.max_weight), cov.variance_residuals(named("capped", BOUND), matrix, BOUND.min_weight, BOUND.max_weight, BOUND.group_caps["small"]),
    ]
    equal = weights("RiskParity")
    shares = cov.risk_contributions(equal, matrix)
    parts.append(shares.select("strategy", "ticker", F.abs(F.col("share") - 1 / F.count("*").over(Window.partitionBy("strategy"))).alias("residual")))
    return rounded(reduce(DataFrame.unionByName, parts), 4)


@query("optimize_constrained")
def _constrained(spark, sf_dir):
    limits = Constraints(min_weight=0.02, max_weight=0.4, group_caps={"small": (("ECONOMY", "SMALL"), 0.3)}, group_floors={"large": (("LARGE",), 0.1)})
    return rounded(optimize(monthly(spark, sf_dir), ("Markowitz_MinVar", "Markowitz_MaxSharpe", "GMV", "MinCVaR", "MinCDaR"), limits), 4)


@query("efficient_set")
def _efficient(spark, sf_dir):
    return rounded(efficient_set(monthly(spark, sf_dir), points=20), 6)


# Backtests: equal weights and inverse variances in SQL, day by day from the same closed form.
WALK = Config()
BACKTEST = RETURNS + f""", dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM returns)), rows AS (SELECT * FROM returns JOIN dates USING (date)),
ks AS (SELECT CAST(k AS INTEGER) AS k, {WALK.lookback} + k * {WALK.every} AS t FROM range(0, 1000) x(k) WHERE {WALK.lookback} + k * {WALK.every} <= (SELECT max(idx) FROM rows)),
v AS (SELECT k, ticker, var_samp(r) AS var FROM rows JOIN ks ON idx >= t - {WALK.lookback} AND idx < t GROUP BY k, ticker),
targets AS (SELECT k, 'Equal' AS strategy, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS weight FROM v UNION ALL SELECT k, 'InverseVariance', ticker, (1 / var) / sum(1 / var) OVER (PARTITION BY k) FROM v),
held AS (SELECT k, strategy, ticker, date, idx, weight * product(1 + r) OVER (PARTITION BY k, strategy, ticker ORDER BY idx) AS held FROM rows JOIN ks ON idx >= t AND idx < t + {WALK.every} JOIN targets USING (k, ticker)),
worth AS (SELECT k, strategy, date, idx, sum(held) AS worth FROM held GROUP BY ALL),
gross AS (SELECT *, worth / coalesce(lag(worth) OVER (PARTITION BY strategy, k ORDER BY idx), 1) - 1 AS gross FROM worth),
ends AS (SELECT h.k + 1 AS k, strategy, ticker, held / worth AS before FROM held h JOIN worth USING (k, strategy, date, idx) WHERE idx = {WALK.lookback} + (h.k + 1) * {WALK.every} - 1),
turnover AS (SELECT k, strategy, sum(abs(weight - coalesce(before, 0))) AS turnover FROM targets LEFT JOIN ends USING (k, strategy, ticker) GROUP BY ALL),
trades AS (SELECT k, strategy, turnover, turnover * {WALK.cost_bps} / 1e4 AS cost, date FROM turnover JOIN ks USING (k) JOIN dates ON idx = t),
series AS (SELECT date, strategy, gross, coalesce(cost, 0) AS cost, gross - coalesce(cost, 0) AS r FROM gross LEFT JOIN trades USING (date, strategy))
"""


def walked(spark: SparkSession, sf_dir: str):
    return backtest(panel_returns(spark, sf_dir), ("Equal", "InverseVariance"), WALK)


@query("backtest_daily", BACKTEST + f'SELECT date, strategy, {r6("gross", "gross")}, {r6("cost", "cost")}, {r6("r", chr(34) + "return" + chr(34))} FROM series')
def _daily(spark, sf_dir):
    return rounded(walked(spark, sf_dir).daily)


@query("backtest_trades", BACKTEST + f"SELECT date, strategy, {r6('turnover', 'turnover')}, {r6('cost', 'cost')}, true AS traded FROM trades")
def _trades(spark, sf_dir):
    return rounded(walked(spark, sf_dir).trades)


@query("backtest_weights", BACKTEST + f"SELECT date, strategy, ticker, {r6('weight', 'weight')} FROM targets JOIN ks USING (k) JOIN dates ON idx = t")
def _weights(spark, sf_dir):
    return rounded(walked(spark, sf_dir).targets)


@query("backtest_curves", BACKTEST + f"SELECT date, strategy, round(ln(product(1 + gross) OVER w), 6) + 0.0 AS gross_log, round(ln(product(1 + r) OVER w), 6) + 0.0 AS log FROM series WINDOW w AS (PARTITION BY strategy ORDER BY date)")
def _curves(spark, sf_dir):
    return rounded(curves(walked(spark, sf_dir)).select("date", "strategy", F.ln("gross_growth").alias("gross_log"), F.ln("growth").alias("log")))


@query(
    "backtest_summary",
    BACKTEST + PERFORMANCE + f""", g AS (SELECT strategy, avg(gross) * 252 AS gross_return, count(*) AS days FROM series GROUP BY strategy), t AS (SELECT strategy, avg(turnover) AS turnover, sum(cost) AS cost, count(*) AS rebalances FROM trades GROUP BY strategy)
SELECT strategy, {STATS}, {r6("gross_return", "gross_return")}, {r6("gross_return - ar", "cost_drag")}, {r6("turnover", "average_turnover")}, {r6("cost", "total_cost")}, rebalances,
{r6("turnover * 252 / CASE WHEN rebalances < 2 THEN 1 ELSE greatest(1, round_even(days / rebalances, 0)) END", "annual_turnover")} FROM stats JOIN g USING (strategy) JOIN t USING (strategy)""",
)
def _summary(spark, sf_dir):
    return rounded(summary(walked(spark, sf_dir), WALK))


@query("backtest_solvers")
def _solvers(spark, sf_dir):
    c = Config(lookback=24, every=6, periods=12)
    return rounded(summary(backtest(monthly(spark, sf_dir), c=c), c), 4)


@query("backtest_turnover_limited")
def _limited(spark, sf_dir):
    c = Config(lookback=24, every=6, periods=12)
    return rounded(backtest(monthly(spark, sf_dir), ("Markowitz_MinVar",), c, Constraints(max_turnover=0.2)).trades, 4)
