"""All queries of the library by name, with the SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.library import BACKTEST_INDICATORS, FACTORS, INDICATORS, SEEDS, TEMPLATES, expand, plugin_factors
from tidemark.functions.series import corr, div, seq
from tidemark.operators import continuous as C
from tidemark.operators import quality as Q
from tidemark.operators import research as R
from tidemark.operators import simulate as S
from tidemark.operators import technical as T
from tidemark.plans.formula import with_formulas
from tidemark.plans.formula_sql import formulas_sql
from tidemark.sources.io import insert_new, latest, upsert
from tidemark.sources.market import BARS_SQL, HOURS_SQL, PANEL_SQL, bars_1d, bars_1h, contract_of, panel_1d, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Decimals of results that are very large or fall on rounding ties.
DIGITS = {"dsl_ts_regression_beta": 5, "factor_mul_ts_sum_amount": -3, "factor_mul_amount_mul": 0}


def _formula_queries(prefix: str, formulas: dict[str, str], together: bool = False, digits: int = 6) -> None:
    groups = {prefix: formulas} if together else {f"{prefix}_{n}": {"factor": f} for n, f in formulas.items()}
    for name, group in groups.items():
        places = DIGITS.get(name, digits)
        QUERIES[name] = lambda spark, d, g=group, n=places: rounded(with_formulas(panel_1d(spark, d), g).select("symbol", "date", *g), n)
        ORACLES[name] = formulas_sql(PANEL_SQL, group, places)


#: One query per function of the formula language.
DSL = {
    "ts_mean": "ts_mean(close, 5)", "ts_std": "ts_std(close, 5)", "ema": "ema(close, 5)", "ts_dema": "ts_dema(close, 5)", "ts_sum": "ts_sum(volume, 5)", "ts_median": "ts_median(close, 5)", "ts_max": "ts_max(high, 5)", "ts_min": "ts_min(low, 5)",
    "ts_midpoint": "ts_midpoint(close, 5)", "ts_inverse_cv": "ts_inverse_cv(close, 5)", "ts_maxmin": "ts_maxmin(close, 5)", "ts_mean_return": "ts_mean_return(close, 5)", "ts_skew": "ts_skew(close, 8)", "ts_kurt": "ts_kurt(close, 8)",
    "ts_delay": "ts_delay(close, 3)", "ts_delta": "ts_delta(close, 3)", "ts_rank": "ts_rank(close, 5)", "ts_zscore": "ts_zscore(close, 5)", "ts_rank_pct": "ts_rank_pct(close, 5)", "ts_mad": "ts_mad(close, 5)", "ts_corr": "ts_corr(close, volume, 8)",
    "ts_cov": "ts_cov(close, volume, 8)", "ts_regression_beta": "ts_regression_beta(close, volume, 8)", "tr": "tr(high, low, close)", "atr": "atr(high, low, close, 5)", "rank": "rank(close)", "zscore": "zscore(close)", "sign": "sign(close - open)",
    "abs": "abs(close - open)", "log": "log(close - 100)", "sqrt": "sqrt(close - open)", "exp": "exp(close / 1000)", "clip": "clip(close - open, -3, 3)", "max_df": "max_df(open, close)", "min_df": "min_df(open, close)",
    "momentum_rank": "rank(close / ts_delay(close, 5) - 1)", "nested": "ts_mean(rank(ts_delta(close, 2)), 3) - abs(open - close) ** 0.5", "arithmetic": "-(high + low) * 2 / (close - open) + volume % 7", "compare": "sign(close - open) * (high - low)",
}
_formula_queries("dsl", DSL)
_formula_queries("indicators", INDICATORS, together=True, digits=5)
_formula_queries("bt_indicators", BACKTEST_INDICATORS, together=True, digits=5)
_formula_queries("factor", FACTORS, digits=4)
_formula_queries("plugin_factors", {k: v for k, v in plugin_factors().items() if k not in ("ax10",)}, together=True, digits=5)
_formula_queries("plugin_ax10", {"ax10": plugin_factors()["ax10"]}, together=True, digits=1)
_formula_queries("seeded_factors", {n: f for n, (_, f) in SEEDS.items()}, together=True, digits=5)
_formula_queries("template_factors", expand(TEMPLATES, [5, 10]), together=True)

# ---------------------------------------------------------------- bars and panel


@query(BARS_SQL)
def bars_daily(spark, d):
    return bars_1d(spark, d)


@query(f"SELECT * REPLACE (CAST(date AS TIMESTAMP) AS date) FROM ({HOURS_SQL})")
def bars_hourly(spark, d):
    return bars_1h(spark, d)


@query(PANEL_SQL)
def panel_dense(spark, d):
    return panel_1d(spark, d)


_W = "OVER (PARTITION BY symbol ORDER BY date"


@query(f"""SELECT *, round(close / lag(close) {_W}) - 1, 6) AS ret_1, round(close / lag(close, 5) {_W}) - 1, 6) AS ret_5, round(close / lag(close, 20) {_W}) - 1, 6) AS ret_20, round(open / lag(close) {_W}) - 1, 6) AS gap,
 round((high - low) / close, 6) AS amplitude, round((close - open) / open, 6) AS intraday_range, round(volume / avg(volume) {_W} ROWS 19 PRECEDING), 6) AS volume_ratio_20,
 CASE WHEN high < low OR close <= 0 THEN 'bad' WHEN amount IS NULL OR volume = 0 THEN 'warning' ELSE 'good' END AS quality FROM ({BARS_SQL})""")
def panel_features(spark, d):
    return rounded(C.panel_features(bars_1d(spark, d)))


def _contracts(spark, d):
    """Bars of every contract: the price moves by 5 per contract number, the main one changes every ten days."""
    b = bars_1d(spark, d).withColumn("contract", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return b.withColumns({c: F.col(c) + 5.0 * F.col("contract") for c in ("open", "high", "low", "close")})


def _rolls(spark, d):
    return C.detect_rolls(bars_1d(spark, d).withColumn("contract", contract_of(F.col("date"))))


_MAIN_SQL = f"SELECT *, CAST(least(floor((day(date) - 1) / 10), 2) AS INT) AS contract FROM ({BARS_SQL})"
_ROLLS_SQL = f"SELECT symbol, date AS effective, old_contract, contract AS new_contract FROM (SELECT *, lag(contract) {_W}) AS old_contract FROM ({_MAIN_SQL})) WHERE old_contract <> contract"
_CONTRACTS_SQL = f"SELECT symbol, date, open + 5.0 * c.contract AS open, high + 5.0 * c.contract AS high, low + 5.0 * c.contract AS low, close + 5.0 * c.contract AS close, volume, amount, c.contract FROM ({BARS_SQL}), (SELECT unnest([0, 1, 2]) AS contract) c"
_SEGS_SQL = f"""SELECT symbol, contract, greatest(coalesce(s, DATE '1900-01-01'), DATE '1900-01-01') AS seg_start, least(coalesce(e, DATE '2100-01-01'), DATE '2100-01-01') AS seg_end FROM (
 SELECT symbol, new_contract AS contract, effective AS s, lead(effective) OVER (PARTITION BY symbol ORDER BY effective) AS e FROM ({_ROLLS_SQL}) UNION ALL
 SELECT symbol, arg_min(old_contract, effective), NULL, min(effective) FROM ({_ROLLS_SQL}) GROUP BY symbol)"""
_CONT_SQL = f"SELECT b.* FROM ({_CONTRACTS_SQL}) b JOIN ({_SEGS_SQL}) s ON b.symbol = s.symbol AND b.contract = s.contract AND b.date >= s.seg_start AND b.date < s.seg_end"
_GAPS_SQL = f"""SELECT r.symbol, r.effective, coalesce((SELECT arg_min(close, date) FROM ({_CONTRACTS_SQL}) b WHERE b.symbol = r.symbol AND b.contract = r.new_contract AND b.date >= r.effective)
 - (SELECT arg_max(close, date) FROM ({_CONTRACTS_SQL}) b WHERE b.symbol = r.symbol AND b.contract = r.old_contract AND b.date < r.effective), 0.0) AS gap FROM ({_ROLLS_SQL}) r"""


def _segs(spark, d):
    return C.segments(_rolls(spark, d), F.to_date(F.lit("1900-01-01")), F.to_date(F.lit("2100-01-01")))


@query(_ROLLS_SQL)
def roll_detection(spark, d):
    return _rolls(spark, d)


@query(_SEGS_SQL)
def roll_segments(spark, d):
    return _segs(spark, d)


@query(_CONT_SQL)
def continuous_bars(spark, d):
    return C.continuous(_contracts(spark, d), _segs(spark, d))


@query(f"SELECT symbol, effective, round(gap, 6) AS gap FROM ({_GAPS_SQL})")
def roll_gaps(spark, d):
    return rounded(C.gaps(_contracts(spark, d), _rolls(spark, d)))


def _adjusted(direction):
    def run(spark, d):
        bars, rolls = _contracts(spark, d), _rolls(spark, d)
        return rounded(C.adjusted(C.continuous(bars, _segs(spark, d)), C.gaps(bars, rolls), direction).select("symbol", "date", "close", "open", "adjustment"), 5)

    return run


for _direction, _cond in (("backward", ">"), ("forward", "<=")):
    QUERIES[f"adjusted_{_direction}"] = _adjusted(_direction)
    ORACLES[f"adjusted_{_direction}"] = f"""SELECT c.symbol, c.date, round(c.close - g, 5) + 0.0 AS close, round(c.open - g, 5) + 0.0 AS open, round(-g, 5) + 0.0 AS adjustment FROM (
 SELECT c.*, coalesce((SELECT sum(gap) FROM ({_GAPS_SQL}) x WHERE x.symbol = c.symbol AND x.effective {_cond} c.date), 0.0) AS g FROM ({_CONT_SQL}) c) c"""


@query(f"SELECT b.symbol, b.date, b.close, r.effective, r.new_contract FROM ({BARS_SQL}) b ASOF LEFT JOIN ({_ROLLS_SQL}) r ON b.symbol = r.symbol AND b.date >= r.effective")
def as_of_roll(spark, d):
    rolls = _rolls(spark, d).withColumn("date", F.col("effective"))
    return C.as_of(bars_1d(spark, d).select("symbol", "date", "close"), rolls, "symbol", "date", ["effective", "new_contract"])


@query("""SELECT event_id, CASE WHEN hour(ts + INTERVAL 8 HOUR) >= 20 THEN CAST(ts + INTERVAL 8 HOUR AS DATE) + 1 ELSE CAST(ts + INTERVAL 8 HOUR AS DATE) END AS trading_date FROM events""")
def trading_dates(spark, d):
    return table(spark, d, "events").select("event_id", C.trading_date(F.col("ts")).alias("trading_date"))


# ---------------------------------------------------------------- factor research


def _research(spark, d):
    f = with_formulas(panel_1d(spark, d), {"momentum": "close / ts_delay(close, 3) - 1", "surge": "volume / ts_mean(volume, 5)", "spread": "(high - low) / close"})
    f = R.forward_returns(f, 1).withColumn("industry", F.substring("symbol", 2, 2).cast("int") % 4)
    return f.withColumn("cap", F.sum("amount").over(Window.partitionBy("symbol")))


_RES_SQL = f"""SELECT *, CAST(substr(symbol, 2, 2) AS INT) % 4 AS industry, sum(amount) OVER (PARTITION BY symbol) AS cap, lead(held) {_W}) / held - 1 AS fwd FROM (
 SELECT *, close / lag(close, 3) {_W}) - 1 AS momentum, volume / avg(volume) {_W} ROWS 4 PRECEDING) AS surge, (high - low) / close AS spread, last_value(close IGNORE NULLS) {_W}) AS held FROM ({PANEL_SQL}))"""
_PAIRS_SQL = f"SELECT * FROM ({_RES_SQL}) WHERE momentum IS NOT NULL AND fwd IS NOT NULL"


def _rank_sql(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date)"


def _ic_sql(method: str, field: str = "momentum") -> str:
    a, b = (_rank_sql(field), _rank_sql("fwd")) if method == "spearman" else (field, "fwd")
    return f"SELECT date, corr(a, b) AS ic FROM (SELECT date, {a} AS a, {b} AS b FROM ({_RES_SQL}) WHERE {field} IS NOT NULL AND fwd IS NOT NULL) GROUP BY date HAVING count(*) >= 3 AND NOT isnan(corr(a, b))"


@query(f"SELECT date, round(ic, 6) AS ic FROM ({_ic_sql('spearman')})")
def ic_spearman(spark, d):
    return rounded(R.daily_ic(_research(spark, d), "momentum"))


@query(f"SELECT date, round(ic, 6) AS ic FROM ({_ic_sql('pearson')})")
def ic_pearson(spark, d):
    return rounded(R.daily_ic(_research(spark, d), "momentum", method="pearson"))


@query(f"SELECT count(ic) AS n_dates, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio FROM ({_ic_sql('spearman')})")
def ic_summary(spark, d):
    return rounded(R.ic_summary(R.daily_ic(_research(spark, d), "momentum")))


_BUCKET_SQL = f"""SELECT p.*, len(list_filter(edges[2:-2], lambda e: e < momentum)) AS bucket FROM ({_PAIRS_SQL}) p JOIN
 (SELECT date, list_sort(list_distinct(quantile_cont(momentum, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM ({_PAIRS_SQL}) GROUP BY date) USING (date)"""
_LAYERS = ", ".join(f"coalesce(avg(fwd) FILTER (WHERE bucket = {k}), 0.0) AS q{k + 1}" for k in range(5))


@query(f"SELECT date, {', '.join(f'round(q{k}, 6) AS q{k}' for k in range(1, 6))}, round(q5 - q1, 6) AS long_short FROM (SELECT date, {_LAYERS} FROM ({_BUCKET_SQL}) GROUP BY date HAVING count(*) >= 5)")
def quantile_layers(spark, d):
    return rounded(R.quantile_returns(_research(spark, d), "momentum"))


@query(f"""SELECT date, round(1 - corr(r, p), 6) AS turnover FROM (SELECT *, lag(r) {_W}) AS p FROM (SELECT symbol, date, CASE WHEN momentum IS NOT NULL THEN {_rank_sql('momentum').replace('ORDER BY momentum', 'ORDER BY momentum NULLS LAST')} END AS r FROM ({_RES_SQL})))
 WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY date HAVING count(*) >= 2 AND NOT isnan(corr(r, p))""")
def factor_turnover(spark, d):
    return rounded(R.turnover(_research(spark, d), "momentum"))


@query(f"SELECT round(avg(share), 6) AS coverage FROM (SELECT symbol, avg(CASE WHEN momentum IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM ({_RES_SQL}) GROUP BY symbol)")
def factor_coverage(spark, d):
    return rounded(R.coverage(_research(spark, d), "momentum"))


_R6 = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {a}" for n, a in names)
_IC_ROW = "SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS pos FROM ({})"
_DAYS_SQL = f"SELECT date, q1, q2, q3, q4, q5, q5 - q1 AS ls FROM (SELECT date, {_LAYERS} FROM ({_BUCKET_SQL}) GROUP BY date HAVING count(*) >= 5)"
_CURVE_SQL = "SELECT date, " + ", ".join(f"product(1 + {c}) OVER (ORDER BY date) - 1 AS {c}" for c in ("q1", "q2", "q3", "q4", "q5", "ls")) + f" FROM ({_DAYS_SQL})"


_REPORT = f"""SELECT start_date, end_date, periods, symbols, r.n AS rank_n_dates, {_R6(("r.mean", "rank_ic_mean"), ("r.std", "rank_ic_std"), ("r.mean / r.std", "rank_icir"), ("r.pos", "rank_positive_ratio"), ("p.mean", "ic_mean"), ("p.std", "ic_std"), ("p.mean / p.std", "icir"), ("p.pos", "positive_ratio"), *[(f"q{k}", f"q{k}_return") for k in range(1, 6)],
 ("ls", "long_short_return"), ("annual", "long_short_annual_return"), ("sharpe", "long_short_sharpe"), ("deepest", "long_short_max_drawdown"), ("turnover", "turnover"), ("coverage", "coverage"))}
 FROM (SELECT min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS periods, count(DISTINCT symbol) AS symbols FROM ({_RES_SQL})), ({_IC_ROW.format(_ic_sql("spearman"))}) r, ({_IC_ROW.format(_ic_sql("pearson"))}) p,
 (SELECT {", ".join(f"arg_max({c}, date) AS {c}" for c in ("q1", "q2", "q3", "q4", "q5", "ls"))} FROM ({_CURVE_SQL})),
 (SELECT avg(step) * 252 AS annual, avg(step) / stddev_samp(step) * sqrt(252) AS sharpe, min((ls - peak) / (1 + peak)) AS deepest FROM (SELECT ls, ls - lag(ls) OVER (ORDER BY date) AS step, max(ls) OVER (ORDER BY date) AS peak FROM ({_CURVE_SQL}))),
 (SELECT coalesce(avg(t), 0) AS turnover FROM (SELECT 1 - corr(r, p) AS t FROM (SELECT *, lag(r) {_W}) AS p FROM (SELECT symbol, date, CASE WHEN momentum IS NOT NULL THEN {_rank_sql("momentum").replace("ORDER BY momentum", "ORDER BY momentum NULLS LAST")} END AS r FROM ({_RES_SQL}))) WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY date HAVING count(*) >= 2 AND NOT isnan(corr(r, p)))),
 (SELECT avg(share) AS coverage FROM (SELECT avg(CASE WHEN momentum IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM ({_RES_SQL}) GROUP BY symbol))"""


# returns of a thousandth, as those of these tables compound beyond what sums of either engine agree on
@query(_REPORT.replace(_RES_SQL, f"SELECT * REPLACE (fwd / 1000 AS fwd) FROM ({_RES_SQL})"))
def factor_report(spark, d):
    return rounded(R.report(_research(spark, d).withColumn("fwd", F.col("fwd") / 1000), "momentum"))



@query(f"SELECT CAST(year(date) AS INT) AS year, round(avg(ic), 6) AS ic_mean FROM ({_ic_sql('spearman')}) GROUP BY 1")
def ic_by_year(spark, d):
    return rounded(R.ic_by_year(R.daily_ic(_research(spark, d), "momentum")))


@query(f"SELECT symbol, date, round(momentum - avg(momentum) OVER (PARTITION BY date, industry), 6) + 0.0 AS neutral FROM ({_RES_SQL})")
def neutral_industry(spark, d):
    return rounded(R.demean_by(_research(spark, d), "momentum", "industry").select("symbol", "date", "neutral"))


_DECILE_SQL = f"SELECT p.*, len(list_filter(edges[2:-2], lambda e: e < amount)) AS bucket FROM ({_RES_SQL}) p JOIN (SELECT date, list_sort(list_distinct(quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM ({_RES_SQL}) GROUP BY date) USING (date) "


@query(f"SELECT symbol, date, round(momentum - avg(momentum) OVER (PARTITION BY date, bucket), 6) + 0.0 AS neutral FROM ({_DECILE_SQL})")
def neutral_size(spark, d):
    return rounded(R.demean_by_decile(_research(spark, d), "momentum", "amount", 5).select("symbol", "date", "neutral"))


_LOGS = f"SELECT *, CASE WHEN momentum IS NOT NULL AND cap > 0 THEN ln(cap) END AS x, CASE WHEN momentum IS NOT NULL AND cap > 0 THEN momentum END AS y FROM ({_RES_SQL})"


@query(f"""SELECT symbol, date, round(CASE WHEN n < 10 THEN momentum ELSE dy - coalesce(slope, 0) * dx END, 6) + 0.0 AS neutral FROM (SELECT *, count(y) OVER (PARTITION BY date) AS n, sum(dx * dy) OVER (PARTITION BY date) / nullif(sum(dx * dx) OVER (PARTITION BY date), 0) AS slope FROM (
 SELECT *, x - avg(x) OVER (PARTITION BY date, industry) AS dx, y - avg(y) OVER (PARTITION BY date, industry) AS dy FROM ({_LOGS})))""")
def neutral_residual(spark, d):
    return rounded(R.residual(_research(spark, d), "momentum", "industry", "cap").select("symbol", "date", "neutral"))


_MOMENTS = ", ".join(f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(("surge", "spread")) for j, b in enumerate(("surge", "spread", "momentum")) if j >= i)


@query(f"""SELECT symbol, date, round(CASE WHEN n < 10 THEN p.momentum WHEN p.momentum IS NOT NULL AND p.surge IS NOT NULL AND p.spread IS NOT NULL THEN p.momentum - my - (s02 * s11 - s12 * s01) / (s00 * s11 - s01 * s01) * (p.surge - m0) - (s12 * s00 - s02 * s01) / (s00 * s11 - s01 * s01) * (p.spread - m1) END, 6) + 0.0 AS neutral
 FROM ({_RES_SQL}) p LEFT JOIN (SELECT date, count(*) AS n, avg(surge) AS m0, avg(spread) AS m1, avg(momentum) AS my, {_MOMENTS} FROM ({_RES_SQL}) WHERE momentum IS NOT NULL AND surge IS NOT NULL AND spread IS NOT NULL GROUP BY date) USING (date)""")
def neutral_regression(spark, d):
    rows = _research(spark, d).select("symbol", "date", "momentum", "surge", "spread")
    return rounded(R.residual_general(rows, "momentum", ["surge", "spread"]).select("symbol", "date", "neutral"))


@query(f"SELECT symbol, date, round((a + b) / 2, 6) AS composite FROM (SELECT symbol, date, {_rank_sql('surge').replace('ORDER BY surge', 'ORDER BY surge NULLS LAST')} AS a, {_rank_sql('spread').replace('ORDER BY spread', 'ORDER BY spread NULLS LAST')} AS b, surge, spread FROM ({_RES_SQL})) WHERE surge IS NOT NULL AND spread IS NOT NULL")
def composite_equal(spark, d):
    return rounded(R.equal_weight(_research(spark, d), ["surge", "spread"]))


def _weighted_sql(f: str) -> str:
    icir = f"SELECT date, lag(i) OVER (ORDER BY date) AS icir FROM (SELECT date, CASE WHEN count(ic) OVER w >= 5 THEN avg(ic) OVER w / (CASE WHEN stddev_samp(ic) OVER w = 0 THEN 1e-8 ELSE stddev_samp(ic) OVER w END) END AS i FROM ({_ic_sql('spearman', f)}) WINDOW w AS (ORDER BY date ROWS 9 PRECEDING))"
    return f"SELECT symbol, date, CASE WHEN {f} IS NOT NULL THEN {_rank_sql(f).replace('ORDER BY ' + f, 'ORDER BY ' + f + ' NULLS LAST')} END * icir AS v FROM ({_RES_SQL}) JOIN ({icir}) USING (date)"


@query(f"SELECT symbol, date, round(a.v + b.v, 5) AS composite FROM ({_weighted_sql('surge')}) a JOIN ({_weighted_sql('spread')}) b USING (symbol, date) WHERE a.v + b.v IS NOT NULL")
def composite_icir(spark, d):
    return rounded(R.icir_weighted(_research(spark, d), ["surge", "spread"]), 5)


@query(f"SELECT symbol, date, (volume >= 15 AND close < 110) OR coalesce({_rank_sql('amount')} >= 0.8, false) AS kept FROM ({BARS_SQL})")
def filter_pipeline(spark, d):
    rows = bars_1d(spark, d).select("symbol", "date", "close", "volume", "amount")
    return R.filter_rows(rows, [("volume", "val:>=15", True), ("close", "val:<110", True), ("amount", "pct:>=0.8", False)]).select("symbol", "date", "kept")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE kept) AS retained, count(*) FILTER (WHERE NOT kept) AS removed, round(avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END), 6) AS retained_share FROM (SELECT (volume >= 15 AND close < 110) OR coalesce({_rank_sql('amount')} >= 0.8, false) AS kept FROM ({BARS_SQL}))")
def filter_statistics(spark, d):
    rows = bars_1d(spark, d).select("symbol", "date", "close", "volume", "amount")
    return rounded(R.filter_statistics(R.filter_rows(rows, [("volume", "val:>=15", True), ("close", "val:<110", True), ("amount", "pct:>=0.8", False)])))


@query(f"SELECT symbol, date, factor, rn FROM (SELECT symbol, date, round(momentum, 6) AS factor, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, symbol) AS rn FROM ({_RES_SQL}) WHERE momentum IS NOT NULL) WHERE rn <= 3")
def top_momentum(spark, d):
    f = with_formulas(panel_1d(spark, d), {"factor": "close / ts_delay(close, 3) - 1"}).where("factor is not null")
    w = Window.partitionBy("date").orderBy(F.desc("factor"), "symbol")
    return rounded(f.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("symbol", "date", "factor", F.col("rn").cast("long").alias("rn")))


@query(f"SELECT round(corr(momentum, surge), 6) AS momentum_surge, round(corr(momentum, spread), 6) AS momentum_spread, round(corr(surge, spread), 6) AS surge_spread FROM ({_RES_SQL}) WHERE momentum IS NOT NULL AND surge IS NOT NULL AND spread IS NOT NULL")
def factor_correlation(spark, d):
    r = _research(spark, d).where("momentum is not null and surge is not null and spread is not null")
    return rounded(r.agg(corr(F.col("momentum"), F.col("surge")).alias("momentum_surge"), corr(F.col("momentum"), F.col("spread")).alias("momentum_spread"), corr(F.col("surge"), F.col("spread")).alias("surge_spread")))


# ---------------------------------------------------------------- simulation


@query(f"""SELECT symbol, date, coalesce(s0 <= l0 AND s > l, false) AS entry, coalesce(s0 >= l0 AND s < l, false) AS exit FROM (SELECT symbol, date, s, l, lag(s) {_W}) AS s0, lag(l) {_W}) AS l0 FROM (
 SELECT symbol, date, CASE WHEN count(close) {_W} ROWS 2 PRECEDING) >= 3 THEN avg(close) {_W} ROWS 2 PRECEDING) END AS s, CASE WHEN count(close) {_W} ROWS 6 PRECEDING) >= 7 THEN avg(close) {_W} ROWS 6 PRECEDING) END AS l FROM ({BARS_SQL})))""")
def cross_signals(spark, d):
    return S.ma_cross_signals(bars_1d(spark, d), 3, 7).select("symbol", "date", "entry", "exit")


@query(f"""SELECT w AS window_id, (SELECT date FROM n WHERE i = 0) AS train_start, (SELECT date FROM n WHERE i = w * 5 + 9) AS train_end, (SELECT date FROM n WHERE i = w * 5 + 10) AS test_start, (SELECT date FROM n WHERE i = w * 5 + 14) AS test_end
 FROM (SELECT CAST(unnest(range(0, (SELECT count(*) - 15 FROM n) // 5 + 1)) AS INT) AS w)""".replace("SELECT w AS", f"WITH n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ({BARS_SQL}))) SELECT w AS", 1))
def walk_forward(spark, d):
    return S.walk_forward_windows(bars_1d(spark, d), 10, 5, 5)


_GRID = f"SELECT b.*, s.short, l.long, s.short || '_' || l.long AS param_id FROM ({BARS_SQL}) b, (SELECT unnest([2, 3, 5]) AS short) s, (SELECT unnest([7, 10]) AS long) l"
_GW = "OVER (PARTITION BY param_id, symbol ORDER BY date"
_GRID_RESULT = f"""SELECT param_id, short, long, symbol, sum(ret) AS total, sum(held) AS bars_in FROM (SELECT *, coalesce((close / lag(close) {_GW}) - 1) * lag(held) {_GW}), 0) AS ret FROM (
 SELECT *, CASE WHEN len(h) >= long AND list_avg(h[-short:]) > list_avg(h[-long:]) THEN 1 ELSE 0 END AS held FROM (SELECT *, list(close) {_GW} ROWS UNBOUNDED PRECEDING) AS h FROM ({_GRID})))) GROUP BY ALL"""


def _grid_result(spark, d):
    return S.grid_cross_returns(bars_1d(spark, d), S.grid(spark, short=[2, 3, 5], long=[7, 10]))


@query(f"SELECT param_id, short, long, symbol, round(total, 6) + 0.0 AS total, CAST(bars_in AS BIGINT) AS bars_in FROM ({_GRID_RESULT})")
def grid_search(spark, d):
    return rounded(_grid_result(spark, d))


@query(f"SELECT param, value, round(avg(total), 6) AS mean_score FROM (SELECT 'short' AS param, short AS value, total FROM ({_GRID_RESULT}) UNION ALL SELECT 'long', long, total FROM ({_GRID_RESULT})) GROUP BY ALL")
def grid_sensitivity(spark, d):
    r = _grid_result(spark, d)
    long = r.select(F.explode(F.array(F.struct(F.lit("short").alias("param"), F.col("short").alias("value")), F.struct(F.lit("long").alias("param"), F.col("long").alias("value")))).alias("p"), "total")
    return rounded(long.groupBy("p.param", "p.value").agg(F.avg("total").alias("mean_score")))


_POP = f"SELECT param_id, round(avg(total), 6) AS gain, round(-stddev_pop(total), 6) AS calm FROM ({_GRID_RESULT}) GROUP BY param_id"


@query(f"WITH p AS ({_POP}) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.gain >= a.gain AND b.calm >= a.calm AND (b.gain > a.gain OR b.calm > a.calm))")
def pareto_front(spark, d):
    pop = rounded(_grid_result(spark, d).groupBy("param_id").agg(F.avg("total").alias("gain"), (-F.stddev_pop("total")).alias("calm")))
    return T.pareto_front(pop, "param_id", ["gain", "calm"])


# ---------------------------------------------------------------- technical analysis


@query(f"""SELECT symbol, date, n = 7 AND high = mh AS pivot_high, n = 7 AND low = ml AS pivot_low FROM (SELECT *, count(*) OVER w AS n, max(high) OVER w AS mh, min(low) OVER w AS ml FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""")
def pivots(spark, d):
    return T.pivots(bars_1d(spark, d), 3).select("symbol", "date", "pivot_high", "pivot_low")


@query(f"""SELECT symbol, date, coalesce(pc < po AND close > open AND close >= po AND open <= pc, false) AS bullish_engulfing, coalesce(high < ph AND low > pl, false) AS inside_bar, coalesce(high > low AND abs(close - open) <= 0.1 * (high - low), false) AS doji,
 coalesce(high > low AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open), false) AS hammer FROM (SELECT *, lag(open) {_W}) AS po, lag(close) {_W}) AS pc, lag(high) {_W}) AS ph, lag(low) {_W}) AS pl FROM ({BARS_SQL}))""")
def candles(spark, d):
    return T.candles(bars_1d(spark, d)).select("symbol", "date", "bullish_engulfing", "inside_bar", "doji", "hammer")


@query(f"""SELECT symbol, close, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma20, 6) AS ma20, CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 'up' WHEN ma5 < ma10 AND ma10 < ma20 THEN 'down' ELSE 'sideways' END AS trend FROM (
 SELECT *, avg(close) {_W} ROWS 4 PRECEDING) AS ma5, avg(close) {_W} ROWS 9 PRECEDING) AS ma10, avg(close) {_W} ROWS 19 PRECEDING) AS ma20, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM ({BARS_SQL})) WHERE rn = 1""")
def trend(spark, d):
    return rounded(T.trend(bars_1d(spark, d)))


@query(f"""SELECT symbol, date, close, CASE WHEN close > top THEN 'up' ELSE 'down' END AS side, coalesce(CASE WHEN close > top THEN nxt < top ELSE nxt > floor_ END, false) AS fakeout FROM (
 SELECT *, max(high) OVER b AS top, min(low) OVER b AS floor_, avg(volume) OVER b AS usual, lead(close) {_W}) AS nxt FROM ({BARS_SQL}) WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE (close > top OR close < floor_) AND volume > usual""")
def breakouts(spark, d):
    return T.breakouts(bars_1d(spark, d), 5)


@query(f"SELECT symbol, date, CAST(greatest(0, floor(least(2000.0 / nullif(abs(close - low) * 10, 0), 50000.0 / nullif(close * 10, 0)))) AS BIGINT) AS lots FROM ({BARS_SQL})")
def position_sizes(spark, d):
    return bars_1d(spark, d).select("symbol", "date", T.position_size(100_000.0, "balanced", F.col("close"), F.col("low")).alias("lots"))


# ---------------------------------------------------------------- quality and catalog


@query(f"SELECT symbol, date, concat_ws('|', CASE WHEN high < low THEN 'high_lt_low' END, CASE WHEN high < greatest(open, close) THEN 'high_below_oc' END, CASE WHEN low > least(open, close) THEN 'low_above_oc' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' END) AS anomaly FROM (SELECT * REPLACE (high - 0.2 AS high) FROM ({BARS_SQL}))")
def ohlc_anomalies(spark, d):
    return bars_1d(spark, d).withColumn("high", F.col("high") - 0.2).select("symbol", "date", Q.anomaly().alias("anomaly"))


@query(f"WITH b AS ({HOURS_SQL}), days AS (SELECT DISTINCT symbol, CAST(date AS DATE) AS date FROM b WHERE day(date) % 7 <> 3), span AS (SELECT symbol, min(date) AS a, max(date) AS z FROM days GROUP BY symbol) SELECT symbol, date FROM (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM span) ANTI JOIN days USING (symbol, date) WHERE dayofweek(date) BETWEEN 1 AND 5")
def missing_weekdays(spark, d):
    days = bars_1h(spark, d).select("symbol", F.to_date("date").alias("date")).distinct()
    return Q.missing_dates(days.where(F.dayofmonth("date") % 7 != 3))


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_surplus(spark, d):
    return Q.surplus(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, count(*) AS n_rows, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, count(DISTINCT CAST(ts AS DATE)) AS n_dates FROM events GROUP BY user_id")
def catalog_coverage(spark, d):
    return Q.coverage(table(spark, d, "events").withColumn("date", F.to_date("ts")), ["user_id"])


_BAD_ROW = "NOT coalesce(low >= 0 AND high >= greatest(open, close, low) AND low <= least(open, close), false)"
_GAPS = f"SELECT count(*) FROM (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, min(date) AS a, max(date) AS z FROM ({BARS_SQL}) GROUP BY symbol)) ANTI JOIN ({BARS_SQL}) USING (symbol, date) WHERE dayofweek(date) BETWEEN 1 AND 5"
_CHECKS = f"""SELECT 'ohlc' AS "check", 'bad' AS severity, (SELECT count(*) FROM ({BARS_SQL}) WHERE {_BAD_ROW}) AS count UNION ALL SELECT 'no_volume', 'warning', (SELECT count(*) FROM ({BARS_SQL}) WHERE coalesce(volume, 0) <= 0)
 UNION ALL SELECT 'duplicate', 'bad', (SELECT count(*) FROM (SELECT symbol, date FROM ({BARS_SQL}) GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'missing_weekday', 'info', ({_GAPS})"""


@query(_CHECKS)
def quality_checks(spark, d):
    return Q.checks(bars_1d(spark, d))


@query(f"SELECT score, CASE WHEN bad = 1 THEN 'bad' WHEN score < 90 THEN 'warning' ELSE 'good' END AS status FROM (SELECT CAST(greatest(0, 100 - sum(CASE WHEN count > 0 THEN CASE severity WHEN 'bad' THEN 30 WHEN 'warning' THEN 12 ELSE 3 END ELSE 0 END)) AS INT) AS score, max(CASE WHEN severity = 'bad' AND count > 0 THEN 1 ELSE 0 END) AS bad FROM ({_CHECKS}))")
def quality_score(spark, d):
    return Q.score(Q.checks(bars_1d(spark, d)))


@query("SELECT doc_id, regexp_matches(replace(text, 'é', 'Ã©'), 'Ã[\u0080-¿]|â€|\ufffd|锟斤拷') AS broken FROM documents WHERE text IS NOT NULL")
def text_marks(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", Q.mojibake(F.replace("text", F.lit("é"), F.lit("Ã©"))).alias("broken"))


# ---------------------------------------------------------------- relational family


@query("""SELECT c_custkey, c_name, n_name, r_name, o.o_orderkey, o.o_totalprice FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) o ON o.o_custkey = c_custkey AND rn = 1""")
def latest_order(spark, d):
    dims = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    last = latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey"))
    return dims.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_name", "r_name", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    r = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return r.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(DISTINCT o_custkey) AS customers, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS finished_share, round(avg(o_totalprice), 4) AS mean_price FROM orders")
def conditional_counts(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.countDistinct("o_custkey").alias("customers"), F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6).alias("finished_share"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("WITH b AS (SELECT max(CAST(ts AS DATE)) AS z FROM events) SELECT day, count(event_id) AS n FROM (SELECT CAST(unnest(generate_series(z - 9, z + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM b) LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day")
def zero_filled_days(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = e.agg(F.max("day").alias("z")).select(F.explode(F.sequence(F.date_sub("z", 9), F.date_add("z", 3))).alias("day"))
    return days.join(e, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def orders_with_large_lines(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return table(spark, d, "orders").where("o_orderstatus = 'O'").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1%' OR p_brand ILIKE '%brand#2%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
def search_page(spark, d):
    p = table(spark, d, "part").where(F.col("p_name").ilike("%1%") | F.col("p_brand").ilike("%brand#2%"))
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(20).select("p_partkey", "p_name")


@query("SELECT * FROM (SELECT event_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts")
def latest_ascending(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("t"))
    return e.join(F.broadcast(least), F.col("event_type") == F.col("t")).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts").select("event_id", "ts", "value")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_operations(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()
    return a.subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    r = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.max("value").alias("top"))
    return r.select("event_type", "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "top")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_groups(spark, d):
    return table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_custkey, upper(trim(c_name)) AS name, substr(c_mktsegment, 1, 4) AS seg, regexp_extract(c_name, '([0-9]+)', 1) AS digits, md5(c_name) AS key FROM customer")
def string_functions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper(F.trim("c_name")).alias("name"), F.substring("c_mktsegment", 1, 4).alias("seg"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"), F.md5("c_name").alias("key"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month, dayofweek(o_orderdate) AS dow, weekofyear(o_orderdate) AS week FROM orders")
def date_functions(spark, d):
    m = F.date_trunc("month", "o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", m.alias("month"), F.add_months(m, 1).alias("next_month"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("dow"), F.weekofyear("o_orderdate").cast("long").alias("week"))


@query("SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS recent FROM orders")
def sliding_rate(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("_s").rangeBetween(-2592000, 0)
    return table(spark, d, "orders").withColumn("_s", F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("recent"))


@query("""SELECT user_id, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, bad, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, bad ORDER BY ts) AS grp FROM (SELECT *, value > 60 AS bad FROM events)) WHERE bad GROUP BY ALL) GROUP BY user_id""")
def breaker_streaks(spark, d):
    e = table(spark, d, "events").withColumn("bad", F.col("value") > 60)
    w, v = Window.partitionBy("user_id").orderBy("ts"), Window.partitionBy("user_id", "bad").orderBy("ts")
    r = e.withColumn("grp", F.row_number().over(w) - F.row_number().over(v)).where("bad").groupBy("user_id", "grp").count()
    return r.groupBy("user_id").agg(F.max("count").alias("longest"))


@query("SELECT user_id, ts, CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER w >= 5 AND count(*) OVER w = 10 AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS 9 PRECEDING)")
def breaker_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-9, 0)
    fails = F.sum(F.when(F.col("value") > 60, 1).otherwise(0)).over(w)
    return table(spark, d, "events").select("user_id", "ts", fails.alias("failures"), ((fails >= 5) & (F.count(F.lit(1)).over(w) == 10)).alias("open"))


_OLD = "SELECT o_orderkey, o_totalprice, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0"


def _old_new(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice", F.lit(0).alias("seq")), o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("seq"))


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE o_orderkey % 2 <> 0")
def upsert_orders(spark, d):
    return upsert(*_old_new(spark, d), ["o_orderkey"], "seq")


@query(f"SELECT * FROM ({_NEW}) WHERE o_orderkey % 3 = 0")
def insert_new_orders(spark, d):
    return insert_new(*_old_new(spark, d), ["o_orderkey"], "seq")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def dedupe_first_wins(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return latest(c, ["text"], F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "text")


@query(f"SELECT symbol, date, round(close - open, 6) + 0.0 AS pnl, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS direction, round((close - open) / open * 100, 6) + 0.0 AS pct FROM ({BARS_SQL})")
def pnl_direction(spark, d):
    b = bars_1d(spark, d)
    return rounded(b.select("symbol", "date", (F.col("close") - F.col("open")).alias("pnl"), F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat").alias("direction"), (div(F.col("close") - F.col("open"), F.col("open")) * 100).alias("pct")))


@query(f"SELECT symbol, date, round(exp(sum(ln(1 + r)) {_W} ROWS UNBOUNDED PRECEDING)) - 1, 6) + 0.0 AS cumulative FROM (SELECT symbol, date, coalesce(close / lag(close) {_W}) - 1, 0) AS r FROM ({BARS_SQL}))")
def cumulative_return(spark, d):
    r = bars_1d(spark, d).withColumn("_r", F.coalesce(div(F.col("close"), F.lag("close").over(seq())) - 1, F.lit(0.0)))
    return rounded(r.select("symbol", "date", (F.product(1 + F.col("_r")).over(seq().rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("cumulative")))
