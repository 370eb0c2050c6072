"""Queries of simulation, scores and technical analysis, added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.library import INDICATORS
from tidemark.functions.series import seq
from tidemark.operators import analysis as A
from tidemark.operators import desk as D
from tidemark.operators import simulate as S
from tidemark.operators import strategy
from tidemark.operators import technical as T
from tidemark.plans.formula import with_formulas
from tidemark.plans.formula_sql import with_formulas_sql
from tidemark.queries import query, rounded
from tidemark.sources.io import latest
from tidemark.sources.market import BARS_SQL, HOURS_SQL, bars_1d, bars_1h

RULES = S.Rules(stop=("percent_below", 0.3), target=("risk_reward_ratio", 2.0))
SHORT = S.Rules(direction="short")
_W = "OVER (PARTITION BY symbol ORDER BY date"


def r6(*names: str) -> str:
    """``round(x, 6) AS name`` of each "x AS name", or of a plain name."""
    return ", ".join(f"round({n.rpartition(' AS ')[0] or n}, 6) + 0.0 AS {n.rpartition(' AS ')[2]}" for n in names)


# ---------------------------------------------------------------- backtests


def ma_sql(n: int) -> str:
    return f"CASE WHEN count(close) {_W} ROWS {n - 1} PRECEDING) >= {n} THEN avg(close) {_W} ROWS {n - 1} PRECEDING) END"


def cross_sql(source: str, short: int, long: int, up: str = "entry", down: str = "leave") -> str:
    return f"""SELECT *, coalesce(s0 <= l0 AND s > l, false) AS {up}, coalesce(s0 >= l0 AND s < l, false) AS {down} FROM (SELECT *, lag(s) {_W}) AS s0, lag(l) {_W}) AS l0 FROM (SELECT *, {ma_sql(short)} AS s, {ma_sql(long)} AS l FROM ({source})))"""


def walk_sql(signals: str, stop: float | None = 0.3, reward: float = 2.0, sign: int = 1, date: str = "DATE", size: int = 10, fee: float = 0.0001) -> str:
    """A backtest as a recursion over a symbol's bars: one step per bar, its state the open position and the cash."""
    level = f"(w.held * {1 - (stop or 0)})"
    reason = "CASE WHEN w.held IS NULL THEN NULL" + (f" WHEN s.low <= {level} THEN 'stop_loss' WHEN s.high >= w.held + abs(w.held - {level}) * {reward} THEN 'take_profit'" if stop else "") + " WHEN s.x0 THEN 'signal' END"
    price = f"CASE reason WHEN 'stop_loss' THEN least(open, was * {1 - (stop or 0)}) WHEN 'take_profit' THEN greatest(open, was + abs(was - was * {1 - (stop or 0)}) * {reward}) WHEN 'signal' THEN open END"
    nothing = f"CAST(NULL AS {date}) AS entry_date, CAST(NULL AS DOUBLE) AS entry_price, CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS DOUBLE) AS pnl, CAST(NULL AS DOUBLE) AS fee, CAST(NULL AS VARCHAR) AS reason"
    return f"""SELECT symbol, date, cash + CASE WHEN held IS NULL THEN 0 ELSE {sign} * (close - held) * {size} END AS equity, close, entry_date, entry_price, exit_price, pnl, fee, reason FROM (
 WITH RECURSIVE s AS (SELECT symbol, date, open, high, low, close, row_number() {_W}) AS rn, lag(entry) {_W}) AS e0, lag(leave) {_W}) AS x0 FROM ({signals})),
 w AS (SELECT symbol, date, rn, close, CAST(NULL AS DOUBLE) AS held, CAST(NULL AS {date}) AS since, CAST(100000 AS DOUBLE) AS cash, {nothing} FROM s WHERE rn = 1
  UNION ALL SELECT symbol, date, rn, close, CASE WHEN was IS NULL THEN CASE WHEN e0 THEN open END WHEN reason IS NULL THEN was END, CASE WHEN was IS NULL THEN CASE WHEN e0 THEN date END WHEN reason IS NULL THEN since END,
   cash + coalesce({sign} * (px - was) * {size} - (px + was) * {size} * {fee}, 0), CASE WHEN reason IS NOT NULL THEN since END, CASE WHEN reason IS NOT NULL THEN was END, px, {sign} * (px - was) * {size} - (px + was) * {size} * {fee}, (px + was) * {size} * {fee}, reason
   FROM (SELECT *, {price} AS px FROM (SELECT s.*, w.held AS was, w.since, w.cash, {reason} AS reason FROM w JOIN s ON s.symbol = w.symbol AND s.rn = w.rn + 1)))
 SELECT * FROM w WHERE rn > 1)"""


_SCORE = "CASE WHEN trade_count = 0 THEN 0 ELSE CAST(round_even(least(greatest(50 + least(greatest(total_return_pct, -30), 50) * 0.5 - least(max_drawdown_pct, 40) * 0.7 + least(profit_factor, 3) * 4 + (least(greatest(win_rate_pct, 30), 70) - 50) * 0.1 - CASE WHEN trade_count < 3 THEN 15 WHEN trade_count < 5 THEN 5 ELSE 0 END, 0), 100), 0) AS INT) END AS score"


def metrics_sql(run: str, cash: float = 100_000.0) -> str:
    return f"""SELECT *, {_SCORE} FROM (SELECT symbol, (arg_max(equity, date) / {cash} - 1) * 100 AS total_return_pct, CASE WHEN arg_max(equity, date) <= 0 THEN -100.0 ELSE (pow(arg_max(equity, date) / {cash}, 252.0 / count(*)) - 1) * 100 END AS annualized_return_pct, -min(dd) * 100 AS max_drawdown_pct,
 coalesce(avg(r) / (stddev_pop(r) + 1e-12) * sqrt(252), 0.0) AS sharpe, count(reason) AS trade_count, coalesce(100.0 * count(*) FILTER (WHERE pnl > 0) / nullif(count(reason), 0), 0.0) AS win_rate_pct, coalesce(100.0 * count(*) FILTER (WHERE pnl < 0) / nullif(count(reason), 0), 0.0) AS loss_rate_pct,
 coalesce(sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0), CAST(count(*) FILTER (WHERE pnl > 0) AS DOUBLE)) AS profit_factor, coalesce(avg(pnl) FILTER (WHERE pnl > 0) / nullif(abs(avg(pnl) FILTER (WHERE pnl < 0)), 0), CAST(count(*) FILTER (WHERE pnl > 0) AS DOUBLE)) AS profit_loss_ratio, coalesce(sum(fee), 0.0) AS total_fee, coalesce(avg(fee), 0.0) AS mean_fee
 FROM (SELECT *, equity / max(equity) {_W}) - 1 AS dd, equity / lag(equity) {_W}) - 1 AS r FROM ({run})) GROUP BY symbol)"""


METRICS = ("total_return_pct", "annualized_return_pct", "max_drawdown_pct", "sharpe", "win_rate_pct", "loss_rate_pct", "profit_factor", "profit_loss_ratio", "total_fee", "mean_fee")
_RUN_SQL = walk_sql(cross_sql(BARS_SQL, 3, 7))
_TRADES = f"SELECT symbol, entry_date, date AS exit_date, {r6('entry_price', 'exit_price', 'pnl', 'fee')}, reason FROM ({{}}) WHERE reason IS NOT NULL"


def _run(spark, d, short=3, long=7):
    return S.backtest(S.with_atr(S.ma_cross_signals(bars_1d(spark, d), short, long)), RULES)


def _metrics(spark, d, short=3, long=7):
    return S.equity_metrics(_run(spark, d, short, long), RULES.initial_cash)


@query(_TRADES.format(_RUN_SQL))
def backtest_trades(spark, d):
    return rounded(S.trades_of(_run(spark, d)))


@query(_TRADES.format(walk_sql(cross_sql(BARS_SQL, 3, 7, "leave", "entry"), None, sign=-1)))
def backtest_short(spark, d):
    return rounded(S.backtest_trades(S.ma_cross_signals(bars_1d(spark, d), 3, 7, "short"), SHORT))


@query(f"SELECT symbol, trade_count, score, {r6(*METRICS)} FROM ({metrics_sql(_RUN_SQL)})")
def backtest_metrics(spark, d):
    return rounded(_metrics(spark, d))


@query(f"SELECT symbol, period, {r6('equity', 'equity / lag(equity) OVER (PARTITION BY symbol ORDER BY period) - 1 AS period_return')} FROM (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS period, arg_max(equity, date) AS equity FROM ({_RUN_SQL}) GROUP BY ALL)")
def backtest_weeks(spark, d):
    return rounded(S.period_returns(_run(spark, d), "week"))


@query(f"SELECT symbol, max(n) AS longest_loss FROM (SELECT symbol, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_date) - row_number() OVER (PARTITION BY symbol, pnl < 0 ORDER BY entry_date) AS g FROM ({_RUN_SQL}) WHERE reason IS NOT NULL) WHERE pnl < 0 GROUP BY ALL) GROUP BY symbol")
def backtest_streaks(spark, d):
    return S.streaks(S.trades_of(_run(spark, d)))


_DAYS = "datediff('day', entry_date, CASE WHEN reason IS NOT NULL THEN date END)"


@query(f"""SELECT symbol, {r6('annual / nullif(-dd * 100, 0) AS calmar', 'CASE WHEN down > 0 THEN mean / (down + 1e-12) * sqrt(252) END AS sortino', '(grown - held) * 100 AS excess_return_pct', 'CASE WHEN dev > 0 THEN act / (dev + 1e-12) * sqrt(252) END AS information_ratio', 'days AS mean_hold_days')} FROM (
 SELECT symbol, CASE WHEN grown > 0 THEN (pow(grown, 252.0 / n) - 1) * 100 ELSE -100.0 END AS annual, * EXCLUDE (symbol) FROM (SELECT symbol, arg_max(equity, date) / 100000.0 AS grown, arg_max(close, date) / arg_min(close, date) AS held, count(*) AS n, min(dd) AS dd, avg(r) AS mean, stddev_pop(r) FILTER (WHERE r < 0) AS down, avg(r - b) AS act, stddev_pop(r - b) AS dev, avg({_DAYS}) AS days
 FROM (SELECT *, equity / max(equity) {_W}) - 1 AS dd, equity / lag(equity) {_W}) - 1 AS r, close / lag(close) {_W}) - 1 AS b FROM ({_RUN_SQL})) GROUP BY symbol))""")
def risk_ratios(spark, d):
    return rounded(D.risk_ratios(_run(spark, d), RULES.initial_cash))


@query(f"SELECT symbol, date, {r6('equity / lag(equity, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS year_return')} FROM ({_RUN_SQL})")
def rolling_return(spark, d):
    return rounded(D.rolling_year(_run(spark, d), 5))


_STRATEGY = {"entry": {"conditions": [{"indicator": "sma3", "operator": "cross_above", "indicator2": "sma7"}, {"indicator": "volume", "operator": "above", "indicator2": "volume_sma5", "multiply_value": 0.9}]}, "exit": {"conditions": [{"indicator": "close", "operator": "below", "indicator2": "sma7"}, {"indicator": "close", "operator": "between", "value": [95, 96]}], "logic": "or"}}
_SIGNALS = f"""SELECT *, coalesce(s0 <= l0 AND s > l AND volume > 0.9 * v, false) AS entry, coalesce(close < l, false) OR (close > 95 AND close < 96) AS leave FROM (SELECT *, lag(s) {_W}) AS s0, lag(l) {_W}) AS l0 FROM (
 SELECT *, {ma_sql(3)} AS s, {ma_sql(7)} AS l, CASE WHEN count(volume) {_W} ROWS 4 PRECEDING) >= 5 THEN avg(volume) {_W} ROWS 4 PRECEDING) END AS v FROM ({{}})))"""


@query(_TRADES.format(walk_sql(_SIGNALS.format(BARS_SQL))))
def strategy_backtest(spark, d):
    return rounded(S.backtest_trades(strategy.signals(bars_1d(spark, d), _STRATEGY), RULES))


# ---------------------------------------------------------------- futures account

CONTRACT = S.Contract(fee_per_lot=1.0, tick=0.2, slippage_ticks=1)
_ACCOUNT_SQL = f"""WITH RECURSIVE s AS (SELECT symbol, date, open, close, row_number() {_W}) AS rn, entry, leave FROM ({cross_sql(BARS_SQL, 3, 7)})),
 w AS (SELECT symbol, date, rn, close, CASE WHEN entry THEN 2 ELSE 0 END AS target, 0 AS before, 0 AS lots, CAST(0 AS DOUBLE) AS price, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS realized, CAST(0 AS DOUBLE) AS fee, CAST(NULL AS DOUBLE) AS fill, 0 AS closed, CAST(NULL AS DATE) AS since, CAST(NULL AS DATE) AS entry_date, CAST(NULL AS DOUBLE) AS entry_price FROM s WHERE rn = 1
  UNION ALL SELECT symbol, date, rn, close, CASE WHEN target = 0 AND entry THEN 2 WHEN target <> 0 AND leave THEN 0 ELSE target END, lots, want, CASE WHEN want = 0 THEN 0 WHEN lots = 0 THEN f WHEN want > lots THEN (price * lots + f * (want - lots)) / want ELSE price END, cash + won - cost, won, cost, CASE WHEN want <> lots THEN f END, gone,
   CASE WHEN want = 0 THEN NULL WHEN lots = 0 THEN date ELSE since END, CASE WHEN gone > 0 THEN since END, CASE WHEN gone > 0 THEN price END
   FROM (SELECT *, gone * (f - price) * 10 AS won, abs(want - lots) * 1.0 AS cost FROM (SELECT *, open + sign(want - lots) * 0.2 AS f, CASE WHEN want < lots THEN lots - want ELSE 0 END AS gone FROM (
    SELECT s.*, w.target, w.lots, w.price, w.cash, w.since, CAST(least(w.target, greatest(0, floor((w.cash + w.lots * (s.open - w.price) * 10) / (s.open * 10 * 0.1)))) AS INT) AS want FROM w JOIN s ON s.symbol = w.symbol AND s.rn = w.rn + 1))))
 SELECT symbol, date, close, before, CAST(lots AS BIGINT) AS lots, cash + lots * (close - price) * 10 AS equity, lots * close * 10 * 0.1 AS margin, realized, fee, fill, CAST(closed AS BIGINT) AS closed, entry_date, entry_price FROM w"""


def _account(spark, d):
    return S.futures_account(S.ma_cross_signals(bars_1d(spark, d), 3, 7), CONTRACT, S.Account(), 2)


@query(f"SELECT symbol, date, lots, closed, {r6('close', 'equity', 'margin', 'realized', 'fee', 'fill', 'entry_price')}, entry_date, CAST(NULL AS VARCHAR) AS reason FROM ({_ACCOUNT_SQL})")
def futures_account(spark, d):
    return rounded(_account(spark, d))


@query(f"SELECT symbol, date, CAST(before AS BIGINT) AS before, lots, CAST(abs(lots - before) AS BIGINT) AS traded, {r6('fill', 'fee')}, 'signal' AS reason FROM ({_ACCOUNT_SQL}) WHERE lots <> before")
def futures_orders(spark, d):
    return rounded(S.futures_orders(_account(spark, d)))


@query(f"SELECT symbol, entry_date, date AS exit_date, 'long' AS side, closed AS lots, {r6('entry_price', 'fill AS exit_price', 'realized AS pnl')}, 'signal' AS reason FROM ({_ACCOUNT_SQL}) WHERE closed > 0")
def futures_trades(spark, d):
    return rounded(S.futures_trades(_account(spark, d)))


_ACCOUNT_RUN = f"SELECT symbol, date, equity, fee, CASE WHEN closed > 0 THEN realized END AS pnl, CASE WHEN closed > 0 THEN 'signal' END AS reason FROM ({_ACCOUNT_SQL})"


@query(f"SELECT symbol, trade_count, score, {r6(*METRICS)} FROM ({metrics_sql(_ACCOUNT_RUN)})")
def futures_metrics(spark, d):
    return rounded(S.futures_metrics(_account(spark, d), 100_000.0))


# ---------------------------------------------------------------- optimisation, walk-forward, scores

_SETS = [(a, b) for a in (2, 3, 5) for b in (7, 10)]
_OPTIMISED = " UNION ALL ".join(f"SELECT '{a}_{b}' AS param_id, * FROM ({metrics_sql(walk_sql(cross_sql(BARS_SQL, a, b)))})" for a, b in _SETS)
_COMPOSITE = "0.4 * sharpe + 0.3 * total_return_pct - 0.2 * max_drawdown_pct + 0.1 * win_rate_pct - CASE WHEN trade_count < 3 THEN 20 WHEN trade_count < 5 THEN 5 ELSE 0 END"


@query(f"SELECT symbol, place, param_id, trade_count, {r6('composite', 'sharpe')} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY composite DESC, param_id) AS INT) AS place FROM (SELECT *, round({_COMPOSITE}, 9) AS composite FROM ({_OPTIMISED}))) WHERE place <= 3")
def optimise_cross(spark, d):
    scored = S.optimise_cross(bars_1d(spark, d), S.grid(spark, short=[2, 3, 5], long=[7, 10]), RULES)
    best = S.best_parameters(scored.withColumn("composite", F.round("composite", 9)), 3)
    return rounded(best.select("symbol", "place", "param_id", "trade_count", "composite", "sharpe"))


_TEMPLATE = {"entry": {"conditions": [{"indicator": "sma{short}", "operator": "cross_above", "indicator2": "sma{long}"}]}, "exit": {"conditions": [{"indicator": "sma{short}", "operator": "cross_below", "indicator2": "sma{long}"}]}}


@query(f"SELECT symbol, param_id, trade_count, score, {r6('total_return_pct', 'composite')} FROM (SELECT *, {_COMPOSITE} AS composite FROM ({_OPTIMISED}))")
def optimise_strategy(spark, d):
    scored = strategy.optimise(bars_1d(spark, d), _TEMPLATE, S.grid(spark, short=[2, 3, 5], long=[7, 10]), RULES)
    return rounded(scored.select("symbol", "param_id", "trade_count", "score", "total_return_pct", "composite"))


_DATES = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ({BARS_SQL}))"
_PHASES = f"""SELECT w AS window_id, phase, (SELECT date FROM n WHERE i = a) AS a, (SELECT date FROM n WHERE i = z) AS z FROM (SELECT w, unnest(['train', 'test']) AS phase, unnest([0, w * 5 + 10]) AS a, unnest([w * 5 + 9, w * 5 + 14]) AS z FROM (SELECT unnest(range(0, (SELECT count(*) - 15 FROM n) // 5 + 1)) AS w))"""
_FORWARD_BARS = f"WITH n AS ({_DATES}), p AS ({_PHASES}) SELECT concat(window_id, '/', phase, '/', symbol) AS symbol, b.* EXCLUDE (symbol) FROM ({BARS_SQL}) b JOIN p ON b.date BETWEEN p.a AND p.z"
_FORWARD = f"SELECT CAST(split_part(symbol, '/', 1) AS INT) AS window_id, split_part(symbol, '/', 2) AS phase, split_part(symbol, '/', 3) AS symbol, * EXCLUDE (symbol) FROM ({metrics_sql(walk_sql(cross_sql(_FORWARD_BARS, 2, 4)))})"


def _forward(spark, d):
    b = bars_1d(spark, d)
    return S.walk_forward(b, S.walk_forward_windows(b, 10, 5, 5), lambda x: S.ma_cross_signals(x, 2, 4), RULES)


@query(f"SELECT window_id, phase, symbol, trade_count, score, {r6('total_return_pct', 'sharpe', 'max_drawdown_pct')} FROM ({_FORWARD})")
def walk_forward_runs(spark, d):
    return rounded(_forward(spark, d).select("window_id", "phase", "symbol", "trade_count", "score", "total_return_pct", "sharpe", "max_drawdown_pct"))


@query(f"""SELECT *, CASE WHEN failed_windows > 0 THEN 'inconclusive' WHEN positive_return_rate >= 0.6 AND sharpe_median >= 0 THEN 'stable' ELSE 'unstable' END AS validation, CASE WHEN failed_windows > 0 THEN 'failed_windows' END AS reason
 FROM (SELECT symbol, count(*) AS windows, (SELECT count(DISTINCT window_id) FROM ({_FORWARD})) - count(*) AS failed_windows, {r6('avg(t.total_return_pct) AS return_mean', 'median(t.total_return_pct) AS return_median', 'avg(t.sharpe) AS sharpe_mean', 'median(t.sharpe) AS sharpe_median', 'avg(t.score) AS score_mean', 'avg(CASE WHEN t.total_return_pct > 0 THEN 1.0 ELSE 0.0 END) AS positive_return_rate', 'avg(CASE WHEN t.sharpe > 0 THEN 1.0 ELSE 0.0 END) AS positive_sharpe_rate', 'greatest(0, 100 - avg(abs(i.sharpe - t.sharpe)) * 20) AS consistency')}
 FROM (SELECT * FROM ({_FORWARD}) WHERE phase = 'test') t JOIN (SELECT * FROM ({_FORWARD}) WHERE phase = 'train') i USING (symbol, window_id) GROUP BY symbol HAVING count(*) >= 2)
 UNION ALL SELECT symbol, n, (SELECT count(DISTINCT window_id) FROM ({_FORWARD})) - n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'inconclusive', 'too_few_windows' FROM (SELECT symbol, count(*) FILTER (WHERE phases = 2) AS n FROM (SELECT symbol, window_id, count(DISTINCT phase) AS phases FROM ({_FORWARD}) GROUP BY ALL) GROUP BY symbol) WHERE n < 2""")
def walk_forward_stability(spark, d):
    return rounded(S.stability(_forward(spark, d)))


_FITNESS = """SELECT *, CASE WHEN sharpe <= 0 THEN greatest(0, 25 + sharpe * 10) ELSE least(100, 50 + sharpe * 25) END AS sharpe_score, CASE WHEN annualized_return_pct < 0 THEN 0 ELSE least(100, abs(annualized_return_pct) / greatest(max_drawdown_pct, 0.1) * 25) END AS calmar_score,
 CASE WHEN win_rate_pct <= 30 THEN greatest(0, win_rate_pct) ELSE least(100, 30 + (win_rate_pct - 30) * 2.5) END AS win_score, CASE WHEN profit_factor <= 1 THEN greatest(0, profit_factor * 20) ELSE least(100, 30 + profit_factor * 24) END AS profit_score,
 CASE WHEN trade_count < 3 THEN 20.0 WHEN trade_count < 5 THEN 50.0 WHEN trade_count <= 30 THEN 100.0 WHEN trade_count <= 60 THEN greatest(50, 100 - (trade_count - 30) * 1.5) ELSE greatest(20, 50 - (trade_count - 60) * 0.3) END AS count_score, 65.0 AS simplicity_score FROM ({})"""
_PARTS = ("sharpe_score", "calmar_score", "win_score", "profit_score", "count_score", "simplicity_score")


@query(f"SELECT symbol, {r6(*_PARTS)}, round(least(greatest({' + '.join(f'{w} * {c}' for c, w in D.FITNESS.items())}, 0), 100), 2) + 0.0 AS fitness FROM ({_FITNESS.format(metrics_sql(_RUN_SQL))})")
def fitness_scores(spark, d):
    return rounded(D.fitness_scores(_metrics(spark, d), 4).select("symbol", *_PARTS, "fitness"))


def _fall(c: str) -> str:
    return f"least(greatest((1 - n.{c} / nullif(CAST(b.{c} AS DOUBLE), 0)) * 100, 0), 100)"


_DECAYED = f"""SELECT symbol, round(0.4 * CASE WHEN abs(b.sharpe) < 0.01 THEN CASE WHEN n.sharpe < -0.1 THEN 100 ELSE 0 END ELSE least(greatest((b.sharpe - n.sharpe) / abs(b.sharpe) * 100, 0), 100) END
 + 0.25 * CASE WHEN abs(b.profit_factor) < 0.01 THEN CASE WHEN n.profit_factor < 0.5 THEN 100 ELSE 0 END ELSE {_fall('profit_factor')} END + 0.15 * least(greatest((b.win_rate_pct - n.win_rate_pct) * 5, 0), 100) + 0.2 * CASE WHEN b.trade_count <= 0 THEN 0 ELSE {_fall('trade_count')} END, 2) + 0.0 AS decay
 FROM ({metrics_sql(_RUN_SQL)}) b JOIN ({metrics_sql(walk_sql(cross_sql(BARS_SQL, 5, 10)))}) n USING (symbol)"""


@query(f"SELECT symbol, decay, CASE WHEN decay < 20 THEN 'active' WHEN decay < 40 THEN 'paper' WHEN decay < 70 THEN 'degraded' ELSE 'retired' END AS status FROM ({_DECAYED})")
def strategy_decay(spark, d):
    return D.lifecycle_ranking(rounded(D.decay_score(_metrics(spark, d), _metrics(spark, d, 5, 10), "symbol")))


@query(f"SELECT symbol, CASE WHEN coalesce(regr_slope(close, epoch(CAST(date AS TIMESTAMP)) / 86400), 0) > 1e-9 THEN 'improving' WHEN coalesce(regr_slope(close, epoch(CAST(date AS TIMESTAMP)) / 86400), 0) < -1e-9 THEN 'worsening' ELSE 'steady' END AS signal FROM ({BARS_SQL}) GROUP BY symbol")
def trend_signals(spark, d):
    return bars_1d(spark, d).groupBy("symbol").agg(D.trend_signal(F.col("close"), F.unix_date("date").cast("double")).alias("signal"))


# ---------------------------------------------------------------- technical analysis of the latest state


def points_sql(base: str, points: dict[str, tuple[str, int, bool]], n: int) -> str:
    each = " UNION ALL ".join(f"SELECT symbol, date, '{p}' AS point, CAST({c} AS DOUBLE) AS value FROM (SELECT *, count(*) OVER w AS nn, {'max' if high else 'min'}({c}) OVER w AS best FROM base WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)) WHERE nn = {2 * k + 1} AND {c} = best" for p, (c, k, high) in points.items())
    wide = ", ".join(f"max(CASE WHEN point = '{p}' AND rn = {i} THEN value END) AS {p}{i}" for p in points for i in range(1, n + 1))
    return f"WITH base AS MATERIALIZED ({base}) SELECT b.symbol, bars, x.* EXCLUDE (symbol) FROM (SELECT symbol, count(*) AS bars FROM base GROUP BY symbol) b LEFT JOIN (SELECT symbol, {wide} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, point ORDER BY date DESC) AS rn FROM ({each})) GROUP BY symbol) x USING (symbol)"


_HOURLY = with_formulas_sql(HOURS_SQL, {n: INDICATORS[n] for n in A.SCORED})
_POINTS = {f"{c}_{side}": (c, 5, side == "high") for c in ("close", *A.DIVERGENT) for side in ("high", "low")}
_TOP = "coalesce(bars >= 20 AND close_high1 > close_high2 AND {0}_high1 < {0}_high2, false)"
_BOTTOM = "coalesce(bars >= 20 AND close_low1 < close_low2 AND {0}_low1 > {0}_low2, false)"
_FLAGS = ", ".join(f"{t.format(i)} AS {i}_{n}" for i in A.DIVERGENT for n, t in (("top", _TOP), ("bottom", _BOTTOM)))
_DIVERGENCE = f"SELECT symbol, CASE WHEN bars < 20 THEN 'short' WHEN {' OR '.join(f'{i}_top' for i in A.DIVERGENT)} THEN 'top' WHEN {' OR '.join(f'{i}_bottom' for i in A.DIVERGENT)} THEN 'bottom' ELSE 'none' END AS divergence, * EXCLUDE (symbol, bars) FROM (SELECT symbol, bars, {_FLAGS} FROM ({points_sql(_HOURLY, _POINTS, 2)}))"


@query(_DIVERGENCE)
def divergence(spark, d):
    return A.divergence(with_formulas(bars_1h(spark, d), {n: INDICATORS[n] for n in A.DIVERGENT}))


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM ({})) WHERE rk = 1"
_PAT = f"""SELECT symbol, CASE WHEN bars < 30 THEN 'short' WHEN NOT enough THEN 'none' WHEN h2 > h3 AND h2 > h1 AND abs(h3 - h1) / (h2 + 1e-10) < 0.03 THEN 'double_top' WHEN l2 < l3 AND l2 < l1 AND abs(l3 - l1) / (l2 + 1e-10) < 0.03 THEN 'double_bottom' WHEN h3 > h2 AND h2 > h1 AND l3 < l2 AND l2 < l1 THEN 'triangle' ELSE 'none' END AS pattern,
 CASE WHEN NOT enough THEN '' WHEN pc < po AND close > open AND close > po AND open < pc THEN 'bullish' WHEN pc > po AND close < open AND close < po AND open > pc THEN 'bearish' ELSE '' END AS engulfing,
 CASE WHEN enough AND body > 0 AND (least(open, close) - low) / body > 2 AND (high - greatest(open, close)) / body < 0.5 THEN CASE WHEN close > open THEN 'hammer' ELSE 'hanging' END ELSE '' END AS tail, enough AND body / (high - low + 1e-10) < 0.1 AS doji
 FROM (SELECT *, bars >= 30 AND h3 IS NOT NULL AND l3 IS NOT NULL AS enough, abs(close - open) AS body FROM ({points_sql(HOURS_SQL, {"h": ("high", 3, True), "l": ("low", 3, False)}, 3)}) JOIN ({_LAST.format(f"SELECT *, lag(open) {_W}) AS po, lag(close) {_W}) AS pc FROM ({HOURS_SQL})")}) USING (symbol))"""


@query(_PAT)
def chart_patterns(spark, d):
    return A.patterns(bars_1h(spark, d))


_TREND_STATE = f"""SELECT symbol, CASE WHEN ma5 > ma20 AND ma20 > ma60 THEN 'up' WHEN ma5 < ma20 AND ma20 < ma60 THEN 'down' WHEN close > ma20 AND close > ma60 THEN 'firm' WHEN NOT close > ma20 AND NOT close > ma60 THEN 'soft' ELSE 'range' END AS direction,
 CASE WHEN adx14 > 40 THEN 'strong' WHEN adx14 > 25 THEN 'medium' ELSE 'weak' END AS strength, CASE WHEN plus_di > minus_di THEN 'long' ELSE 'short' END AS dmi FROM ({_LAST.format(_HOURLY)})"""


@query(_TREND_STATE)
def trend_state(spark, d):
    return A.trend_state(with_formulas(bars_1h(spark, d), {n: INDICATORS[n] for n in A.TREND}))


_COMPOSED = f"""SELECT symbol, least(greatest(15 + CASE WHEN direction IN ('up', 'firm') THEN step WHEN direction IN ('down', 'soft') THEN -step ELSE 0 END, 0), 30) AS trend,
 least(greatest(12.5 + CASE WHEN macd_bar > 0 THEN 3 ELSE -3 END + CASE WHEN rsi24 > 70 THEN -2 WHEN rsi24 > 50 THEN 2 WHEN rsi24 < 30 THEN 2 ELSE -2 END + CASE WHEN kdj_j > 80 THEN -2 WHEN kdj_j < 20 THEN 2 ELSE 0 END + CASE WHEN wr14 < -80 THEN 2 WHEN wr14 > -20 THEN -2 ELSE 0 END, 0), 25) AS momentum,
 least(greatest(7.5 + CASE WHEN vol_ratio > 1.5 THEN 4 WHEN vol_ratio > 1.2 THEN 2 WHEN vol_ratio < 0.8 THEN -3 ELSE 0 END + CASE WHEN obv5 > obv20 THEN 2 ELSE -2 END, 0), 15) AS volume,
 least(greatest(7.5 + CASE pattern WHEN 'double_bottom' THEN 5 WHEN 'double_top' THEN -5 ELSE 0 END + CASE engulfing WHEN 'bullish' THEN 3 WHEN 'bearish' THEN -3 ELSE 0 END + CASE tail WHEN 'hammer' THEN 2 WHEN 'hanging' THEN -2 ELSE 0 END, 0), 15) AS pattern,
 least(greatest(7.5 + CASE WHEN place > 0.8 THEN -3 WHEN place < 0.2 THEN 3 ELSE 0 END, 0), 15) AS volatility, CASE divergence WHEN 'top' THEN -8 WHEN 'bottom' THEN 8 ELSE 0 END AS turn
 FROM (SELECT *, CASE WHEN strength = 'strong' THEN 15 ELSE 10 END AS step, CASE WHEN boll_upper > boll_lower THEN (close - boll_lower) / (boll_upper - boll_lower) END AS place FROM ({_LAST.format(f"SELECT *, avg(obv) {_W} ROWS 4 PRECEDING) AS obv5, avg(obv) {_W} ROWS 19 PRECEDING) AS obv20, row_number() {_W}) AS nth FROM ({_HOURLY})")}) WHERE nth >= 20)
 JOIN ({_TREND_STATE}) USING (symbol) JOIN ({_PAT}) USING (symbol) JOIN (SELECT symbol, divergence FROM ({_DIVERGENCE})) USING (symbol)""".replace("SELECT *, CASE WHEN strength = 'strong' THEN 15 ELSE 10 END AS step, CASE WHEN", "SELECT *, CASE WHEN", 1).replace("THEN step WHEN", "THEN (CASE WHEN strength = 'strong' THEN 15 ELSE 10 END) WHEN").replace("THEN -step", "THEN -(CASE WHEN strength = 'strong' THEN 15 ELSE 10 END)")


@query(f"SELECT symbol, {r6('trend', 'momentum', 'volume', 'pattern', 'volatility', 'score')}, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'firm' WHEN score >= 45 THEN 'neutral' WHEN score >= 30 THEN 'soft' ELSE 'weak' END AS rating FROM (SELECT *, least(greatest(trend + momentum + volume + pattern + volatility + turn, 0), 100) AS score FROM ({_COMPOSED}))")
def composite_score(spark, d):
    return rounded(A.composite_score(bars_1h(spark, d)))


_STRUCT = f"""SELECT *, CASE WHEN n < 25 THEN 'short' WHEN bull AND (hh OR hl) THEN 'uptrend' WHEN bear AND (lh OR ll) THEN 'downtrend' WHEN flat OR (NOT bull AND NOT bear) THEN CASE WHEN wide THEN 'range_bound' ELSE 'sideways' END ELSE 'mixed' END AS kind FROM (
 SELECT *, s > l AND s0 > l0 AS bull, s < l AND s0 < l0 AS bear, high > top AS hh, low > floor AS hl, high < top AS lh, low < floor AS ll, CASE WHEN n >= 15 THEN atr ELSE high - low END / close < 0.005 AS flat, (highest - lowest) / close > 0.03 AS wide FROM (
 SELECT symbol, max(n) AS n, {", ".join(f"max({c}) FILTER (WHERE rk = 1) AS {c}" for c in ("close", "high", "low", "s", "l", "s0", "l0", "atr"))}, max(high) FILTER (WHERE rk BETWEEN 2 AND w) AS top, min(low) FILTER (WHERE rk BETWEEN 2 AND w) AS floor, max(high) FILTER (WHERE rk <= w) AS highest, min(low) FILTER (WHERE rk <= w) AS lowest FROM (
 SELECT *, least(20, n // 2) AS w, lag(s) {_W}) AS s0, lag(l) {_W}) AS l0, avg(tr) {_W} ROWS 13 PRECEDING) AS atr FROM (SELECT *, avg(close) {_W} ROWS 4 PRECEDING) AS s, avg(close) {_W} ROWS 19 PRECEDING) AS l, greatest(high - low, abs(high - lag(close) {_W})), abs(low - lag(close) {_W}))) AS tr, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM ({HOURS_SQL}))) GROUP BY symbol))"""


@query(f"SELECT symbol, CASE WHEN kind IN ('short', 'mixed') THEN 'sideways' ELSE kind END AS trend, CASE kind WHEN 'uptrend' THEN 'up' WHEN 'downtrend' THEN 'down' ELSE 'neutral' END AS direction, CAST(CASE kind WHEN 'short' THEN 0 WHEN 'uptrend' THEN 70 + 10 * (hh::INT + hl::INT) WHEN 'downtrend' THEN 70 + 10 * (lh::INT + ll::INT) WHEN 'sideways' THEN 20 ELSE 30 END AS DOUBLE) AS strength FROM ({_STRUCT})")
def market_structure(spark, d):
    return A.structure(bars_1h(spark, d))


@query()
def price_levels(spark, d):
    return rounded(A.price_levels(bars_1h(spark, d)))


_STRENGTH = f"""SELECT symbol, CASE WHEN n < 5 OR span IS NULL THEN 0.0 ELSE least(greatest(pos * 0.25 + body * 0.35 + 0.2 * (CASE WHEN up > 0.4 THEN -0.3 ELSE 0 END + CASE WHEN down > 0.4 THEN 0.3 ELSE 0 END) + CASE WHEN volume > usual * 1.2 THEN 0.2 * CASE WHEN body > 0 THEN 1 ELSE -1 END ELSE 0 END, -1), 1) END AS score, coalesce(volume / nullif(usual, 0), 1.0) AS volume_ratio FROM (
 SELECT *, ((close + open) / 2 - low) / span * 2 - 1 AS pos, (close - open) / span AS body, (high - greatest(open, close)) / span AS up, (least(open, close) - low) / span AS down FROM (SELECT *, CASE WHEN high > low THEN high - low END AS span FROM ({_LAST.format(f"SELECT *, avg(volume) {_W} ROWS 9 PRECEDING) AS usual, count(*) OVER (PARTITION BY symbol) AS n FROM ({HOURS_SQL})")})))"""


@query(f"SELECT symbol, {r6('score', 'volume_ratio')}, CASE WHEN score > 0.3 THEN 'bulls' WHEN score < -0.3 THEN 'bears' ELSE 'even' END AS state, volume_ratio > 1.2 AS confirmed FROM ({_STRENGTH})")
def bar_strength(spark, d):
    return rounded(A.bar_strength(bars_1h(spark, d)))


_HURST = f"""SELECT symbol, coalesce(slope, 0.5) AS hurst FROM (SELECT DISTINCT symbol FROM ({HOURS_SQL})) LEFT JOIN (SELECT symbol, CASE WHEN count(*) >= 3 THEN least(greatest(regr_slope(y, x), 0.1), 0.95) END AS slope FROM (SELECT symbol, lag_ AS lag_, ln(avg(span / dev)) AS y, ln(lag_) AS x FROM (
 SELECT symbol, lag_, chunk, max(walk) - min(walk) AS span, stddev_pop(close) AS dev FROM (SELECT *, sum(step) OVER (PARTITION BY symbol, lag_, chunk ORDER BY i) AS walk FROM (SELECT *, close - avg(close) OVER (PARTITION BY symbol, lag_, chunk) AS step FROM (
 SELECT *, i // lag_ AS chunk FROM (SELECT symbol, close, n, n - rk AS i, unnest(range(2, least(20, n // 2 - 1) + 1)) AS lag_ FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM ({HOURS_SQL}) WHERE close IS NOT NULL) WHERE rk <= 252) WHERE n >= 40)) WHERE (chunk + 1) * lag_ <= n)) GROUP BY ALL) WHERE dev > 1e-12 AND span > 0 GROUP BY symbol, lag_) GROUP BY symbol) USING (symbol)"""


@query(f"SELECT symbol, {r6('hurst')} FROM ({_HURST})")
def hurst_exponent(spark, d):
    return rounded(A.hurst(bars_1h(spark, d)))


def _slope_sql(c: str, n: int) -> str:
    inside = f"FILTER (WHERE {c}_at <= {n})"
    return f"CASE WHEN count({c}) {inside} >= 3 THEN regr_slope({c}, -{c}_at) {inside} / CASE WHEN avg(abs({c})) {inside} > 0 THEN avg(abs({c})) {inside} ELSE 1 END ELSE 0 END AS {c}_slope"


def _rank_last(c: str) -> str:
    return f"coalesce((count(*) FILTER (WHERE {c} < {c}_last) + (count(*) FILTER (WHERE {c} = {c}_last) + 1) / 2.0) / CASE WHEN count(*) FILTER (WHERE {c} = {c}_last) > 0 THEN count({c}) END, 0.5)"


_REGIME = f"""SELECT *, least(adx / 60 + 0.3, 0.95) AS sure FROM (SELECT symbol, count(*) AS bars, coalesce(arg_max(adx, date), 20.0) AS adx, arg_max(close, date) AS close, arg_max(high20, date) AS high20, arg_max(low20, date) AS low20, {_slope_sql("ma20", 5)}, {_slope_sql("ma60", 10)}, {_rank_last("atr_share")} AS vol, {_rank_last("band")} AS band_rank FROM (
 SELECT *, CASE WHEN ma20 IS NOT NULL THEN count(ma20) OVER d END AS ma20_at, CASE WHEN ma60 IS NOT NULL THEN count(ma60) OVER d END AS ma60_at, last_value(atr_share) OVER a AS atr_share_last, last_value(band) OVER a AS band_last FROM (
 SELECT *, CASE WHEN count(close) {_W} ROWS 59 PRECEDING) >= 20 THEN avg(close) {_W} ROWS 59 PRECEDING) END AS ma60 FROM ({with_formulas_sql(HOURS_SQL, A.REGIME)})) WINDOW d AS (PARTITION BY symbol ORDER BY date DESC), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY symbol) JOIN ({_HURST}) USING (symbol) WHERE bars >= 30"""
_RULES = [
    ("adx > 35 AND ma20_slope > 0.001 AND ma60_slope > 0", "trending_up", "sure"), ("adx > 35 AND ma20_slope < -0.001 AND ma60_slope < 0", "trending_down", "sure"), ("vol < 0.3 AND band_rank < 0.3 AND adx < 20", "low_volatility", "0.9 - vol"), ("vol > 0.7 AND adx > 20", "high_volatility", "0.5 + vol * 0.3"),
    ("adx < 20 AND band_rank > 0.3 AND band_rank < 0.7", "range_bound", "0.5 + (20 - adx) * 0.02"), ("hurst < 0.4 AND adx < 22", "range_bound", "1.0 - hurst"), ("close >= high20 * 0.99 AND ma20_slope > 0", "trending_up", "0.55"), ("close <= low20 * 1.01 AND ma20_slope < 0", "trending_down", "0.55"),
]


@query(f"SELECT symbol, CASE {' '.join(f'WHEN {w} THEN {chr(39)}{n}{chr(39)}' for w, n, _ in _RULES)} ELSE 'range_bound' END AS regime, {r6('CASE ' + ' '.join(f'WHEN {w} THEN {c}' for w, _, c in _RULES) + ' ELSE 0.5 END AS confidence', 'adx', 'ma20_slope', 'ma60_slope', 'vol AS vol_rank', 'band_rank', 'hurst')} FROM ({_REGIME})")
def market_regime(spark, d):
    return rounded(A.market_regime(bars_1h(spark, d)))


# ---------------------------------------------------------------- timeframes, stops, targets, plans

_FRAMES = (("1h", 0.4, 1), ("4h", 0.6, 4), ("1d", 0.8, 24), ("1w", 1.0, 168))


@query(f"""SELECT symbol, round(sum(weight * dir) / sum(weight), 6) + 0.0 AS alignment, count(DISTINCT dir) = 1 AS agreed FROM (SELECT symbol, frame, arg_max(weight, ts) AS weight, CAST(sign(arg_max(close, ts) - arg_min(close, ts)) AS INT) AS dir FROM (SELECT *, row_number() OVER (PARTITION BY symbol, frame ORDER BY ts DESC) AS rn FROM (
 {" UNION ALL ".join(f"SELECT symbol, '{f}' AS frame, CAST({w} AS DOUBLE) AS weight, time_bucket(INTERVAL {h} HOURS, date, TIMESTAMP '1970-01-01 00:00:00') AS ts, arg_max(close, date) AS close FROM ({HOURS_SQL}) GROUP BY ALL" for f, w, h in _FRAMES)})) WHERE rn <= 2 GROUP BY symbol, frame) GROUP BY symbol""")
def timeframe_alignment(spark, d):
    b, parts = bars_1h(spark, d), None
    for frame, _, hours in _FRAMES:
        at = F.floor(F.unix_timestamp(F.col("date").cast("timestamp")) / (3600 * hours))
        bars = b.groupBy("symbol", at.alias("date")).agg(F.max_by("close", F.col("date")).alias("close"))
        last = latest(bars.withColumn("before", F.lag("close").over(seq())), ["symbol"], F.desc("date"))
        one = last.select("symbol", F.lit(frame).alias("timeframe"), F.signum(F.col("close") - F.coalesce("before", "close")).cast("int").alias("direction"))
        parts = one if parts is None else parts.unionByName(one)
    return rounded(D.alignment(parts))


_ENTRY = _LAST.format(f"""SELECT *, CASE WHEN count(close) {_W} ROWS 4 PRECEDING) >= 5 THEN min(low) {_W} ROWS 4 PRECEDING) END AS low5, CASE WHEN count(close) {_W} ROWS 4 PRECEDING) >= 5 THEN max(high) {_W} ROWS 4 PRECEDING) END AS high5, CASE WHEN count(close) {_W} ROWS 19 PRECEDING) >= 20 THEN stddev_samp(close) {_W} ROWS 19 PRECEDING) END AS std20 FROM ({with_formulas_sql(HOURS_SQL, {"atr14": INDICATORS["atr14"]})})""")
_LEVELS = f"SELECT symbol, round(close, 0) AS level FROM ({HOURS_SQL})"


def _stops_sql(sign: int) -> str:
    swing = "low5" if sign > 0 else "high5"
    near = f"(SELECT {'max' if sign > 0 else 'min'}(level) FROM ({_LEVELS}) v WHERE v.symbol = e.symbol AND {sign} * (e.close - level) > 0)"
    each = {"atr": f"close - {sign} * atr14 * 2.0", "fixed_pct": f"close * {1 - sign * 0.03}", "swing": f"{swing} - {sign * 0.02}", "level": f"{near} - {sign * 0.02}", "volatility": f"close - {sign} * 2 * std20"}
    rows = " UNION ALL ".join(f"SELECT symbol, close, atr14, '{m}' AS method, {x} AS stop FROM ({_ENTRY}) e" for m, x in each.items())
    return f"SELECT symbol, close, atr14, method, CASE WHEN stop IS NULL THEN 'fixed_pct' ELSE method END AS used, round_even(coalesce(stop, close * {1 - sign * 0.03}) / 0.01, 0) * 0.01 AS stop FROM ({rows})"


def _latest(spark, d):
    return D.entry_rows(with_formulas(bars_1h(spark, d), {"atr14": INDICATORS["atr14"]}))


def _levels(spark, d):
    return bars_1h(spark, d).select("symbol", F.round("close", 0).alias("level"))


def _stops(spark, d, side):
    return D.stop_methods(_latest(spark, d), _levels(spark, d), side)


@query(f"SELECT symbol, method, used, {r6('close', 'stop', 'abs(close - stop) AS risk', 'abs(close - stop) / close * 100 AS risk_pct')} FROM ({_stops_sql(1)})")
def stops_long(spark, d):
    return rounded(_stops(spark, d, "long"))


@query(f"SELECT symbol, method, used, {r6('close', 'stop', 'abs(close - stop) AS risk', 'abs(close - stop) / close * 100 AS risk_pct')} FROM ({_stops_sql(-1)})")
def stops_short(spark, d):
    return rounded(_stops(spark, d, "short"))


_BASE = f"SELECT symbol, close, atr14, abs(close - stop) AS risk FROM ({_stops_sql(1)}) WHERE method = 'atr'"
_AHEAD = f"(SELECT min(level) FROM ({_LEVELS}) v WHERE v.symbol = e.symbol AND level > e.close)"
_TARGETS = " UNION ALL ".join(f"SELECT symbol, close, risk, '{m}' AS method, {x} AS target FROM ({_BASE}) e" for m, x in {"risk_reward": "close + risk * 2", "atr": "close + atr14 * 3", "level": _AHEAD, "trailing": "close + risk * 2 * 0.7", "fixed_pct": "close * 1.06"}.items())


@query(f"SELECT symbol, method, used, {r6('target', 'CASE WHEN method = ' + chr(39) + 'trailing' + chr(39) + ' THEN target * 0.95 END AS trailing_stop', 'coalesce(abs(target - close) / nullif(risk, 0), 0) AS reward_ratio')} FROM (SELECT symbol, close, risk, method, CASE WHEN target IS NULL THEN 'risk_reward' ELSE method END AS used, coalesce(target, close + risk * 2) AS target FROM ({_TARGETS}))")
def targets_long(spark, d):
    last, levels = _latest(spark, d), _levels(spark, d)
    return rounded(D.target_methods(D.stop_methods(last, levels).where("method = 'atr'"), last, levels))


@query("SELECT o_custkey AS owner, CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS level, round(sum(o_totalprice) * CASE o_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END / 100, 4) AS daily_loss, round(sum(o_totalprice) * CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END / 100, 4) AS drawdown, CASE o_custkey % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.3 ELSE 0.4 END::DOUBLE AS halt, CASE o_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 10 END AS losses FROM orders GROUP BY o_custkey")
def drawdown_limits(spark, d):
    from tidemark.sources.market import table

    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.sum("o_totalprice").alias("balance"))
    a = a.withColumn("level", F.when(F.col("owner") % 3 == 0, "low").when(F.col("owner") % 3 == 1, "medium").otherwise("high"))
    return rounded(D.drawdown_control(a), 4)


@query(f"""SELECT symbol, action, {r6('close AS entry', 'stop', 'target', 'least(greatest(strength * 0.7 + abs(score) * 20 + CASE WHEN volume_ratio > 1.2 THEN 10 ELSE 0 END, 0), 100) AS confidence')}, (target - close) / nullif(risk, 0) >= 1.5 AND risk / close * 100 <= 10 AND action <> 'wait' AS allowed FROM (SELECT *, CASE WHEN kind NOT IN ('uptrend', 'downtrend') THEN 'wait' WHEN kind = 'uptrend' AND score < -0.3 OR kind = 'downtrend' AND score > 0.3 THEN 'wait' WHEN kind = 'uptrend' THEN 'buy' ELSE 'sell' END AS action FROM (
 SELECT symbol, kind, CASE kind WHEN 'short' THEN 0 WHEN 'uptrend' THEN 70 + 10 * (hh::INT + hl::INT) WHEN 'downtrend' THEN 70 + 10 * (lh::INT + ll::INT) WHEN 'sideways' THEN 20 ELSE 30 END AS strength FROM ({_STRUCT})) JOIN ({_STRENGTH}) USING (symbol) JOIN (SELECT symbol, close, stop, abs(close - stop) AS risk, close + abs(close - stop) * 2 AS target FROM ({_stops_sql(1)}) WHERE method = 'atr') USING (symbol))""")
def trade_plans(spark, d):
    b, last, levels = bars_1h(spark, d), _latest(spark, d), _levels(spark, d)
    stops = D.stop_methods(last, levels).where("method = 'atr'")
    targets = D.target_methods(stops, last, levels).where("method = 'risk_reward'")
    return rounded(D.trade_plan(A.structure(b), stops, targets, A.bar_strength(b)))


_POP = f"SELECT param_id, {r6('avg(sharpe) AS gain', '-avg(max_drawdown_pct) AS calm')} FROM ({_OPTIMISED}) GROUP BY param_id"


def _population(spark, d):
    scored = S.optimise_cross(bars_1d(spark, d), S.grid(spark, short=[2, 3, 5], long=[7, 10]), RULES)
    return rounded(scored.groupBy("param_id").agg(F.avg("sharpe").alias("gain"), (-F.avg("max_drawdown_pct")).alias("calm")))


_DOMINATED = "SELECT * FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.gain >= a.gain AND b.calm >= a.calm AND (b.gain > a.gain OR b.calm > a.calm))"


@query(f"WITH p AS ({_POP}), f AS ({_DOMINATED.format('p')}), g AS (SELECT * FROM p WHERE param_id NOT IN (SELECT param_id FROM f)), h AS ({_DOMINATED.format('g')}) SELECT *, 0 AS front FROM f UNION ALL SELECT *, 1 FROM h")
def pareto_ranks(spark, d):
    return T.pareto_ranks(_population(spark, d), "param_id", ["gain", "calm"]).where("front <= 1")
