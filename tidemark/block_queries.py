"""Queries of blocked series, interval joins and factors evaluated by their moments, added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import moments as M
from tidemark.operators.intervals import interval_join
from tidemark.plans.blocked import blocked_formulas
from tidemark.plans.formula import with_formulas
from tidemark.plans.formula_sql import formulas_sql, with_formulas_sql
from tidemark.queries import query, rounded
from tidemark.sources.market import HOURS_SQL, PANEL_SQL, bars_1h, panel_1d, table

#: Rows of a block here; a symbol of the hourly bars has several.
ROWS = 150

_AVERAGES = {"ema12": "ema(close, 12)", "macd_dea": "ema(ema(close, 12) - ema(close, 26), 9)", "adjusted": "ema_adjusted(close, 20)", "on_means": "ts_max(ema(ts_mean(close, 3), 5), 7)"}
_WINDOWS = {"spread": "ts_std(ts_delta(close, 2), 40)", "together": "ts_corr(close, volume, 30)", "middle": "ts_median(close, 90)", "place": "ts_rank_pct(close, 90)", "peak": "ts_rank(close, 80)", "far": "ts_mean(abs(close - ts_mean(close, 100)), 100)"}
_CROSS = {"ranked": "rank(ts_delta(close, 2)) + ts_mean(rank(close), 24)", "scored": "zscore(ema(close, 5))", "share": "volume / cum_sum(volume)"}


def _blocked(formulas):
    return lambda spark, d: rounded(blocked_formulas(bars_1h(spark, d), formulas, ROWS).select("symbol", "date", *formulas))


def _sql(formulas):
    return f"SELECT * REPLACE (CAST(date AS TIMESTAMP) AS date) FROM ({formulas_sql(HOURS_SQL, formulas)})"


for _name, _formulas in (("blocked_averages", _AVERAGES), ("blocked_windows", _WINDOWS), ("blocked_cross_sections", _CROSS)):
    _f = _blocked(_formulas)
    _f.__name__ = _name
    query(_sql(_formulas))(_f)

_UPTO = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT symbol, CAST(date AS TIMESTAMP) AS date, max(close) {_UPTO} AS peak, min(low) {_UPTO} AS floor, round(sum(volume) {_UPTO}, 6) AS volume_so_far, count(close) {_UPTO} AS bars_so_far, round(close / max(close) {_UPTO} - 1, 6) AS drawdown FROM ({HOURS_SQL})")
def blocked_running_totals(spark, d):
    totals = {"peak": ("max", "close"), "floor": ("min", "low"), "volume_so_far": ("sum", "volume"), "bars_so_far": ("count", "close")}
    r = B.running(B.deal(bars_1h(spark, d), ROWS), totals).withColumn("drawdown", F.col("close") / F.col("peak") - 1)
    return r.select("symbol", "date", "peak", "floor", F.round("volume_so_far", 6).alias("volume_so_far"), "bars_so_far", (F.round("drawdown", 6) + F.lit(0.0)).alias("drawdown"))


@query(f"SELECT e.event_id, e.event_type, b.date AS bar_date, b.close FROM events e ASOF LEFT JOIN (SELECT symbol, CAST(date AS TIMESTAMP) AS date, close FROM ({HOURS_SQL}) WHERE hour(date) % 4 = 0) b ON e.event_type = b.symbol AND e.ts >= b.date")
def blocked_as_of(spark, d):
    """Every event with the last four-hourly bar of its type."""
    bars = bars_1h(spark, d).where(F.hour("date") % 4 == 0).select(F.col("symbol").alias("event_type"), F.col("date").alias("ts"), F.struct(F.col("date").alias("bar_date"), "close").alias("bar"))
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    r = B.as_of_blocks(events, bars, "event_type", "ts", ["bar"], 2000)
    return r.select("event_id", "event_type", "bar.bar_date", "bar.close")


@query("""SELECT e.event_id, o.o_orderkey FROM events e JOIN (SELECT o_orderkey, o_custkey % 20 AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + to_years(CAST(2024 - year(o_orderdate) AS INT)) END AS a,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + to_years(CAST(2024 - year(o_orderdate) AS INT)) + to_hours(o_orderkey % 40 - 2) END AS z FROM orders WHERE o_orderkey % 50 = 3) o
 ON e.user_id % 20 = o.k AND (a IS NULL OR e.ts >= a) AND (z IS NULL OR e.ts < z)""")
def events_in_intervals(spark, d):
    """Events in spans of hours of some orders, moved to 2024; some spans are open, some empty or reversed, many overlap."""
    o = table(spark, d, "orders").where("o_orderkey % 50 = 3")
    moved = F.col("o_orderdate") + F.make_ym_interval(2024 - F.year("o_orderdate"))
    spans = o.select("o_orderkey", (F.col("o_custkey") % 20).alias("k"), F.when(F.col("o_orderkey") % 7 != 0, moved).alias("a"), F.when(F.col("o_orderkey") % 11 != 0, moved + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 40 - 2).cast("int"))).alias("z"))
    events = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("k"))
    return interval_join(events, spans, ["k"], "ts", "a", "z", 86_400.0).select("event_id", "o_orderkey")


# ---------------------------------------------------------------- candidate factors by their moments

CANDIDATES = {
    "momentum": "close / ts_delay(close, 3) - 1", "slow": "close / ts_delay(close, 4) - 1", "surge": "volume / ts_mean(volume, 5)", "spread": "(high - low) / close", "stretch": "ts_max(high, 4) / close - 1", "body": "abs(close - open) / (high - low)",
    "place": "ts_rank_pct(close, 5)", "turn": "ts_delta(close, 1) / ts_mean(high - low, 5)", "mean_gap": "close / ts_mean(close, 5) - 1", "steady": "ts_mean(abs(close - open), 7) / close",
}
_WIDE = f"SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM ({with_formulas_sql(PANEL_SQL, CANDIDATES)})"
_LONG = f"SELECT symbol, date, factor, value, fwd FROM (SELECT symbol, date, fwd, {', '.join(CANDIDATES)} FROM ({_WIDE})) UNPIVOT (value FOR factor IN ({', '.join(CANDIDATES)}))"
_DAYS = f"""SELECT factor, date, corr(value, fwd) AS ic, corr(ra, rb) AS rank_ic FROM (
 SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1) / 2.0 AS rb
 FROM ({_LONG}) WHERE value IS NOT NULL AND fwd IS NOT NULL) GROUP BY factor, date HAVING count(*) >= 3"""
_FINITE = "CASE WHEN isfinite({0}) THEN {0} END"
_SCORES_SQL = f"""SELECT factor, count(i) AS dates, avg(i) AS ic_mean, stddev_samp(i) AS ic_std, avg(i) / nullif(stddev_samp(i), 0) AS icir, avg(r) AS rank_ic_mean, avg(r) / nullif(stddev_samp(r), 0) AS rank_icir
 FROM (SELECT factor, {_FINITE.format("ic")} AS i, {_FINITE.format("rank_ic")} AS r FROM ({_DAYS})) GROUP BY factor"""
_PAIRS_SQL = f"SELECT a.factor AS a, b.factor AS b, count(*) AS n, corr(a.value, b.value) AS corr FROM ({_LONG}) a JOIN ({_LONG}) b ON a.symbol = b.symbol AND a.date = b.date AND list_position({list(CANDIDATES)}, a.factor) < list_position({list(CANDIDATES)}, b.factor) GROUP BY a.factor, b.factor HAVING count(*) >= 20"


def _moments(spark, d):
    panel = with_formulas(panel_1d(spark, d), CANDIDATES).withColumn("fwd", F.try_divide(F.lead("close").over(B.Window.partitionBy("symbol").orderBy("date")), F.col("close")) - 1)
    return M.moments(panel, list(CANDIDATES), "fwd")


@query(f"SELECT factor, dates, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('ic_mean', 'ic_std', 'icir', 'rank_ic_mean', 'rank_icir'))} FROM ({_SCORES_SQL})")
def candidate_scores(spark, d):
    return rounded(M.factor_scores(_moments(spark, d), list(CANDIDATES)))


@query(f"SELECT a, b, n, round(corr, 6) + 0.0 AS corr FROM ({_PAIRS_SQL})")
def candidate_correlations(spark, d):
    return rounded(M.factor_correlations(_moments(spark, d), list(CANDIDATES)))


@query(f"""WITH RECURSIVE scores AS ({_SCORES_SQL}), near AS (SELECT a, b FROM ({_PAIRS_SQL}) WHERE abs(corr) >= 0.7 UNION ALL SELECT b, a FROM ({_PAIRS_SQL}) WHERE abs(corr) >= 0.7),
 able AS (SELECT factor, rank_ic_mean, row_number() OVER (ORDER BY abs(rank_ic_mean) DESC, factor) AS k FROM scores WHERE abs(rank_ic_mean) >= 0.005),
 steps AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT s.k + 1, CASE WHEN len(kept) < 5 AND len(list_intersect(kept, coalesce((SELECT list(b) FROM near n WHERE n.a = x.factor), []))) = 0 THEN list_append(kept, x.factor) ELSE kept END FROM steps s JOIN able x ON x.k = s.k + 1)
 SELECT row_number() OVER (ORDER BY abs(rank_ic_mean) DESC, factor)::INT AS place, factor, round(rank_ic_mean, 6) + 0.0 AS rank_ic_mean FROM scores WHERE list_contains((SELECT kept FROM steps ORDER BY k DESC LIMIT 1), factor)""")
def candidates_chosen(spark, d):
    found = _moments(spark, d).persist()
    return rounded(M.chosen_factors(M.factor_scores(found, list(CANDIDATES)), M.factor_correlations(found, list(CANDIDATES)), least_rank_ic=0.005, top=5))
