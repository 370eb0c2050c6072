"""Queries of the desk operators, added to those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.functions.library import INDICATORS
from tidemark.functions.pack import convert, with_conversions
from tidemark.functions.series import seq
from tidemark.operators import desk as D
from tidemark.operators import quality as Q
from tidemark.operators import strategy
from tidemark.plans.formula import with_formulas
from tidemark.plans.formula_sql import formulas_sql
from tidemark.queries import _RES_SQL, _research, query, rounded
from tidemark.sources.io import first_with_data, latest
from tidemark.sources.market import BARS_SQL, PANEL_SQL, bars_1d, bars_1h, panel_1d, table

_W = "OVER (PARTITION BY symbol ORDER BY date"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def own_rows(spark, d):
    D.access_views(spark, {"desk_orders": table(spark, d, "orders")}, {"desk_orders": "o_custkey"}, 7)
    return spark.sql("SELECT o_orderkey, o_totalprice FROM desk_orders")


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7)")
def own_child_rows(spark, d):
    return D.own_children(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey", "o_custkey", 7).select("l_orderkey", "l_quantity", "l_extendedprice")


_QUOTES = "SELECT printf('S%02d', user_id % 20) AS symbol, arg_max(value, ts) AS price FROM events GROUP BY 1"
_ALERTS = f"SELECT row_number() OVER (ORDER BY symbol) AS alert_id, symbol, CASE WHEN CAST(substr(symbol, 2) AS INT) % 2 = 0 THEN 'above' ELSE 'below' END AS side, 50.0 AS target FROM (SELECT DISTINCT symbol FROM ({_QUOTES}))"


def _quotes(spark, d):
    e = table(spark, d, "events").withColumn("symbol", F.format_string("S%02d", (F.col("user_id") % 20).cast("int")))
    return e.groupBy("symbol").agg(F.max_by("value", "ts").alias("price"))


@query(f"SELECT symbol, side, price FROM ({_ALERTS}) JOIN ({_QUOTES}) USING (symbol) WHERE (side = 'above' AND price >= target) OR (side = 'below' AND price <= target)")
def price_alerts(spark, d):
    q = _quotes(spark, d)
    alerts = q.select("symbol", F.when(F.substring("symbol", 2, 2).cast("int") % 2 == 0, "above").otherwise("below").alias("side"), F.lit(50.0).alias("target"))
    return D.triggered(alerts, q).select("symbol", "side", "price")


@query(f"""SELECT o_custkey % 5 AS owner, round(sum((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (q.price - 50.0) * 2 * 10), 4) AS floating, sum(50.0 * 2 * 10) AS notional, CAST(sum(CASE WHEN q.price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpriced
 FROM orders LEFT JOIN ({_QUOTES}) q ON q.symbol = printf('S%02d', o_orderkey % 23) GROUP BY 1""")
def open_exposure(spark, d):
    p = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("owner"), F.format_string("S%02d", (F.col("o_orderkey") % 23).cast("int")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"), F.lit(2.0).alias("lots"), F.lit(50.0).alias("price"))
    return rounded(D.exposure(p, _quotes(spark, d)), 4)


@query(f"SELECT date_trunc('week', date)::DATE AS period, max(date) AS date FROM ({BARS_SQL}) GROUP BY 1")
def week_ends(spark, d):
    return D.last_trading_days(bars_1d(spark, d).select("date"), "week")


@query("SELECT user_id, CASE WHEN max(ts) IS NULL THEN 'unavailable' WHEN (SELECT epoch(max(ts)) FROM events) - epoch(max(ts)) <= 86400 THEN 'fresh' ELSE 'stale' END AS state FROM events GROUP BY user_id")
def quote_freshness(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    now = e.agg(F.max("s").alias("now"))
    return e.groupBy("user_id").agg(F.max("s").alias("s")).join(F.broadcast(now), F.lit(True)).select("user_id", Q.freshness(F.col("now") - F.col("s"), 86400).alias("state"))


@query(f"SELECT symbol, date, side, place FROM (SELECT symbol, date, 'long' AS side, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS place FROM ({BARS_SQL}) UNION ALL SELECT symbol, date, 'short', row_number() OVER (PARTITION BY date ORDER BY volume, symbol) FROM ({BARS_SQL})) WHERE place <= 3")
def top_longs_shorts(spark, d):
    b = bars_1d(spark, d)
    a = b.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "symbol"))).withColumn("side", F.lit("long"))
    z = b.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("volume", "symbol"))).withColumn("side", F.lit("short"))
    return a.unionByName(z).where("place <= 3").select("symbol", "date", "side", F.col("place").cast("long").alias("place"))


_CANDLES = f"SELECT *, unnest([1, 2]) AS version FROM ({BARS_SQL})"


@query(f"SELECT symbol, date, greatest(high - 0.5, open, close) AS high, least(low + 0.5, open, close) AS low, greatest(volume - 5, 0) AS volume FROM ({_CANDLES}) WHERE version = 2")
def candle_normalize(spark, d):
    twice = bars_1d(spark, d).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    twice = twice.withColumns({"high": F.col("high") - 0.5, "low": F.col("low") + 0.5, "volume": F.col("volume") - F.when(F.col("version") == 2, 5).otherwise(0)})
    return Q.normalised(twice, "version").select("symbol", "date", "high", "low", "volume")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def tolerant_casts(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query(f"SELECT symbol, close FROM ({BARS_SQL}) WHERE date = (SELECT max(date) FROM ({BARS_SQL}))")
def source_failover(spark, d):
    last = latest(bars_1d(spark, d), ["symbol"], F.desc("date")).select("symbol", "close", "date")
    hours = latest(bars_1h(spark, d), ["symbol"], F.desc("date")).select("symbol", "close", F.to_date("date").alias("date"))
    newest = last.agg(F.max("date").alias("newest"))
    both = first_with_data(["symbol"], last, hours.join(last.select("symbol"), "symbol", "left_semi"))
    return both.join(F.broadcast(newest), F.col("date") == F.col("newest")).select("symbol", "close")


@query(f"SELECT symbol, round(median(fwd), 6) AS median_fwd, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM ({_RES_SQL}) WHERE fwd IS NOT NULL GROUP BY symbol")
def forward_summary(spark, d):
    r = _research(spark, d).where("fwd is not null")
    return rounded(r.groupBy("symbol").agg(F.median("fwd").alias("median_fwd"), F.avg((F.col("fwd") > 0).cast("double")).alias("positive")))


STRATEGY = {"entry": {"conditions": [{"indicator": "sma3", "operator": "cross_above", "indicator2": "sma7"}, {"indicator": "volume", "operator": "above", "indicator2": "volume_sma5", "multiply_value": 0.9}]}, "exit": {"conditions": [{"indicator": "close", "operator": "below", "indicator2": "sma7"}, {"indicator": "close", "operator": "between", "value": [95, 96]}], "logic": "or"}}
_FULL = "CASE WHEN count({x}) {w} ROWS {p} PRECEDING) >= {n} THEN avg({x}) {w} ROWS {p} PRECEDING) END"


@query(f"""SELECT symbol, date, coalesce(s0 <= l0 AND s > l AND volume > 0.9 * v, false) AS entry, coalesce(close < l, false) OR (close > 95 AND close < 96) AS exit FROM (SELECT *, lag(s) {_W}) AS s0, lag(l) {_W}) AS l0 FROM (
 SELECT *, {_FULL.format(x="close", w=_W, p=2, n=3)} AS s, {_FULL.format(x="close", w=_W, p=6, n=7)} AS l, {_FULL.format(x="volume", w=_W, p=4, n=5)} AS v FROM ({BARS_SQL})))""")
def strategy_signals(spark, d):
    return strategy.signals(bars_1d(spark, d), STRATEGY).select("symbol", "date", "entry", "exit")


PACK = {"pack_a": "mul(amount, log(amplitude))", "pack_b": "neg(ts_maxmin(signed_power(volume, exponent=1.5), 11))", "pack_c": "add(open, delta(ts_sum(volume, 9)), ret_3)", "pack_d": "zscore(ts_pct_change(abs(volume), 7), 9)"}


@query(formulas_sql(PANEL_SQL, {k: convert(v) for k, v in PACK.items()}, 6))
def pack_factors(spark, d):
    f = {k: convert(v) for k, v in PACK.items()}
    return rounded(with_formulas(panel_1d(spark, d), f).select("symbol", "date", *f), 6)


#: Pack expressions by the row's type, the formulas they stand for and their categories.
DIALECT = [("delta({})", "ts_delta({}, 1)", "momentum"), ("neg(ts_std({}, 5))", "(0 - ts_std({}, 5))", "volatility"), ("add({}, delay(open, 2), gap)", "(({} + ts_delay(open, 2)) + (open / ts_delay(close, 1) - 1))", "momentum"), ("log({})", "signed_log({})", "technical"), ("unheard({})", None, "technical"), ("mul({}, volume", None, "volume_price")]
_PICK = "CASE event_id % 6 {} END".format
_CASES = [" ".join(f"WHEN {i} THEN " + ("NULL" if x[k] is None else f"replace('{x[k]}', '{{}}', event_type)" if k < 2 else f"'{x[k]}'") for i, x in enumerate(DIALECT)) for k in range(3)]


@query(f"SELECT expression, formula, CASE WHEN formula IS NULL THEN 'unsupported' ELSE 'converted' END AS status, category, count(*) AS uses FROM (SELECT {_PICK(_CASES[0])} AS expression, {_PICK(_CASES[1])} AS formula, {_PICK(_CASES[2])} AS category FROM events) GROUP BY ALL")
def pack_conversions(spark, d):
    texts = F.array(*[F.lit(x[0]) for x in DIALECT])
    e = table(spark, d, "events").select(F.replace(texts[(F.col("event_id") % 6).cast("int")], F.lit("{}"), F.col("event_type")).alias("expression"))
    e = e.groupBy("expression").agg(F.count(F.lit(1)).alias("uses"))  # each expression is read once
    return with_conversions(e).select("expression", "formula", "status", "category", "uses")


@query(formulas_sql(PANEL_SQL, {k: INDICATORS[k] for k in ("ma5", "rsi6", "atr14")}, 5).replace("symbol, date", "symbol, date, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in registry.BAR[2:]), 1))
def chosen_indicators(spark, d):
    return rounded(registry.chosen_indicators(panel_1d(spark, d), [" MA5", "rsi6", "ATR14", "close"]), 5)


@query(f"""SELECT symbol, date, CASE WHEN lots = prev THEN 'hold' WHEN prev = 0 THEN 'entry' WHEN lots = 0 THEN 'exit' WHEN sign(lots) <> sign(prev) THEN 'flip' ELSE 'rebalance' END AS label FROM (
 SELECT symbol, date, lots, lag(lots, 1, 0) {_W}) AS prev FROM (SELECT symbol, date, CAST(floor(close) % 5 - 2 AS INT) AS lots FROM ({BARS_SQL})))""")
def order_labels(spark, d):
    b = bars_1d(spark, d).withColumn("lots", (F.floor("close") % 5 - 2).cast("int"))
    b = b.withColumn("prev", F.lag("lots", 1, 0).over(seq()))
    return b.select("symbol", "date", strategy.order_labels(F.col("lots"), F.col("prev")).alias("label"))
