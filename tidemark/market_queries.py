"""Queries of stored bars, contracts, panels and everyday market operators, added to those of ``queries``."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.library import FACTORS
from tidemark.operators import continuous as C
from tidemark.operators import desk as D
from tidemark.operators import market as M
from tidemark.operators import quality as Q
from tidemark.plans.formula import with_formulas
from tidemark.plans.formula_sql import formulas_sql
from tidemark.queries import DIGITS, query, rounded
from tidemark.sources import store
from tidemark.sources.market import BARS_SQL, HOURS_SQL, PANEL_SQL, bars_1d, bars_1h, contract_of, panel_1d, table
from tidemark.sources.staging import application_dir, file_marks

_STORED: dict[tuple, str] = {}


def stored_bars(spark, d: str) -> DataFrame:
    """The bars of ``d`` as a stored table (1d by S.., 60 by event type), in the shared folder.

    Written by jobs that run here, once per application and state of the events' files; ``staging.clear_staged`` deletes it.
    """
    key = (spark.sparkContext.applicationId, file_marks(spark, f"{d}/events.parquet"))
    if key not in _STORED:
        path = f"{application_dir(spark)}/bars-{uuid.uuid4().hex}"
        days = bars_1d(spark, d).withColumn("period", F.lit("1d")).withColumn("date", F.col("date").cast("timestamp_ntz"))
        hours = bars_1h(spark, d).withColumn("period", F.lit("60")).withColumn("date", F.col("date").cast("timestamp_ntz"))
        store.write_bars(days.unionByName(hours), path)
        _STORED[key] = path
    return store.read_bars(spark, _STORED[key])


_PRICES = ("open", "high", "low", "close", "volume")


@query(f"SELECT symbol, CAST(date AS TIMESTAMP) AS date, open, high, low, close, volume FROM ({BARS_SQL}) WHERE symbol = 'S03' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY date DESC LIMIT 10")
def kline_lookup(spark, d):
    rows = store.lookup(stored_bars(spark, d), "S03", "D", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25), 10)
    return rows.select("symbol", "date", *_PRICES)


@query(f"SELECT symbol, date, open, high, low, close, volume FROM ({HOURS_SQL}) WHERE symbol = 'click' ORDER BY date DESC LIMIT 500")
def kline_hours(spark, d):
    return store.lookup(stored_bars(spark, d), "click", "1h", limit=500, newest_first=False).select("symbol", "date", *_PRICES)


@query(f"(SELECT '1d' AS asked, CAST(date AS TIMESTAMP) AS date, close FROM ({BARS_SQL}) WHERE symbol = 'S03' ORDER BY date DESC LIMIT 5) UNION ALL (SELECT '1h', date, close FROM ({HOURS_SQL}) WHERE symbol = 'S03' ORDER BY date DESC LIMIT 5)")
def multi_period(spark, d):
    return store.multi_period(stored_bars(spark, d), "S03", ["1d", "1h"], 5).select("asked", "date", "close")


# ---------------------------------------------------------------- contracts and main series

_CONTRACT_BARS = f"SELECT *, CAST(substr(symbol, 2) AS INT) AS k, least((day(date) - 1) // 10, 2) AS c FROM ({BARS_SQL})"
_CONTRACTS = "SELECT k * 10 + c AS contract_id, printf('S%02d', k) AS symbol, printf('S%02dC%d', k, c) AS code, printf('S%02d.%d', k, c) AS ts_code, CASE WHEN k % 5 = 0 AND c = 1 THEN 'MAIN' ELSE 'NORMAL' END AS type FROM (SELECT DISTINCT k, c FROM ({}))".format(_CONTRACT_BARS)
_VARIETIES = f"SELECT DISTINCT symbol, CASE WHEN k % 5 IN (0, 1) THEN concat(symbol, 'C0') END AS contract_code FROM ({_CONTRACT_BARS})"
_DAILY = f"SELECT symbol, printf('%s.%d', symbol, c) AS ts_code, 'D' AS period, date, open, high, low, close, volume FROM ({_CONTRACT_BARS}) WHERE k % 5 < 3"
_STORED_BARS = f"SELECT *, CASE WHEN k % 5 = 3 THEN 'D' ELSE '1d' END AS period FROM ({_CONTRACT_BARS})"
_MAIN = f"""WITH c AS ({_CONTRACTS}), v AS ({_VARIETIES}), d AS ({_DAILY}), chosen AS (SELECT v.symbol, coalesce((SELECT min(ts_code) FROM c WHERE c.symbol = v.symbol AND type = 'MAIN'), (SELECT min(ts_code) FROM c WHERE code = v.contract_code)) AS ts_code, EXISTS (SELECT 1 FROM c WHERE c.symbol = v.symbol AND type = 'MAIN') AS typed FROM v),
 most AS (SELECT symbol, ts_code FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, ts_code) AS rn FROM (SELECT symbol, ts_code, count(*) AS n FROM d GROUP BY symbol, ts_code)) WHERE rn = 1),
 every AS (SELECT d.*, CASE WHEN typed THEN 1 ELSE 2 END AS rank, CASE WHEN typed THEN 'main_type' ELSE 'named' END AS source FROM d JOIN chosen USING (symbol, ts_code) UNION ALL SELECT d.*, 3, 'most_rows' FROM d JOIN most USING (symbol, ts_code) UNION ALL SELECT symbol, NULL, period, date, open, high, low, close, volume, CASE period WHEN 'D' THEN 4 ELSE 5 END, concat('bars_', period) FROM ({_STORED_BARS}))
 SELECT symbol, date, open, high, low, close, volume, ts_code AS contract_code, source FROM every WHERE rank = (SELECT min(rank) FROM every x WHERE x.symbol = every.symbol)"""


def _contract_bars(spark, d):
    return bars_1d(spark, d).withColumn("k", F.substring("symbol", 2, 2).cast("int")).withColumn("c", contract_of(F.col("date")))


def _contracts(b):
    return b.select("k", "c", "symbol").distinct().select((F.col("k") * 10 + F.col("c")).alias("contract_id"), "symbol", F.format_string("%sC%d", "symbol", "c").alias("code"), F.format_string("%s.%d", "symbol", "c").alias("ts_code"), F.when((F.col("k") % 5 == 0) & (F.col("c") == 1), "MAIN").otherwise("NORMAL").alias("type"))


def _daily(b):
    return b.where("k % 5 < 3").select("symbol", F.format_string("%s.%d", "symbol", "c").alias("ts_code"), F.lit("D").alias("period"), "date", *_PRICES)


@query(_MAIN)
def main_daily(spark, d):
    b = _contract_bars(spark, d)
    varieties = b.select("symbol", "k").distinct().select("symbol", F.when(F.col("k") % 5 < 2, F.concat("symbol", F.lit("C0"))).alias("contract_code"))
    return store.main_daily(varieties, _contracts(b), _daily(b), b.withColumn("period", F.when(F.col("k") % 5 == 3, "D").otherwise("1d")))


@query(f"SELECT contract_id, date, close FROM ({_DAILY}) JOIN ({_CONTRACTS}) c USING (ts_code) WHERE contract_id = 21")
def contract_daily(spark, d):
    b = _contract_bars(spark, d)
    return store.contract_series(_daily(b), _contracts(b).drop("symbol"), 21).select("contract_id", "date", "close")


@query(f"SELECT b.symbol, date, b.k * 10 + b.c + (CASE WHEN day(date) = 7 THEN 5000 ELSE 0 END) AS contract_id, code AS contract_code FROM ({_CONTRACT_BARS}) b LEFT JOIN ({_CONTRACTS}) c ON c.contract_id = b.k * 10 + b.c + (CASE WHEN day(date) = 7 THEN 5000 ELSE 0 END)")
def bars_with_contract(spark, d):
    b = _contract_bars(spark, d)
    ids = b.withColumn("contract_id", F.col("k") * 10 + F.col("c") + F.when(F.dayofmonth("date") == 7, 5000).otherwise(0))
    return store.with_contract(ids, _contracts(b)).select("symbol", "date", "contract_id", "contract_code")


@query(f"SELECT code, coalesce(a.contract_id, b.contract_id) AS contract_id FROM (SELECT code FROM ({_CONTRACTS}) WHERE contract_id % 3 = 0 UNION ALL SELECT ts_code FROM ({_CONTRACTS}) WHERE contract_id % 3 = 1 UNION ALL SELECT 'X' || contract_id FROM ({_CONTRACTS}) WHERE contract_id % 3 = 2) r LEFT JOIN ({_CONTRACTS}) a USING (code) LEFT JOIN ({_CONTRACTS}) b ON b.ts_code = r.code")
def resolved_codes(spark, d):
    c = _contracts(_contract_bars(spark, d))
    n = F.col("contract_id") % 3
    rows = c.select(F.when(n == 0, F.col("code")).when(n == 1, F.col("ts_code")).otherwise(F.concat(F.lit("X"), F.col("contract_id").cast("string"))).alias("code"))
    return M.resolved(rows, c.select("contract_id", F.col("code").alias("symbol"), "ts_code"))


@query(f"SELECT symbol, date, CASE WHEN day(date) % 4 = 0 THEN (SELECT c FROM ({_CONTRACT_BARS}) x WHERE x.symbol = b.symbol AND x.date <= b.date ORDER BY x.date DESC LIMIT 1) ELSE c END AS contract FROM ({_CONTRACT_BARS}) b")
def contracts_backfilled(spark, d):
    b = _contract_bars(spark, d)
    starts = b.withColumn("before", F.lag("c").over(Window.partitionBy("symbol").orderBy("date"))).where("before IS NULL OR before <> c")
    segments = starts.select("symbol", F.col("c").alias("contract"), F.col("date").alias("start"), F.lead("date").over(Window.partitionBy("symbol").orderBy("date")).alias("end"))
    holes = b.select("symbol", "date", F.when(F.dayofmonth("date") % 4 != 0, F.col("c")).alias("contract"))
    return store.backfill_contracts(holes, segments)


# ---------------------------------------------------------------- panel

_TWICE = f"SELECT symbol, c AS contract_id, printf('%s.%d', symbol, c) AS ts_code, date, unnest(CASE WHEN day(date) % 3 = 0 THEN ['D', '1d'] WHEN day(date) % 3 = 1 THEN ['D'] ELSE ['1d'] END) AS period, close, volume, CASE WHEN day(date) % 2 = 0 THEN amount END AS amount FROM ({_CONTRACT_BARS})"
_EXTRA = f"SELECT printf('%s.%d', symbol, c) AS ts_code, date, amount * 2 AS amount, volume * 3 AS open_interest, close AS settle FROM ({_CONTRACT_BARS}) WHERE day(date) % 5 <> 0"


@query(f"""SELECT symbol, contract_id, date, round(close + CASE period WHEN 'D' THEN 1000 ELSE 0 END, 6) AS close, round(coalesce(t.amount, e.amount, (close + CASE period WHEN 'D' THEN 1000 ELSE 0 END) * volume), 6) AS amount, e.open_interest, round(settle, 6) AS settle, CASE WHEN t.amount IS NOT NULL THEN 'bar' WHEN e.amount IS NOT NULL THEN 'daily' ELSE 'estimate' END AS amount_from, contract_id AS lineage_contract
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, contract_id, date ORDER BY period = 'D') AS rn FROM ({_TWICE})) WHERE rn = 1) t LEFT JOIN ({_EXTRA}) e USING (ts_code, date)""")
def panel_source(spark, d):
    b = _contract_bars(spark, d)
    code, day = F.format_string("%s.%d", "symbol", "c").alias("ts_code"), F.dayofmonth("date")
    periods = F.when(day % 3 == 0, F.array(F.lit("D"), F.lit("1d"))).when(day % 3 == 1, F.array(F.lit("D"))).otherwise(F.array(F.lit("1d")))
    rows = b.select("symbol", F.col("c").alias("contract_id"), code, "date", F.explode(periods).alias("period"), "close", "volume", F.when(day % 2 == 0, F.col("amount")).alias("amount"), F.lit(None).cast("double").alias("open_interest"))
    rows = rows.withColumn("close", F.col("close") + F.when(F.col("period") == "D", 1000).otherwise(0))
    extra = b.where(day % 5 != 0).select(code, "date", (F.col("amount") * 2).alias("amount"), (F.col("volume") * 3).alias("open_interest"), F.col("close").alias("settle"))
    r = store.panel_source(rows, extra)
    return rounded(r.select("symbol", "contract_id", "date", "close", "amount", "open_interest", "settle", F.get_json_object("flags", "$.amount").alias("amount_from"), F.get_json_object("lineage", "$.contract_id").cast("int").alias("lineage_contract")))


@query(f"SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT symbol) AS symbols, array_to_string(list_sort(list(DISTINCT CASE WHEN volume > 1 THEN 'good' ELSE 'warning' END)), ',') AS quality FROM ({BARS_SQL}) WHERE symbol IN ('S01', 'S02') AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'")
def panel_lineage(spark, d):
    p = bars_1d(spark, d).withColumn("quality", F.when(F.col("volume") > 1, "good").otherwise("warning"))
    return store.panel_slice(p, ["S01", "S02"], dt.date(2024, 1, 3), dt.date(2024, 1, 20))[1]


@query(f"SELECT symbol, date, close FROM ({BARS_SQL}) WHERE symbol IN (SELECT symbol FROM ({BARS_SQL}) GROUP BY symbol HAVING count(close) >= 28)")
def symbols_with_enough_bars(spark, d):
    return store.with_enough_bars(bars_1d(spark, d), 28).select("symbol", "date", "close")


@query(f"SELECT 'lineage_missing' AS \"check\", 'warning' AS severity, count(*) AS count FROM ({BARS_SQL}) WHERE day(date) % 9 = 0 UNION ALL SELECT 'non_positive_price', 'bad', count(*) FROM ({BARS_SQL}) WHERE least(open, high, low, close) - 5 <= 0 UNION ALL SELECT 'unexplained_contract', 'bad', count(*) FROM (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY date) AS b FROM ({_CONTRACT_BARS})) WHERE b <> c AND day(date) <> 11")
def panel_checks(spark, d):
    b = _contract_bars(spark, d).withColumns({c: F.col(c) - 5 for c in ("open", "high", "low", "close")}).withColumn("lineage", F.when(F.dayofmonth("date") % 9 != 0, "x")).withColumnRenamed("c", "contract")
    rolls = b.where(F.dayofmonth("date") == 11).select("symbol", "date")
    return M.panel_checks(b, rolls)


@query(f"SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE volume = 0) AS zero_volume, count(*) FILTER (WHERE high - 1 < greatest(open, close, low) OR low > least(open, close)) AS invalid, count(*) >= 29 AND count(*) FILTER (WHERE volume = 0) = 0 AND count(*) FILTER (WHERE high - 1 < greatest(open, close, low) OR low > least(open, close)) = 0 AS complete FROM ({BARS_SQL}) GROUP BY symbol")
def daily_verification(spark, d):
    return M.verification(bars_1d(spark, d).withColumn("high", F.col("high") - 1), 29)


@query("""WITH c AS (SELECT * FROM orders WHERE o_orderkey % 50 <> 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 70 = 1), n AS (SELECT o_orderstatus AS g, o_orderkey AS k, count(*) AS n FROM c GROUP BY ALL)
 SELECT g AS o_orderstatus, rows, copied, missing, CAST(0 AS BIGINT) AS extra, same_bounds, duplicates, coalesce(orphans, 0) AS orphans FROM (SELECT o.o_orderstatus AS g, count(*) AS rows, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS copied, count(*) FILTER (WHERE n.n IS NULL) AS missing, min(o_orderkey) = min(n.k) AND max(o_orderkey) = max(n.k) AS same_bounds, CAST(sum(greatest(coalesce(n.n, 0) - 1, 0)) AS BIGINT) AS duplicates FROM orders o LEFT JOIN n ON n.g = o.o_orderstatus AND n.k = o.o_orderkey GROUP BY 1)
 LEFT JOIN (SELECT o_orderstatus AS g, count(*) AS orphans FROM c WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 <> 0) GROUP BY 1) USING (g)""")
def copy_rehearsal(spark, d):
    o = table(spark, d, "orders")
    copy = o.where("o_orderkey % 50 <> 0").unionByName(o.where("o_orderkey % 70 = 1"))
    parents = table(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.rehearsal(o, copy, ["o_orderkey"], "o_orderstatus", parents, "o_custkey")


# ---------------------------------------------------------------- cleaning, filters, limits


@query(f"SELECT symbol, date, round(close, 6) AS close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY amount, close, open) AS rn FROM (SELECT *, high - CASE WHEN day(date) % 6 = 0 THEN 500 ELSE 0 END AS h FROM ({BARS_SQL})) WHERE low >= 0 AND h >= greatest(open, close, low) AND low <= least(open, close) AND volume >= 0) WHERE rn = 1")
def cleaned_bars(spark, d):
    b = bars_1d(spark, d).withColumn("high", F.col("high") - F.when(F.dayofmonth("date") % 6 == 0, 500).otherwise(0))
    return rounded(Q.clean(b).select("symbol", "date", "close", "volume"))


_QUOTES = "SELECT user_id, last(value ORDER BY ts, event_id) AS price, first(value ORDER BY ts, event_id) AS prev_close FROM events GROUP BY user_id"


def _quotes(spark, d):
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", order).alias("price"), F.min_by("value", order).alias("prev_close"))


@query(f"SELECT printf('U%d', user_id) AS symbol, round(price - 10, 6) AS price, round(CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE (price - 10 - prev_close) / nullif(CASE WHEN prev_close > 0 THEN prev_close END, 0) * 100 END, 6) AS change_percent FROM ({_QUOTES}) WHERE price - 10 > 0")
def cleaned_quotes(spark, d):
    q = _quotes(spark, d).select(F.format_string("U%d", "user_id").alias("symbol"), (F.col("price") - 10).alias("price"), "prev_close", F.when(F.col("user_id") % 3 == 0, 1.5).alias("change_percent"))
    return rounded(M.clean_quotes(q).select("symbol", "price", "change_percent"))


@query(f"SELECT user_id, round(price, 6) AS price FROM ({_QUOTES}) WHERE user_id % 4 <> 0 AND price < prev_close")
def falling_quotes(spark, d):
    q = _quotes(spark, d).withColumn("change_percent", F.col("price") - F.col("prev_close")).withColumn("price", F.when(F.col("user_id") % 4 != 0, F.col("price")))
    return rounded(M.moving(q, "down").select("user_id", "price"))


@query(f"SELECT symbol AS ts_code, CAST(date AS TIMESTAMP) AS date, CAST(round(open, 2) AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS volume FROM ({BARS_SQL})")
def provider_rows(spark, d):
    raw = bars_1d(spark, d).select(F.col("symbol").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), *[F.round(c, 2).cast("string").alias(c) for c in ("open", "high", "low", "close", "amount")], F.lit("").alias("vol"), F.lit("x").alias("oi"))
    return M.adapt(raw, M.PROVIDERS["daily"]).select("ts_code", F.col("date").cast("timestamp_ntz").alias("date"), "open", "volume")


@query("SELECT event_id, CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def finite_values(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 5 == 1, float("nan")).otherwise(F.col("value"))
    return M.finite(table(spark, d, "events").select("event_id", v.alias("value")))


@query("SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) + 1 END, CAST(ts AS DATE)) >= DATE '2024-01-20'")
def since_trading_date(spark, d):
    e = table(spark, d, "events").withColumn("trading_date", F.when(F.col("event_id") % 2 == 0, F.date_add(F.to_date("ts"), 1)))
    return M.since(e, dt.date(2024, 1, 20)).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1') AND NOT EXISTS (SELECT 1 FROM part WHERE starts_with(p_brand, 'None#')) ")
def by_prefix(spark, d):
    return M.by_prefix(table(spark, d, "part"), "p_brand", "None#", "Brand#1", "Brand").select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0 OR o_custkey = 7")
def visible_rows(spark, d):
    o = table(spark, d, "orders").withColumn("owner", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    return M.visible(o, 7).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")
def clamped_limit(spark, d):
    return M.clamped(table(spark, d, "orders").orderBy("o_orderkey"), 5000).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 3")
def sampled_documents(spark, d):
    return M.sampled(table(spark, d, "documents"), "doc_id", 10, 3).select("doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS balance FROM supplier ORDER BY coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END, 0) DESC, s_suppkey LIMIT 20")
def sorted_page(spark, d):
    s = table(spark, d, "supplier").withColumn("balance", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")))
    return M.ordered_by(s, "balance", {"balance"}, True, "s_suppkey").limit(20).select("s_suppkey", "balance")


@query("SELECT event_id, round_even(value / 0.25, 0) * 0.25 AS price FROM events")
def tick_prices(spark, d):
    return table(spark, d, "events").select("event_id", M.to_tick(F.col("value"), 0.25).alias("price"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value * 2 END) AS price, CASE event_id % 3 WHEN 0 THEN 'last' WHEN 1 THEN 'settle' ELSE 'unavailable' END AS source FROM events")
def price_sources(spark, d):
    price, source = M.source_of(("last", F.when(F.col("event_id") % 3 == 0, F.col("value"))), ("settle", F.when(F.col("event_id") % 3 == 1, F.col("value") * 2)))
    return table(spark, d, "events").select("event_id", price.alias("price"), source.alias("source"))


# ---------------------------------------------------------------- joins and aggregates


@query(f"SELECT symbol, date, coalesce(CASE WHEN day(date) % 2 = 0 THEN amount END, CASE WHEN day(date) % 3 = 0 THEN volume END) AS amount FROM ({BARS_SQL})")
def supplemented_bars(spark, d):
    b, day = bars_1d(spark, d), F.dayofmonth("date")
    daily = b.where(day % 3 == 0).select("symbol", "date", F.col("volume").alias("amount"))
    return M.supplemented(b.select("symbol", "date", F.when(day % 2 == 0, F.col("amount")).alias("amount")), daily, ["symbol", "date"], ["amount"])


@query("SELECT o_orderkey AS event_id, CASE WHEN l.n IS NOT NULL THEN 'read' END AS state FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, 1 AS n FROM lineitem WHERE l_suppkey = 3) l ON l_orderkey = o_orderkey")
def events_with_state(spark, d):
    states = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("user_id"), F.lit("read").alias("state")).distinct()
    return M.with_user_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), states, 3)


@query(f"SELECT symbol, round(close * 1.02, 6) AS price, round(close, 6) AS close, round(abs(close * 1.02 - close) / close, 6) AS deviation FROM (SELECT symbol, arg_max(close, date) AS close FROM ({BARS_SQL}) GROUP BY symbol) WHERE CAST(substr(symbol, 2) AS INT) % 2 = 0 AND close <> 0")
def deviating_quotes(spark, d):
    b = bars_1d(spark, d)
    quotes = b.groupBy("symbol").agg(F.max_by("close", "date").alias("price")).withColumn("price", F.col("price") * F.when(F.substring("symbol", 2, 2).cast("int") % 2 == 0, 1.02).otherwise(1.001))
    return rounded(M.deviating(quotes, b))


@query(f"SELECT place, a.symbol, round(close, 6) AS close, close IS NOT NULL AS found FROM (SELECT unnest([0, 1, 2]) AS place, unnest(['S05', 'S99', 'S01']) AS symbol) a LEFT JOIN (SELECT symbol, arg_max(close, date) AS close FROM ({BARS_SQL}) GROUP BY symbol) USING (symbol)")
def batch_lookup(spark, d):
    asked = spark.createDataFrame([(0, "S05"), (1, "S99"), (2, "S01")], "place int, symbol string")
    last = bars_1d(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    return rounded(M.looked_up(asked, last).select("place", "symbol", "close", "found"))


@query("SELECT c_custkey AS key, 'segment' AS kind, c_mktsegment AS value FROM customer WHERE c_custkey < 50 UNION ALL SELECT o_custkey, 'order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey < 50")
def user_summary(spark, d):
    return M.tagged_union({"segment": table(spark, d, "customer").where("c_custkey < 50").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), "order": table(spark, d, "orders").where("o_custkey < 50").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("v"))}, "k", "v")


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority)) WHERE rn = 1")
def most_frequent(spark, d):
    return M.most_frequent(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM (SELECT * FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 500) GROUP BY 1")
def latest_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return rounded(M.latest_rollup(o, 500, "day", "o_orderkey", "o_totalprice"), 4)


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def category_list(spark, d):
    return table(spark, d, "part").select("p_type").distinct().orderBy("p_type")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value), 6) AS mean_seconds, max(ts) FILTER (WHERE event_type <> 'error') AS last_success FROM events WHERE ts >= TIMESTAMP '2024-01-24 12:00:00'")
def collection_health(spark, d):
    runs = table(spark, d, "events").select("ts", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("seconds"))
    return rounded(M.collection_health(runs, dt.datetime(2024, 1, 25, 12), 24))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE age > 100000) AS stale, CASE WHEN count(*) FILTER (WHERE age > 100000) = 0 THEN 'healthy' WHEN count(*) FILTER (WHERE age > 100000) / count(*) <= 0.2 THEN 'degraded' ELSE 'unhealthy' END AS state FROM (SELECT epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) AS age FROM events GROUP BY user_id)")
def service_health(spark, d):
    now = int(dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc).timestamp())
    ages = table(spark, d, "events").groupBy("user_id").agg((F.lit(now) - F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("age"))
    return M.health(ages, 100_000)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'idiot|moron') THEN 'critical' WHEN regexp_matches(text, 'clown|trash') THEN 'high' END AS severity FROM documents")
def keyword_severity(spark, d):
    return table(spark, d, "documents").select("doc_id", M.severity(F.col("text"), "idiot|moron", "clown|trash").alias("severity"))


@query("SELECT count(*) AS n, count(DISTINCT (p_brand, p_size)) AS \"distinct\", round(count(DISTINCT (p_brand, p_size)) / count(*), 6) AS diversity FROM part")
def population_diversity(spark, d):
    return rounded(M.diversity(table(spark, d, "part"), ["p_brand", "p_size"]))


@query("SELECT url, min(left(html, 40)) AS title, substr(min_by(left(html, 200), left(html, 40)), 1, 50) AS body FROM pages WHERE url IS NOT NULL AND page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL) GROUP BY url")
def new_articles(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.substring("html", 1, 40).alias("title"), F.substring("html", 1, 200).alias("body"))
    return M.new_articles(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0"), 50)


@query("WITH RECURSIVE t(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer) e ON e.parent = t.node) SELECT node, depth FROM t")
def recursive_walk(spark, d):
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return M.children_of(edges, 1).select(F.col("node").cast("long").alias("node"), "depth")


@query("""WITH e AS (SELECT user_id AS source, event_id, value <= 60 AS ok, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER s >= 200000 AS late FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, list_reduce(list_prepend({'n': 0, 'ok': true, 'late': false}, list({'n': 0, 'ok': ok, 'late': coalesce(late, false)}) OVER (PARTITION BY source ORDER BY event_order ROWS UNBOUNDED PRECEDING)),
  lambda s, x: {'n': CASE WHEN x.ok THEN 0 WHEN s.n >= 5 AND s.n < 10 AND x.late THEN 1 ELSE least(s.n + 1, 10) END, 'ok': x.ok, 'late': x.late}).n AS after FROM (SELECT e.*, row_number() OVER (PARTITION BY source ORDER BY ts, e.event_id) AS event_order FROM e JOIN (SELECT event_id, ts FROM events) t USING (event_id)))
 SELECT source, event_id AS call_id, after >= 5 AS tripped, before >= 10 OR before >= 5 AND NOT coalesce(late, false) AS open FROM (SELECT *, lag(after, 1, 0) OVER (PARTITION BY source ORDER BY event_order) AS before FROM c)""")
def breaker_states(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("call_id"), (F.col("value") <= 60).alias("ok"))
    return M.breaker(calls, 200_000).select("source", "call_id", "tripped", "open")


_POSITIONS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, 50.0 AS price, close AS now FROM orders JOIN (SELECT symbol, arg_max(close, date) AS close FROM ({BARS_SQL}) GROUP BY symbol) ON symbol = printf('S%02d', o_orderkey % 20)"


@query(f"SELECT o_orderkey, round((CASE side WHEN 'long' THEN 1 ELSE -1 END) * (now - price) * 20, 6) + 0.0 AS pnl, round((CASE side WHEN 'long' THEN 1 ELSE -1 END) * (now - price) * 20 / (price * 20) * 100, 6) + 0.0 AS pnl_pct FROM ({_POSITIONS})")
def unrealised_profit(spark, d):
    last = bars_1d(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("now"))
    p = table(spark, d, "orders").select("o_orderkey", F.format_string("S%02d", (F.col("o_orderkey") % 20).cast("int")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"), F.lit(2.0).alias("lots"), F.lit(50.0).alias("price"))
    return rounded(D.unrealised(p.join(last, "symbol")).select("o_orderkey", "pnl", "pnl_pct"))


_ALL = formulas_sql(PANEL_SQL, {n: FACTORS[n] for n in FACTORS}, 12)


@query(f"SELECT symbol, date, {', '.join(f'round({n}, {DIGITS.get(f'factor_{n}', 6)}) + 0.0 AS {n}' for n in FACTORS)} FROM ({_ALL})")
def all_factors(spark, d):
    r = with_formulas(panel_1d(spark, d), FACTORS)
    return r.select("symbol", "date", *[(F.round(n, DIGITS.get(f"factor_{n}", 6)) + F.lit(0.0)).alias(n) for n in FACTORS])


_CODE = "printf('%s25%02d', symbol, c)"


@query(f"SELECT symbol, date AS effective, {_CODE.replace('c)', '1)')} AS old_contract, {_CODE} AS new_contract FROM ({_CONTRACT_BARS}) WHERE c = 2 AND k % 4 <> 0")
def mapped_rolls(spark, d):
    b = _contract_bars(spark, d)
    mapping = b.select("symbol", F.format_string("%s25%02d", "symbol", "c").alias("mapped"), "date")
    current = b.select("symbol").distinct().select("symbol", F.concat("symbol", F.lit("2501")).alias("contract"))
    known = b.where("k % 4 <> 0").select(F.format_string("%s25%02d", "symbol", "c").alias("code"))
    return C.mapped_rolls(mapping, current, known)


@query(f"SELECT DISTINCT date, CASE WHEN nxt = DATE '2024-01-15' THEN DATE '2024-01-16' ELSE nxt END AS next_date FROM (SELECT date, CAST(date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS nxt FROM ({BARS_SQL}))")
def next_trading_days(spark, d):
    return bars_1d(spark, d).select("date").distinct().select("date", C.next_trading_day(F.col("date"), [dt.date(2024, 1, 15)]).alias("next_date"))


@query("SELECT event_id, CASE WHEN m >= 540 AND m < 615 OR m >= 630 AND m < 690 THEN 'morning' WHEN m >= 810 AND m < 900 THEN 'afternoon' WHEN m >= 1260 OR m < 150 THEN 'night' ELSE 'closed' END AS session FROM (SELECT event_id, (hour(ts) * 60 + minute(ts) + 480) % 1440 AS m FROM events)")
def session_states(spark, d):
    return table(spark, d, "events").select("event_id", C.session_state(F.col("ts")).alias("session"))
