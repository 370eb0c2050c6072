"""Queries of symbols in texts, table functions in SQL, provider rows, catalog and payloads, added to those of ``queries``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.table_functions import register
from tidemark.operators.aliases import with_symbols
from tidemark.operators.catalog import catalog, payload_problem, profile
from tidemark.operators.desk import train_and_test
from tidemark.queries import query
from tidemark.sources.market import BARS_SQL, bars_1d, table
from tidemark.sources.providers import adapted, dated_lookup
from tidemark.sources.store import with_stored_factors

#: Names as they occur in the texts; one is a part of another.
NAMES = [("tion", "TN"), ("ention", "EN"), ("nder", "ND"), ("under", "UN"), ("ción", "CI"), ("heit", "HT"), ("keit", "KT"), ("ement", "EM"), ("ing", "IG"), ("anding", "AG"), ("ould", "OU"), ("ever", "EV")]
CATEGORIES = [("license", ["ND", "TN", "XX"]), ("Lorem", ["UN"])]

_CODE = r"(?:^|[^\p{L}\p{N}_])([A-Z]{1,2})(?:$|[^\p{L}\p{N}_])"
_LONGEST = "list_reverse(list_sort(list_transform(list_filter([{names}], lambda x: contains(p, x.name)), lambda x: {{'n': length(x.name), 'k': -x.place, 's': x.symbol}})))[1].s".format(names=", ".join(f"{{'name': '{n}', 'symbol': '{s}', 'place': {i}}}" for i, (n, s) in enumerate(NAMES)))
_ONE = f"coalesce(nullif(regexp_extract(replace(replace(upper(p), 'ß', 'SS'), 'ẞ', 'SS'), '{_CODE}', 1), ''), {_LONGEST})"
_SPLIT = "list_filter(list_transform(CASE WHEN regexp_matches(text, '[，,]') THEN regexp_split_to_array(text, '[，,]') ELSE regexp_split_to_array(text, '和|与|及|以及|、') END, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), parts AS (SELECT doc_id, text, {_SPLIT} AS ps FROM d),
 ones AS (SELECT doc_id, i, {_ONE} AS s FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM parts WHERE len(ps) >= 2)),
 firsts AS (SELECT doc_id, s, min(i) AS i FROM ones WHERE s IS NOT NULL GROUP BY doc_id, s), several AS (SELECT doc_id, string_agg(s, ',' ORDER BY i) AS symbols FROM firsts GROUP BY doc_id),
 whole AS (SELECT doc_id, {_ONE} AS s FROM (SELECT doc_id, text AS p FROM d))
 SELECT doc_id, CASE WHEN contains(d.text, 'license') THEN 'ND,TN,XX' WHEN contains(d.text, 'Lorem') THEN 'UN' ELSE coalesce(several.symbols, whole.s, '') END AS symbols
 FROM d LEFT JOIN several USING (doc_id) LEFT JOIN whole USING (doc_id)""")
def symbols_in_texts(spark, d):
    names = spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(NAMES)], "name string, symbol string, place int")
    groups = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(CATEGORIES)], "keyword string, symbols array<string>, place int")
    return with_symbols(table(spark, d, "documents").select("doc_id", "text"), "text", names, groups).select("doc_id", F.array_join("symbols", ",").alias("symbols"))


def _bars_view(spark, d) -> str:
    """The daily bars under a name of their own for SQL."""
    register(spark)
    name = f"tidemark_bars_{abs(hash(d))}"
    bars_1d(spark, d).createOrReplaceTempView(name)
    return name


@query(f"SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM ({BARS_SQL})) WHERE n <= 4")
def sql_latest_rows(spark, d):
    return spark.sql(f"SELECT symbol, date, close FROM latest_rows(TABLE({_bars_view(spark, d)}) PARTITION BY (symbol) ORDER BY (date DESC), 4)")


@query(f"""SELECT symbol, date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM (
 SELECT symbol, CAST(unnest(generate_series(lag_date + 1, date - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS lag_date FROM ({BARS_SQL}) WHERE day(date) % 5 <> 0) WHERE lag_date IS NOT NULL) WHERE isodow(date) < 6) WHERE n <= 3""")
def sql_missing_weekdays(spark, d):
    name = _bars_view(spark, d)
    return spark.sql(f"SELECT * FROM missing_weekdays_of(TABLE(SELECT * FROM {name} WHERE day(date) % 5 <> 0) PARTITION BY (symbol) ORDER BY (date), 3)")


_AROUND = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"""WITH w AS (SELECT symbol, date, high, low, max(high) {_AROUND} AS h, min(low) {_AROUND} AS l, count(*) {_AROUND} AS n FROM ({BARS_SQL}))
 SELECT symbol, date, 'high' AS kind, high AS price FROM w WHERE n = 5 AND high >= h UNION ALL SELECT symbol, date, 'low', low FROM w WHERE n = 5 AND low <= l""")
def sql_swing_levels(spark, d):
    return spark.sql(f"SELECT * FROM swing_levels(TABLE({_bars_view(spark, d)}) PARTITION BY (symbol) ORDER BY (date), 2)")


@query(f"""WITH b AS (SELECT symbol, date, open - 25 AS open, CASE WHEN day(date) % 9 = 0 THEN NULL ELSE high - 25 END AS high, low - 25 + CASE WHEN day(date) % 7 = 0 THEN 60 ELSE 0 END AS low, close - 25 AS close FROM ({BARS_SQL}))
 SELECT symbol, date, 'price_missing' AS issue FROM b WHERE high IS NULL UNION ALL SELECT symbol, date, 'price_not_positive' FROM b WHERE high IS NOT NULL AND least(open, high, low, close) <= 0
 UNION ALL SELECT symbol, date, 'high_below_low' FROM b WHERE high < low UNION ALL SELECT symbol, date, 'close_outside' FROM b WHERE high >= low AND NOT (close BETWEEN low AND high AND open BETWEEN low AND high)""")
def sql_bar_issues(spark, d):
    name = _bars_view(spark, d)
    moved = f"SELECT symbol, date, open - 25 AS open, IF(day(date) % 9 = 0, NULL, high - 25) AS high, low - 25 + IF(day(date) % 7 = 0, 60, 0) AS low, close - 25 AS close FROM {name}"
    return spark.sql(f"SELECT * FROM bar_issues(TABLE({moved}))")


# ---------------------------------------------------------------- rows of providers

_RAW_SQL = f"""SELECT printf('%s%04d.SHF', substr(symbol, 1, 1) || lower(chr(CAST(65 + CAST(substr(symbol, 2) AS INT) AS INT))), 2400 + CAST(substr(symbol, 2) AS INT)) AS ts_code, symbol, date, close, open, volume,
 CAST(substr(symbol, 2) AS INT) % 5 AS k FROM ({BARS_SQL})"""


def _raw(spark, d):
    b = bars_1d(spark, d).withColumn("n", F.substring("symbol", 2, 2).cast("int"))
    return b.select(F.format_string("%s%s%04d.SHF", F.substring("symbol", 1, 1), F.lower(F.char(65 + F.col("n"))), 2400 + F.col("n")).alias("ts_code"), "symbol", "date", "close", "open", "volume", (F.col("n") % 5).alias("k"))


@query(f"""SELECT CASE WHEN k = 0 THEN upper(regexp_extract(ts_code, '^[A-Za-z]*')) ELSE symbol END AS symbol, round(close, 2) AS current_price, CAST(trunc(volume * 1.5) AS BIGINT) AS volume,
 CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN round(open, 2) ELSE round(close - 1, 2) END AS pre_settlement,
 CASE WHEN k = 1 THEN round((round(close, 2) - round(open, 2)) / round(open, 2) * 100, 2) WHEN k = 2 THEN round((round(close, 2) - round(open, 2)) / round(open, 2) * 100, 2) ELSE round((round(close, 2) - round(close - 1, 2)) / round(close - 1, 2) * 100, 2) END + 0.0 AS change_percent,
 CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR AS updated_at FROM ({_RAW_SQL}) WHERE close > 2 AND open > 1""")
def adapted_quotes(spark, d):
    r = _raw(spark, d).where("close > 2 AND open > 1")
    text = lambda c: F.round(c, 2).cast("string")
    raw = r.select("ts_code", F.when(F.col("k") != 0, F.col("symbol")).otherwise("-").alias("symbol"), text("close").alias("close"), text("open").alias("open"), (F.col("volume") * 1.5).cast("string").alias("vol"),
                   F.when(F.col("k") > 2, text(F.col("close") - 1)).when(F.col("k") == 0, text(F.col("close") - 1)).otherwise("None").alias("pre_close"), F.when(F.col("k") == 2, text("open")).otherwise("").alias("pre_settle"), F.concat(F.date_format("date", "yyyyMMdd"), F.lit(" 09:00:00")).alias("trade_time"))
    a = adapted(raw, "exchange_quote")
    return a.select("symbol", "current_price", "volume", "pre_settlement", (F.col("change_percent") + F.lit(0.0)).alias("change_percent"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""SELECT upper(c) AS ts_code, CASE WHEN p_partkey % 7 = 1 THEN 'MAIN' WHEN p_partkey % 7 = 2 THEN 'CONTINUOUS' WHEN p_partkey % 3 = 0 THEN 'NORMAL' WHEN p_partkey % 3 = 1 THEN 'CONTINUOUS' ELSE 'MAIN' END AS contract_type, p_partkey % 4 <> 0 AS is_active, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS multiplier
 FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'au2506.shf' WHEN 1 THEN 'cul.shf' ELSE 'au.shf' END AS c FROM part)""")
def adapted_contracts(spark, d):
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(F.when(k % 3 == 0, "au2506.shf").when(k % 3 == 1, "cul.shf").otherwise("au.shf").alias("ts_code"), F.when(k % 7 == 1, "沪金主力").when(k % 7 == 2, "沪金连续").alias("name"), F.when(k % 6 == 0, "nan").otherwise(F.col("p_size").cast("string")).alias("multiplier"), F.when(k % 4 == 0, "20240131").when(k % 4 == 1, "2024-02-02").when(k % 4 == 2, "").alias("delist_date"))
    return adapted(raw, "contract", F.to_date(F.lit("2024-01-31"))).select("ts_code", "contract_type", "is_active", "multiplier")


@query(f"SELECT ts_code, CAST(date AS TIMESTAMP) AS trade_date, round(close, 2) AS settle FROM ({_RAW_SQL}) WHERE ts_code SIMILAR TO 'S[ac].*' AND date <= DATE '2024-01-25' ORDER BY date DESC, ts_code LIMIT 30")
def settlements_of(spark, d):
    raw = _raw(spark, d).select("ts_code", F.date_format("date", "yyyy-MM-dd").alias("trade_date"), F.round("close", 2).cast("string").alias("settle"))
    s = adapted(raw, "settlement").select("ts_code", F.col("trade_date").cast("timestamp_ntz").alias("trade_date"), "settle")
    return dated_lookup(s, "ts_code", ["Sa", "Sc"], end=dt.datetime(2024, 1, 25), limit=30, prefix=True)


# ---------------------------------------------------------------- catalog and payloads

_PAYLOAD = """CASE event_id % 9 WHEN 0 THEN '{"n": 1, "n": 2}' WHEN 1 THEN '{"n": 1' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"n": 1, "x": {"y": 2}}' WHEN 4 THEN '{"note": "none"}' WHEN 5 THEN '{"n": 1, "note": "' || repeat('long ', CAST(event_id % 20 AS INT)) || '"}' WHEN 6 THEN NULL WHEN 7 THEN '{"n": {"a": 1, "a": 2}}' ELSE props END"""


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 IN (1, 6) THEN 'malformed' WHEN event_id % 9 IN (0, 7) THEN 'duplicate_key' WHEN event_id % 9 = 2 THEN 'not_object' WHEN event_id % 9 = 5 AND 20 + 5 * (event_id % 20) > 60 THEN 'too_large'
 WHEN event_id % 9 = 3 THEN 'extra_key' WHEN event_id % 9 = 4 THEN 'key_missing' WHEN event_id % 9 = 8 AND len(list_filter(json_keys(props), lambda x: x NOT IN ('n', 'note'))) > 0 THEN 'extra_key' WHEN event_id % 9 = 8 AND NOT list_contains(json_keys(props), 'n') THEN 'key_missing' END AS problem FROM events) GROUP BY problem""")
def payload_problems(spark, d):
    rows = table(spark, d, "events").select(payload_problem(F.expr(_PAYLOAD), ["n", "note"], ["n"], 60).alias("problem"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'events' AS dataset, count(*) AS row_count, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date, count(DISTINCT event_type) AS symbol_count, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT event_type AS s FROM events ORDER BY s LIMIT 10)) AS sample, 'event_id,ts,user_id,event_type,value,props' AS columns, CASE WHEN count(*) FILTER (WHERE value < 0) > 0 THEN 'bad' ELSE 'good' END AS quality FROM events
 UNION ALL SELECT 'orders', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), count(DISTINCT o_custkey), (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS s FROM orders ORDER BY s LIMIT 10)), 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', 'good' FROM orders
 UNION ALL SELECT 'nothing', 0, NULL, NULL, NULL, NULL, 'r_regionkey,r_name', 'empty'""")
def catalog_profiles(spark, d):
    e, o, r = (table(spark, d, t) for t in ("events", "orders", "region"))
    return catalog(profile(e, "events", "ts", "event_type", F.col("value") < 0), profile(o, "orders", "o_orderdate", "o_custkey"), profile(r.where("r_name = 'nowhere'"), "nothing"))


@query(f"SELECT symbol, date, close, CASE WHEN day(date) % 3 <> 0 THEN high - low END AS span, CASE WHEN day(date) % 2 = 0 THEN close * 2 END AS double FROM ({BARS_SQL})")
def stored_factor_columns(spark, d):
    b = bars_1d(spark, d)
    stored = b.where(F.dayofmonth("date") % 3 != 0).select("symbol", "date", F.lit("span").alias("factor"), (F.col("high") - F.col("low")).alias("value"))
    stored = stored.union(b.where(F.dayofmonth("date") % 2 == 0).select("symbol", "date", F.lit("double"), F.col("close") * 2)).union(b.select("symbol", "date", F.lit("other"), F.col("open")))
    return with_stored_factors(b.select("symbol", "date", "close"), stored, ["span", "double"])


@query("""WITH s AS (SELECT o_custkey % 50 AS k, CAST(min(o_orderdate) AS DATE) AS first, CAST(min(o_orderdate) AS DATE) + CAST((o_custkey % 50) * 4 AS INT) AS last FROM orders GROUP BY o_custkey % 50), t AS (SELECT *, last - first AS days, CAST(floor((last - first) * 0.3) AS INT) AS test FROM s)
 SELECT k, CASE WHEN ok THEN first END AS train_start, CASE WHEN ok THEN first + CAST(days - test AS INT) END AS train_end, CASE WHEN ok THEN first + CAST(days - test AS INT) + 1 END AS test_start, CASE WHEN ok THEN last END AS test_end FROM (SELECT *, days >= 60 AND days - test >= 40 AND test - 1 >= 10 AS ok FROM t)""")
def train_test_spans(spark, d):
    k = (F.col("o_custkey") % 50).alias("k")
    spans = table(spark, d, "orders").groupBy(k).agg(F.to_date(F.min("o_orderdate")).alias("first")).withColumn("last", F.date_add("first", (F.col("k") * 4).cast("int")))
    return train_and_test(spans).select("k", "train_start", "train_end", "test_start", "test_end")
