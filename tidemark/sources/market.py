"""Market tables from raw events: daily and hourly bars, the dense panel, contracts and rolls.

Every builder is one aggregation with map-side partial results; bars keep one row per symbol and period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, symbol, period) -> DataFrame:
    """OHLC bars of ``value`` by ``ts``, of equal times by ``event_id``: volume counts ticks, amount sums them."""
    order = F.struct("ts", "event_id")
    return ticks.groupBy(symbol.alias("symbol"), period.alias("date")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.sum("value").alias("amount"))


def symbol_of_user():
    return F.format_string("S%02d", (F.col("user_id") % 20).cast("int"))


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "events"), symbol_of_user(), F.to_date("ts"))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", F.col("ts")))


def densify(panel: DataFrame, keys: tuple[str, str] = ("symbol", "date")) -> DataFrame:
    """One row per symbol and observed date, nulls where a symbol has no bar.

    The grid is each symbol's copy of the date list, one array per symbol, so rolling windows count missing cells.
    """
    symbol, date = keys
    dates = panel.agg(F.sort_array(F.collect_set(date)).alias("dates"))
    grid = panel.select(symbol).distinct().join(F.broadcast(dates), F.lit(True)).select(symbol, F.explode("dates").alias(date))
    return grid.join(panel, [symbol, date], "left")


def panel_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(bars_1d(spark, sf_dir))


def contract_of(date):
    """A contract every ten days of a month."""
    return F.least(F.floor((F.dayofmonth(date) - 1) / 10), F.lit(2)).cast("int")


BARS_SQL = """SELECT printf('S%02d', user_id % 20) AS symbol, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2"""
HOURS_SQL = """SELECT event_type AS symbol, date_trunc('hour', ts) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2"""
PANEL_SQL = f"""SELECT s.symbol, d.date, open, high, low, close, volume, amount FROM (SELECT DISTINCT symbol FROM ({BARS_SQL})) s
 CROSS JOIN (SELECT DISTINCT date FROM ({BARS_SQL})) d LEFT JOIN ({BARS_SQL}) b ON b.symbol = s.symbol AND b.date = d.date"""
