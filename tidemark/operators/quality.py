"""Data quality: predicates, checks as small unions, duplicate and calendar gaps, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlc_valid(strict: bool = False) -> Column:
    low = F.col("low") > 0 if strict else F.col("low") >= 0
    ok = low & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(ok, F.lit(False))


def anomaly() -> Column:
    """The kinds of an OHLC anomaly, ``|``-joined; empty for none."""
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return F.concat_ws("|", F.when(h < lo, "high_lt_low"), F.when(h < F.greatest(o, c), "high_below_oc"), F.when(lo > F.least(o, c), "low_above_oc"), F.when(F.least(o, h, lo, c) <= 0, "non_positive_price"))


def clean(bars: DataFrame, order: str = "amount") -> DataFrame:
    """Valid bars, the first by ``order`` per symbol and date; volume not negative."""
    ok = bars.where(ohlc_valid() & (F.col("volume") >= 0))
    first = F.min_by(F.struct(*bars.columns), F.struct(F.col(order), F.col("close"), F.col("open"))).alias("r")
    return ok.groupBy("symbol", "date").agg(first).select("r.*")


def normalised(candles: DataFrame, order: str) -> DataFrame:
    """Candles as a chart needs them: the last by ``order`` per symbol and date, high and low around open and close, volume
    not negative."""
    last = candles.groupBy("symbol", "date").agg(F.max_by(F.struct(*[c for c in candles.columns if c not in ("symbol", "date")]), order).alias("r")).select("symbol", "date", "r.*")
    return last.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"), "volume": F.greatest("volume", F.lit(0.0))})


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def surplus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups with duplicates and the rows beyond the first of each."""
    return duplicates(rows, keys).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def missing_dates(bars: DataFrame, weekdays: bool = True) -> DataFrame:
    """(symbol, date) that a symbol lacks between its first and last bar."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("date"))
    if weekdays:
        days = days.where(F.weekday("date") < 5)
    return days.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def mojibake(text: Column) -> Column:
    """Marks of text decoded with the wrong encoding."""
    return F.coalesce(text.rlike("Ã[\u0080-¿]|â€|�|锟斤拷"), F.lit(False))


def freshness(age_seconds: Column, limit: float) -> Column:
    return F.when(age_seconds.isNull(), "unavailable").when(age_seconds <= limit, "fresh").otherwise("stale")


def coverage(rows: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("n_dates"))


def checks(bars: DataFrame) -> DataFrame:
    """(check, severity, count): one scan for row checks, one aggregation each for duplicates and gaps."""
    row = bars.agg(F.sum((~ohlc_valid()).cast("long")).alias("ohlc"), F.sum((F.coalesce(F.col("volume"), F.lit(0.0)) <= 0).cast("long")).alias("no_volume"))
    a = row.select(F.explode(F.array(F.struct(F.lit("ohlc").alias("check"), F.lit("bad").alias("severity"), F.coalesce("ohlc", F.lit(0)).alias("count")), F.struct(F.lit("no_volume").alias("check"), F.lit("warning").alias("severity"), F.coalesce("no_volume", F.lit(0)).alias("count")))).alias("x")).select("x.*")
    b = duplicates(bars, ["symbol", "date"]).agg(F.count(F.lit(1)).alias("count")).select(F.lit("duplicate").alias("check"), F.lit("bad").alias("severity"), "count")
    c = missing_dates(bars).agg(F.count(F.lit(1)).alias("count")).select(F.lit("missing_weekday").alias("check"), F.lit("info").alias("severity"), "count")
    return a.unionByName(b).unionByName(c)


def score(found: DataFrame) -> DataFrame:
    """One row: 100 less 30 per failed bad check, 12 per warning, 3 per info; and a status."""
    cost = F.sum(F.when(F.col("count") > 0, F.when(F.col("severity") == "bad", 30).when(F.col("severity") == "warning", 12).otherwise(3)).otherwise(0))
    s = found.agg(F.greatest(F.lit(0), 100 - cost).cast("int").alias("score"), F.max(((F.col("severity") == "bad") & (F.col("count") > 0)).cast("int")).alias("bad"))
    return s.select("score", F.when(F.col("bad") == 1, "bad").when(F.col("score") < 90, "warning").otherwise("good").alias("status"))
