"""Stored bars: partitioned by period and symbol, looked up by period alias, symbol, range and number of rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.continuous import SEGMENT_DAYS
from tidemark.operators.intervals import interval_join
from tidemark.sources.staging import read_text, swap_text

#: The names under which bars of a period may be stored.
PERIODS = {name: group for group in (("1m", "1"), ("5m", "5"), ("15m", "15"), ("30m", "30"), ("1h", "60"), ("1d", "D"), ("1w", "W"), ("M",)) for name in group}


def candidates(period: str) -> list[str]:
    """A period's names, the one asked for first."""
    return [period, *(p for p in PERIODS.get(period, ()) if p != period)]


def write_bars(bars: DataFrame, path: str) -> None:
    """Stores bars (period, symbol, date, ...) and, beside them, their schema; a rebuild replaces the partitions that it has
    rows of."""
    ordered = bars.repartition("period", "symbol").sortWithinPartitions("period", "symbol", "date")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "symbol").parquet(path)
    parts = [f for f in bars.schema.fields if f.name not in ("period", "symbol")]
    swap_text(bars.sparkSession, f"{path}/_schema", T.StructType([*parts, T.StructField("period", T.StringType()), T.StructField("symbol", T.StringType())]).json())


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars; period and symbol are text, whatever their values look like (1d would pass for a number)."""
    kept = read_text(spark, f"{path}/_schema")
    if kept:
        return spark.read.schema(T.StructType.fromJson(json.loads(kept))).parquet(path)
    found = spark.read.parquet(path).schema  # of bars that were stored by others
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("period", "symbol") else f for f in found])
    return spark.read.schema(text).parquet(path)


def lookup(stored: DataFrame, symbol: str, period: str, start=None, end=None, limit: int = 1000, newest_first: bool = True) -> DataFrame:
    """The latest ``limit`` bars of a symbol in a range, under the first name of the period that has any there.

    Period and symbol prune partitions, the range is pushed down to the files, and the limit is a top-k.
    """
    names = candidates(period)
    rows = stored.where(F.col("period").isin(names) & (F.col("symbol") == symbol))
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    if len(names) > 1:  # a top-k of each name; of at most three times ``limit`` rows the first name's stay
        tops = [rows.where(F.col("period") == n).orderBy(F.desc("date")).limit(limit).withColumn("_rank", F.lit(i)) for i, n in enumerate(names)]
        every = reduce(DataFrame.unionByName, tops)
        rows = every.withColumn("_best", F.min("_rank").over(Window.partitionBy())).where("_rank = _best").drop("_rank", "_best")
    latest = rows.orderBy(F.desc("date")).limit(limit)
    return latest if newest_first else latest.orderBy("date")


def multi_period(stored: DataFrame, symbol: str, periods: list[str], limit: int) -> DataFrame:
    """The latest bars of a symbol in several periods, ``asked`` being the period's name in the call."""
    parts = [lookup(stored, symbol, p, limit=limit).withColumn("asked", F.lit(p)) for p in periods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- contracts


def with_contract(bars: DataFrame, contracts: DataFrame) -> DataFrame:
    """Bars with the contract's code; bars of an unknown contract keep their id alone."""
    return bars.join(contracts.select("contract_id", F.col("code").alias("contract_code")), "contract_id", "left")


def contract_series(daily: DataFrame, contracts: DataFrame, contract_id: int, limit: int = 5000) -> DataFrame:
    """The latest daily bars of one contract, found by its exchange code, in order of date."""
    one = contracts.where(F.col("contract_id") == contract_id).select("contract_id", "ts_code")
    return daily.where(F.col("period") == "D").join(F.broadcast(one), "ts_code").orderBy(F.desc("date")).limit(limit).orderBy("date")


def main_daily(varieties: DataFrame, contracts: DataFrame, daily: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, date, open, high, low, close, volume, contract_code, source): every variety's main daily series.

    Of the sources in this order the first with rows is a variety's: the contract of type MAIN; the contract that the
    variety names; the exchange code with most daily rows, of equal ones the least; its bars of period D; those of 1d.
    ``varieties`` has symbol and contract_code; ``contracts`` contract_id, symbol, code, ts_code and type; ``daily``
    symbol, ts_code, date and prices. All varieties are resolved at once.
    """
    named = varieties.join(contracts.select("code", F.col("ts_code").alias("named")), F.col("contract_code") == F.col("code"), "left").groupBy("symbol").agg(F.min("named").alias("named"))
    typed = contracts.where(F.col("type") == "MAIN").groupBy("symbol").agg(F.min("ts_code").alias("typed"))
    chosen = varieties.select("symbol").distinct().join(typed, "symbol", "left").join(named, "symbol", "left").withColumn("ts_code", F.coalesce("typed", "named"))
    most = daily.groupBy("symbol", "ts_code").count().groupBy("symbol").agg(F.min(F.struct((-F.col("count")).alias("n"), "ts_code")).alias("m")).select("symbol", F.col("m.ts_code").alias("ts_code"))
    price = ("symbol", "date", "open", "high", "low", "close", "volume")
    of = lambda codes, source, rank: daily.join(codes.where("ts_code IS NOT NULL").select("symbol", "ts_code"), ["symbol", "ts_code"]).select(*price, F.col("ts_code").alias("contract_code"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))
    named_source = of(chosen.where("typed IS NOT NULL"), "main_type", 1).unionByName(of(chosen.where("typed IS NULL"), "named", 2))
    aggregated = bars.where(F.col("period").isin("D", "1d")).join(varieties.select("symbol").distinct(), "symbol", "left_semi").select(*price, F.lit(None).cast("string").alias("contract_code"), F.concat(F.lit("bars_"), F.col("period")).alias("source"), F.when(F.col("period") == "D", 4).otherwise(5).alias("rank"))
    every = named_source.unionByName(of(most, "most_rows", 3)).unionByName(aggregated)
    best = F.min("rank").over(Window.partitionBy("symbol"))  # the sources are read once
    return every.withColumn("_best", best).where("rank = _best").drop("rank", "_best")


# ---------------------------------------------------------------- panel


def panel_source(bars: DataFrame, supplement: DataFrame) -> DataFrame:
    """Daily bars (symbol, contract_id, ts_code, date, period, prices, volume, amount, open_interest), one per contract and
    date, ``1d`` before ``D``, with amount and open interest from (ts_code, date, amount, open_interest, settle) where a bar
    has none, then by estimate; ``flags`` says what came from where and ``lineage`` which contract.
    """
    one = bars.where(F.col("period").isin("1d", "D")).groupBy("symbol", "contract_id", "date").agg(F.min_by(F.struct(*[c for c in bars.columns if c not in ("symbol", "contract_id", "date")]), F.when(F.col("period") == "1d", 0).otherwise(1)).alias("b")).select("symbol", "contract_id", "date", "b.*")
    s = supplement.select("ts_code", "date", F.col("amount").alias("_amount"), F.col("open_interest").alias("_oi"), "settle")
    r = one.join(s, ["ts_code", "date"], "left")
    estimate = F.col("close") * F.col("volume")
    sources = F.create_map(
        F.lit("amount"), F.when(F.col("amount").isNotNull(), "bar").when(F.col("_amount").isNotNull(), "daily").when(estimate.isNotNull(), "estimate").otherwise("unavailable"),
        F.lit("open_interest"), F.when(F.col("open_interest").isNotNull(), "bar").when(F.col("_oi").isNotNull(), "daily").otherwise("unavailable"), F.lit("settlement"), F.when(F.col("settle").isNotNull(), "daily").otherwise("unavailable"))
    r = r.withColumn("flags", F.to_json(sources)).withColumn("lineage", F.to_json(F.struct("contract_id", F.lit("bars").alias("view"))))
    return r.withColumns({"amount": F.coalesce("amount", "_amount", estimate), "open_interest": F.coalesce("open_interest", "_oi")}).drop("_amount", "_oi", "period")


#: The views of the panel and the one that each is built from.
VIEWS = {"raw_contract": None, "main_continuous": "raw_contract", "main_back_adjusted": "main_continuous", "main_forward_adjusted": "main_continuous"}


def build_order(views: list[str]) -> list[str]:
    """The views asked for and those that they need, each after what it is built from."""
    order: list[str] = []

    def add(view: str) -> None:
        if view not in VIEWS:
            raise ValueError(f"no such view: {view}")
        if VIEWS[view]:
            add(VIEWS[view])
        if view not in order:
            order.append(view)

    for v in views:
        add(v)
    return order


def late_start(start, last_success, rolls: DataFrame) -> Column | None:
    """From which date to rebuild: ``start``, or the earliest effective date of rolls recorded after the last success."""
    first = rolls.where(F.col("created_at") > F.lit(last_success)).agg(F.min("effective").alias("d")).first()[0]
    return start if first is None else min(start, first)


def panel_slice(panel: DataFrame, symbols: list[str], start, end) -> tuple[DataFrame, DataFrame]:
    """Rows of symbols in a range, and one row that says what they are: rows, dates, quality states, contracts."""
    rows = panel.where(F.col("symbol").isin(symbols) & F.col("date").between(F.lit(start), F.lit(end)))
    about = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("symbol").alias("symbols"), F.array_join(F.sort_array(F.collect_set("quality")), ",").alias("quality"))
    return rows, about


def with_enough_bars(panel: DataFrame, least: int) -> DataFrame:
    """The symbols that have ``least`` closes."""
    enough = panel.groupBy("symbol").agg(F.count("close").alias("n")).where(F.col("n") >= least).select("symbol")
    return panel.join(enough, "symbol", "left_semi")


def backfill_contracts(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars without a contract get that of the segment (symbol, contract, start, end; half-open) they lie in."""
    width = SEGMENT_DAYS if dict(bars.dtypes)["date"] == "date" else SEGMENT_DAYS * 86_400
    spans = segments.select("symbol", F.col("contract").alias("_contract"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    j = interval_join(bars, spans, ["symbol"], "date", "_start", "_end", width, "left")
    return j.withColumn("contract", F.coalesce("contract", "_contract")).select(bars.columns)


def with_stored_factors(bars: DataFrame, stored: DataFrame, names: list[str]) -> DataFrame:
    """``bars`` with a column per stored factor, named like it, from (symbol, date, factor, value); null where none is stored.

    Of several values of a factor for a bar the greatest is taken. One shuffle of the values whatever the number of names.
    """
    wide = stored.where(F.col("factor").isin(*names)).groupBy("symbol", "date").agg(*[F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in names])
    return bars.join(wide, ["symbol", "date"], "left")
