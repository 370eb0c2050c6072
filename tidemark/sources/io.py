"""Sources and sinks: CSV bars, JSON quotes, seeded mock bars, failover, upserts and insert-if-new."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

TIME_NAMES = ("time", "date", "datetime", "trade_date", "trading_time", "timestamp")


def read_bars_csv(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Bars from CSV: the first known time column becomes ``time``; ``last`` keeps the newest rows, in order of time."""
    raw = spark.read.option("header", True).csv(path)
    time = next((c for c in raw.columns if c.lower() in TIME_NAMES), None)
    if time is None:
        raise ValueError(f"no time column among {raw.columns}")
    rest = [F.col(c).try_cast("double").alias(c.lower()) for c in raw.columns if c != time]
    rows = raw.select(F.try_to_timestamp(F.col(time)).alias("time"), *rest)
    return rows.orderBy("time") if last is None else rows.orderBy(F.desc("time")).limit(last).orderBy("time")


def read_quotes_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, price double, change_percent double, volume double, ts string").json(path).withColumn("ts", F.try_to_timestamp("ts"))


def mock_bars(spark: SparkSession, symbols: int, days: int, seed: int = 42) -> DataFrame:
    """A seeded random walk per symbol."""
    grid = spark.range(symbols * days).select(F.format_string("M%02d", (F.col("id") % symbols).cast("int")).alias("symbol"), F.date_add(F.lit("2024-01-01"), F.floor(F.col("id") / symbols).cast("int")).alias("date"), F.randn(seed).alias("z"))
    w = Window.partitionBy("symbol").orderBy("date")
    close = 100 * F.exp(0.01 * F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = grid.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return r.select("symbol", "date", "open", (F.greatest("open", "close") * 1.002).alias("high"), (F.least("open", "close") * 0.998).alias("low"), "close", (1000 + 100 * F.abs("z")).alias("volume"))


def first_with_data(keys: list[str], *sources: DataFrame) -> DataFrame:
    """Rows of the first source, by key, that has any."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = F.min("_rank").over(Window.partitionBy(*keys))
    return ranked.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Stored rows replaced by new ones of equal key; among new ones the last by ``seq`` wins. Null keys are equal."""
    fresh = latest(new, keys, F.col(seq).desc())
    match = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(fresh[k]) for k in keys])
    return stored.join(fresh, match, "left_anti").unionByName(fresh)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """New rows whose key is not stored, the first by ``seq`` of each, to append. Null keys are equal."""
    fresh = latest(new, keys, F.col(seq).asc())
    match = reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(stored[k]) for k in keys])
    return fresh.join(stored, match, "left_anti")


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces only the partitions that ``rows`` has: rebuilding a window twice gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, UTF-8."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_report(rows: DataFrame, path: str, most_bytes: int = 256 << 10) -> None:
    """A small result as lines of JSON; refused if it is larger than a report may be. Written by Spark's committer, whole or
    not at all."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the report has {size} bytes, at most {most_bytes} are allowed")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Factor-pack rows (name, formula, category) of a CSV manifest; blank names go."""
    rows = spark.read.option("header", True).csv(path).where("trim(name) <> ''")
    rows = rows.select(F.trim("name").alias("name"), F.trim("formula").alias("formula"), F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("other")).alias("category"))
    return rows if limit is None else rows.orderBy("name").limit(limit)


def record_run(spark: SparkSession, path: str, job: str, status: str, rows: int | None, started, ended) -> None:
    """Appends one row to the log of ingestion runs."""
    one = [(job, status, rows, started, ended, (ended - started).total_seconds())]
    spark.createDataFrame(one, "job string, status string, rows long, started timestamp, ended timestamp, seconds double").write.mode("append").parquet(path)


def ingest(rows: DataFrame, path: str, runs: str, job: str, mode: str = "append") -> dict:
    """Writes rows as Parquet and logs the run (its rows, and nulls per column, observed by the write itself) in ``runs``.

    A write that fails is logged as failed, without counts, and raised. Returns what was observed.
    """
    seen, started = Observation(), dt.datetime.now()
    nulls = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"null_{c}") for c in rows.columns]
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode(mode).parquet(path)
    except Exception:
        record_run(rows.sparkSession, runs, job, "failed", None, started, dt.datetime.now())
        raise
    record_run(rows.sparkSession, runs, job, "success", seen.get["rows"], started, dt.datetime.now())
    return seen.get
