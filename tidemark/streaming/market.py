"""Structured Streaming: live bars with late data, latest quotes, alerts that fire once, breaker state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files, with the time as an instant (watermarks need one)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("symbol", F.format_string("S%02d", (F.col("user_id") % 20).cast("int")))


def live_bars(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bars of the events so far; events of equal time count in the order of their ids, as in batch bars."""
    w, order = F.window("ts", width), F.struct("ts", "event_id")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "symbol").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def latest_quotes(stream: DataFrame) -> DataFrame:
    """The last value per symbol, of equal times the one of highest id."""
    return stream.groupBy("symbol").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("q")).select("symbol", F.col("q.value").alias("price"), F.col("q.ts").alias("ts"))


def alerts_once(stream: DataFrame, alerts: DataFrame) -> DataFrame:
    """Stream-static join of quotes with alert rules (alert_id, symbol, side, target); state lets each fire once."""
    hit = stream.join(alerts, "symbol").where(((F.col("side") == "above") & (F.col("value") >= F.col("target"))) | ((F.col("side") == "below") & (F.col("value") <= F.col("target"))))

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not state.exists:
            state.update((True,))
            r = rows.sort_values("ts").iloc[0]
            yield pd.DataFrame({"alert_id": [key[0]], "symbol": [r["symbol"]], "ts": [r["ts"]], "value": [r["value"]]})

    return hit.select("alert_id", "symbol", "ts", "value").groupBy("alert_id").applyInPandasWithState(first, "alert_id long, symbol string, ts timestamp, value double", "fired boolean", "append", GroupStateTimeout.NoTimeout)


def new_items(stream: DataFrame, stored: DataFrame, key: str = "url", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Items of a stream, each key once within the watermark, whose key is not stored already."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.join(stored.select(key).distinct(), key, "left_anti")


def polled(result: DataFrame, path: str, checkpoint: str, seconds: int, mode: str = "append"):
    """Starts a stream that looks for new input every so many seconds and appends to a table; returns the running query."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()


def drain(result: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into a memory table and returns that."""
    writer = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return result.sparkSession.table(name)
