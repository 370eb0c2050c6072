"""Live quotes: change markers with timers, tables of latest rows that a replayed batch does not change, snapshots of state.

The stateful operator needs the RocksDB state store; ``with_state_store`` sets it for a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.io import latest
from tidemark.sources.staging import drop_path, names_in, read_text, swap_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which a quote is sent again unchanged, and between signs of life.
REFRESH, HEARTBEAT = 60.0, 30.0
EMITTED = "symbol string, kind string, price double, ts timestamp, sent_ms long"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class ChangeMarker(StatefulProcessor):
    """Per symbol: a ``change`` when a newer quote has another price, a ``refresh`` of the last one when nothing has been
    sent for ``refresh`` seconds, a ``heartbeat`` without values every ``heartbeat`` seconds.

    Quotes that are older than the last one known are late and change nothing, nor do null prices or times; of quotes of
    equal time the highest event_id counts, against the state too. Times are the query's processing times. State is one
    row per symbol: price, time and id of the last quote, when it was last sent, when a sign of life is due.
    """

    def __init__(self, refresh: float = REFRESH, heartbeat: float = HEARTBEAT):
        self.refresh, self.heartbeat = int(refresh * 1000), int(heartbeat * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double, ts timestamp, event_id long, sent_ms long, beat_ms long")

    def _wait(self, now: int, sent: int, beat: int) -> None:
        """One timer, for whichever is due first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(now + 1, min(sent + self.refresh, beat)))

    def _emit(self, symbol: str, kind: str, price: float | None, ts, now: int) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [symbol], "kind": [kind], "price": [price], "ts": pd.Series([ts], dtype="datetime64[ns]"), "sent_ms": [now]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        new = pd.concat(list(rows)).dropna(subset=["price", "ts"]).sort_values(["ts", "event_id"])
        if new.empty:
            return
        newest = new.iloc[-1]
        price, ts, event_id = float(newest["price"]), pd.Timestamp(newest["ts"]).to_pydatetime(), int(newest["event_id"])
        if not self.last.exists():
            self.last.update((price, ts, event_id, now, now + self.heartbeat))
            self._wait(now, now, now + self.heartbeat)
            yield self._emit(key[0], "change", price, ts, now)
            return
        was, was_ts, was_id, sent, beat = self.last.get()
        if (ts, event_id) <= (pd.Timestamp(was_ts).to_pydatetime(), was_id):
            return
        changed = price != was
        self.last.update((price, ts, event_id, now if changed else sent, beat))
        if changed:
            self._wait(now, now, beat)
            yield self._emit(key[0], "change", price, ts, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        price, ts, event_id, sent, beat = self.last.get()
        out = []
        if now >= sent + self.refresh:
            out.append(self._emit(key[0], "refresh", price, pd.Timestamp(ts), now))
            sent = now
        if now >= beat:
            out.append(self._emit(key[0], "heartbeat", None, None, now))
            beat = now + self.heartbeat
        self.last.update((price, ts, event_id, sent, beat))
        self._wait(now, sent, beat)
        yield from out

    def close(self) -> None:
        pass


def change_markers(quotes: DataFrame, refresh: float = REFRESH, heartbeat: float = HEARTBEAT) -> DataFrame:
    """A stream of quotes (symbol, price, ts, event_id) as what a reader is to be sent: symbol, kind, price, ts, sent_ms."""
    slim = quotes.select("symbol", F.col("price").cast("double").alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    return slim.groupBy("symbol").transformWithStateInPandas(ChangeMarker(refresh, heartbeat), EMITTED, "append", "ProcessingTime")


def state_snapshot(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(symbol, price, ts) of every symbol as the state of ``change_markers`` has it, after a batch (default: the last)."""
    reader = spark.read.format("statestore").option("stateVarName", "last")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.symbol", "value.price", "value.ts")


def delta_log(path: str):
    """For ``foreachBatch``: a batch's rows under its number; a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def deltas_after(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Rows of the batches after ``batch``; empty if there are none."""
    schema = T.StructType.fromDDL(EMITTED + ", batch long")
    numbers = [int(n.removeprefix("batch=")) for n in names_in(spark, path) if n.startswith("batch=")]
    later = [f"{path}/batch={n}" for n in sorted(numbers) if n > batch]
    return spark.read.schema(schema).option("basePath", path).parquet(*later) if later else spark.createDataFrame([], schema)


def applied(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """A snapshot (symbol, price, ts) with the changes since: what a snapshot taken now holds of prices."""
    newest = latest(deltas.where("kind = 'change'"), ["symbol"], F.col("batch").desc()).select("symbol", "price", "ts")
    return snapshot.join(newest, "symbol", "left_anti").unionByName(newest)


# ---------------------------------------------------------------- latest rows


class LatestTable:
    """A table of the latest row per key, kept by micro-batches in hash buckets.

    A batch rewrites the buckets that it has keys of into a folder of its own; a small file lists the folders in force and
    the number of the last batch, and is replaced in one step. So a batch that fails changes nothing and one that comes
    again, as after a restart, is skipped. Of a key's rows the highest ``seq`` stays (columns; later columns break ties), a
    null key is a key, late rows change nothing.
    """

    def __init__(self, path: str, keys: list[str], seq: list[str], buckets: int = 64):
        self.path, self.keys, self.seq, self.buckets = path, keys, seq, buckets

    def _listed(self, spark: SparkSession) -> dict:
        return json.loads(read_text(spark, f"{self.path}/_current") or '{"batch": -1, "buckets": {}}')

    def _order(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() for c in self.seq]

    def read(self, spark: SparkSession, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        found = self._listed(spark)["buckets"]
        folders = [f"{self.path}/{f}" for b, f in found.items() if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``. The batch is read twice; its touched buckets, at most ``buckets`` numbers, are collected."""
        spark = batch.sparkSession
        listed = self._listed(spark)
        if number <= listed["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        folder = f"batch-{number}-{uuid.uuid4().hex}"
        if touched:
            stored = self.read(spark, batch.schema, touched)
            merged = latest(stored.unionByName(batch), self.keys, *self._order())
            merged.select("*", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fresh = {str(b): f"{folder}/_bucket={b}" for b in touched}
        swap_text(spark, f"{self.path}/_current", json.dumps({"batch": number, "buckets": listed["buckets"] | fresh}))

    def drop_unused(self, spark: SparkSession) -> None:
        """Deletes buckets that later batches have replaced. For when nothing reads them."""
        used = set(self._listed(spark)["buckets"].values())
        for folder in names_in(spark, self.path):
            if folder.startswith("batch-"):
                for b in names_in(spark, f"{self.path}/{folder}"):
                    if b.startswith("_bucket=") and f"{folder}/{b}" not in used:
                        drop_path(spark, f"{self.path}/{folder}/{b}")
