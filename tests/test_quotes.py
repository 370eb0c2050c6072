"""Change markers driven by a clock of the test and by a stream; latest tables; snapshots and deltas."""

import datetime as dt
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import market
from tidemark.streaming import quotes as Q

T0 = dt.datetime(2024, 1, 1, 10)


class Clock:
    """A handle with one value of state and timers, as the engine has them for a key."""

    def __init__(self, processor):
        self.value, self.timers, self.processor = None, set(), processor
        processor.init(self)

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def rows(self, now, *quotes):
        df = pd.DataFrame([(("S"), *q) for q in quotes], columns=["symbol", "price", "ts", "event_id"])
        return self._sent(self.processor.handleInputRows(("S",), iter([df]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)))

    def at(self, now):
        sent = []
        for t in sorted(x for x in self.timers if x <= now):
            self.timers.discard(t)
            sent += self._sent(self.processor.handleExpiredTimer(("S",), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now), t))
        return sent

    @staticmethod
    def _sent(frames):
        return [(r.kind, None if pd.isna(r.price) else r.price, r.sent_ms) for f in frames for r in f.itertuples()]


def test_each_emission_at_its_time():
    c, s = Clock(Q.ChangeMarker(60, 30)), lambda i: T0 + dt.timedelta(seconds=i)
    assert c.rows(0, (1.0, s(0), 1), (2.0, s(1), 2)) == [("change", 2.0, 0)]
    assert c.rows(10_000, (2.0, s(9), 3)) == []  # newer, the same price
    assert c.rows(11_000, (7.0, s(5), 4)) == []  # late
    assert c.at(29_999) == [] and c.at(30_000) == [("heartbeat", None, 30_000)]
    assert c.rows(40_000, (3.0, s(30), 5)) == [("change", 3.0, 40_000)]
    assert c.at(60_000) == [("heartbeat", None, 60_000)] and c.at(90_000) == [("heartbeat", None, 90_000)]
    assert c.at(100_000) == [("refresh", 3.0, 100_000)]  # 60 s after it was last sent
    assert c.rows(105_000, (4.0, s(30), 5)) == [] == c.rows(106_000, (None, s(90), 9), (9.0, None, 9))
    assert c.rows(107_000, (4.0, s(30), 6)) == [("change", 4.0, 107_000)]  # the same time, a higher id
    assert c.at(200_000) == [("refresh", 4.0, 200_000), ("heartbeat", None, 200_000)] and len(c.timers) == 1


QUOTES = "symbol string, price double, ts timestamp, event_id long"


def test_markers_snapshot_and_deltas_of_a_stream(spark, tmp_path):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    Q.with_state_store(spark)
    where = {n: str(tmp_path / n) for n in ("in", "state", "deltas")}

    def put(*rows):
        spark.createDataFrame([(s, p, T0 + dt.timedelta(seconds=t), t) for s, p, t in rows], QUOTES).coalesce(1).write.mode("append").parquet(where["in"])

    put(("a", 1.0, 1), ("b", 5.0, 1))
    stream = spark.readStream.schema(QUOTES).parquet(where["in"])
    query = Q.change_markers(stream, refresh=2, heartbeat=1).writeStream.foreachBatch(Q.delta_log(where["deltas"])).option("checkpointLocation", where["state"]).trigger(processingTime="200 milliseconds").start()
    every = lambda: Q.deltas_after(spark, where["deltas"], -1)

    def until(holds):
        for _ in range(240):
            if query.exception():
                raise query.exception()
            if holds(every().collect()):
                return
            time.sleep(0.25)
        raise AssertionError(every().collect())

    try:
        until(lambda rows: {r.symbol for r in rows if r.kind == "refresh"} == {"a", "b"})
        mark = max(r.batch for r in every().collect())
        put(("a", 2.0, 9), ("b", 4.0, 0), ("c", 8.0, 3))
        until(lambda rows: {(r.symbol, r.price) for r in rows if r.kind == "change"} >= {("a", 2.0), ("c", 8.0)})
        until(lambda rows: any(r.kind == "heartbeat" and r.symbol == "c" for r in rows))
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    rows = sorted(every().collect(), key=lambda r: r.sent_ms)
    assert [(r.price) for r in rows if r.symbol == "b" and r.kind == "change"] == [5.0]
    sent = [r.sent_ms for r in rows if r.symbol == "b" and r.kind in ("change", "refresh")]
    assert all(y - x >= 2000 for x, y in zip(sent, sent[1:], strict=False))
    now = {tuple(r) for r in Q.state_snapshot(spark, where["state"]).select("symbol", "price").collect()}
    assert now == {("a", 2.0), ("b", 5.0), ("c", 8.0)}
    last = query.lastProgress["batchId"]
    for batch in range(max(mark, last - 50), last + 1):
        try:
            before = Q.state_snapshot(spark, where["state"], batch)
            before.count()
        except Exception:
            continue  # the state of that batch is not kept any more
        got = Q.applied(before, Q.deltas_after(spark, where["deltas"], batch)).select("symbol", "price").collect()
        assert {tuple(r) for r in got} == now


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "k string, v double, ts long, id long"
    batches = [[("a", 1.0, 1, 1), ("b", 1.0, 1, 2), (None, 1.0, 1, 3)], [("a", 2.0, 3, 4), ("a", 9.0, 3, 5), ("c", 1.0, 1, 6)], [("a", 0.0, 2, 7), ("b", 5.0, 5, 8)], []]
    t = Q.LatestTable(str(tmp_path / "t"), ["k"], ["ts", "id"], 4)
    dfs = [spark.createDataFrame(b, schema) for b in batches]
    for i, df in enumerate(dfs):
        t.upsert(df, i)
        state = t._listed(spark)
        t.upsert(df, i)  # after a restart the last batch comes again
        t.upsert(dfs[0], 0)
        assert t._listed(spark) == state
    want = {("a", 9.0), ("b", 5.0), ("c", 1.0), (None, 1.0)}
    assert {(r.k, r.v) for r in t.read(spark, dfs[0].schema).collect()} == want
    t.drop_unused(spark)
    assert {(r.k, r.v) for r in t.read(spark, dfs[0].schema).collect()} == want


def test_a_batch_that_fails_changes_nothing(spark, tmp_path):
    t = Q.LatestTable(str(tmp_path / "t"), ["k"], ["ts"], 4)
    good = spark.createDataFrame([("a", 1)], "k string, ts long")
    t.upsert(good, 0)
    with pytest.raises(Exception, match="broken"):
        t.upsert(good.withColumn("ts", F.when(F.col("k") == "a", F.raise_error(F.lit("broken"))).cast("long")), 1)
    assert [tuple(r) for r in t.read(spark, good.schema).collect()] == [("a", 1)] and t._listed(spark)["batch"] == 0


def test_a_stream_keeps_the_table(spark, tmp_path):
    t, schema = Q.LatestTable(str(tmp_path / "t"), ["symbol"], ["ts", "event_id"], 4), None
    for i in range(3):
        spark.createDataFrame([(s, float(10 * i + k), T0 + dt.timedelta(hours=i), 2 * i + k) for k, s in enumerate("ab")], QUOTES).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        schema = stream.schema
        stream.writeStream.foreachBatch(t.upsert).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.symbol, r.price) for r in t.read(spark, schema).collect()} == {("a", 20.0), ("b", 21.0)}


def test_live_ties_go_by_id(spark, tmp_path):
    rows = [(i, T0, 0, "x", float(v), None) for i, v in ((3, 7), (1, 5), (2, 6))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = market.ticks(spark, str(tmp_path / "in"), schema)
    bar = market.drain(market.live_bars(stream), "tied", "complete").first()
    assert (bar.open, bar.close) == (5.0, 7.0) and market.drain(market.latest_quotes(stream), "tied_quotes", "complete").first().price == 7.0
