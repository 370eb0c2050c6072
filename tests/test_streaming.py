"""Streams over files that are there already, drained once."""

import datetime as dt

import pandas as pd

from tidemark.streaming import market as M

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def feed(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(i, t + dt.timedelta(hours=i), i % 2, "x", float(10 + i), None) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return M.ticks(spark, str(tmp_path / "in"), SCHEMA), pd.DataFrame(rows)


def test_live_bars(spark, tmp_path):
    stream, rows = feed(spark, tmp_path)
    got = M.drain(M.live_bars(stream), "bars", "complete")
    assert sum(r.volume for r in got.collect()) == len(rows)
    assert {(r.symbol, r.close) for r in got.where("date = '2024-01-01'").collect()} == {("S00", 22.0), ("S01", 23.0)}


def test_latest_quotes(spark, tmp_path):
    stream, _ = feed(spark, tmp_path)
    assert {(r.symbol, r.price) for r in M.drain(M.latest_quotes(stream), "quotes", "complete").collect()} == {("S00", 48.0), ("S01", 49.0)}


def test_alerts_fire_once(spark, tmp_path):
    stream, _ = feed(spark, tmp_path)
    rules = spark.createDataFrame([(1, "S00", "above", 15.0), (2, "S01", "below", 0.0)], "alert_id long, symbol string, side string, target double")
    got = M.drain(M.alerts_once(stream, rules), "alerts", "append").collect()
    assert [(r.alert_id, r.value) for r in got] == [(1, 16.0)]


def test_new_items(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(u, t + dt.timedelta(minutes=i)) for i, u in enumerate(["a", "b", "a", "c", "b"])]
    spark.createDataFrame(rows, "url string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("c",)], "url string")
    assert sorted(r.url for r in M.drain(M.new_items(stream, stored), "items", "append").collect()) == ["a", "b"]


def test_polled(spark, tmp_path):
    stream, rows = feed(spark, tmp_path)
    query = M.polled(stream.select("event_id", "symbol"), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
