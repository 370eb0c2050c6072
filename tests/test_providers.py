"""Provider rows, field by field."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import providers as P


def one(spark, provider, row, **how):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in row))
    return P.adapted(df, provider, **how).first().asDict()


@pytest.mark.parametrize("provider", sorted(P.PROVIDERS))
def test_every_provider_maps_every_field(spark, provider):
    """All fields from the first of their names; unknown columns go; a row of nothing is nulls."""
    sample = {"number": "12.5", "whole": "12.9", "time": "20240115", "text": "x", "upper": "x", "letters": "x"}
    spec = P.PROVIDERS[provider]
    got = one(spark, provider, {names[0]: sample[kind] for kind, *names in spec.values()} | {"unknown column": "1"})
    kinds = {"number": 12.5, "whole": 12, "time": dt.datetime(2024, 1, 15), "text": "x", "upper": "X"}
    for name, (kind, *_) in spec.items():
        if name in got:
            assert got[name] == kinds[kind], name
    bare = one(spark, provider, {"unknown column": "1"})
    assert all(bare[n] is None for n in spec if n in bare and spec[n][0] != "upper" and n not in ("updated_at", "change_percent"))


def test_values_that_are_missing_or_cannot_be_read(spark):
    row = {"最新价": "-", "current_price": "None", "close": "", "last_price": "7.5", "昨结算": "x", "成交量": "abc", "持仓量": "-3.99", "涨跌幅": "NaN", "high": "1e3", "更新时间": "2024-01-15 09:30:00", "symbol": "AU"}
    got = one(spark, "local_quote", row)
    assert got["current_price"] == 7.5 and got["pre_settlement"] is None and got["volume"] is None and got["open_interest"] == -3 and got["high"] == 1000.0
    assert got["updated_at"] == dt.datetime(2024, 1, 15, 1, 30) and got["change_percent"] is None
    assert one(spark, "local_quote", {"close": "11", "settle": "10"})["change_percent"] == 10.0
    assert one(spark, "local_quote", row, symbol="CU")["symbol"] == "CU" and one(spark, "mock_quote", {"symbol": "AG"}, symbol="CU")["symbol"] == "AG"


@pytest.mark.parametrize(("row", "change"), [({"close": "11", "pre_close": "10"}, 10.0), ({"close": "11", "pre_settle": "10"}, 10.0), ({"close": "11", "open": "10"}, 10.0), ({"close": "11", "pre_close": "0", "open": "10"}, 10.0), ({"open": "10"}, 0.0), ({}, 0.0)])
def test_changes_of_exchange_quotes(spark, row, change):
    assert one(spark, "exchange_quote", {"ts_code": "au2406.SHF", **row})["change_percent"] == change and one(spark, "exchange_quote", {"ts_code": "au2406.SHF"})["symbol"] == "AU"


@pytest.mark.parametrize(("text", "want"), [("2024-01-15", dt.datetime(2024, 1, 15)), ("20240115", dt.datetime(2024, 1, 15)), ("2024-01-15 08:00:00", dt.datetime(2024, 1, 15)), ("20240115 08:00:00", dt.datetime(2024, 1, 15)), ("20240115080000", dt.datetime(2024, 1, 15)), ("2024-13-01", None), ("soon", None), (None, None)])
def test_times(spark, text, want):
    assert one(spark, "mapping", {"trade_date": text})["trade_date"] == want


@pytest.mark.parametrize(("code", "name", "kind"), [("AU2506.SHF", None, "NORMAL"), ("CUL.SHF", None, "CONTINUOUS"), ("AU.SHF", None, "MAIN"), ("IF2506", "主力", "MAIN"), ("AU", "连续", "CONTINUOUS"), (None, None, "NORMAL")])
def test_contract_types(spark, code, name, kind):
    assert one(spark, "contract", {"ts_code": code, "name": name})["contract_type"] == kind


def test_contracts_expire(spark):
    for day, active in (("20240131", False), ("20240201", True), (None, True)):
        assert one(spark, "contract", {"delist_date": day}, today=F.to_date(F.lit("2024-01-31")))["is_active"] is active


def test_lookups_are_top_k(spark):
    rows = spark.createDataFrame([(f"a{i % 3}", dt.date(2024, 1, 1 + i), float(i)) for i in range(20)], "ts_code string, trade_date date, settle double")
    got = P.dated_lookup(rows, "ts_code", ["a1"], dt.date(2024, 1, 5), dt.date(2024, 1, 18), 3)
    assert [r.settle for r in got.collect()] == [16.0, 13.0, 10.0] and "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()
    assert P.dated_lookup(rows, "ts_code", ["a"], limit=5, prefix=True).count() == 5 and P.dated_lookup(rows, "ts_code", [], limit=2).count() == 2
