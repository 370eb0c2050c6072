"""Rows of data providers under the library's names: fourteen mappings as data, compiled to Columns.

A field names its kind and the provider's columns that may hold it, the first with a value being taken. Values may come as
text: a missing one is null, empty, '-' or 'None'; what cannot be read as the kind is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value, and the time zone of times of day.
MISSING, ZONE = ("-", "", "None"), "Asia/Shanghai"
DATES, TIMES = ("yyyy-MM-dd", "yyyyMMdd"), ("yyyy-MM-dd HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyyMMddHHmmss")


def number(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def whole(c: Column) -> Column:
    """Cut to a whole number, towards zero."""
    return F.when(~F.isnan(c.try_cast("double")), c.try_cast("double").try_cast("long"))


def instant(c: Column) -> Column:
    """A date is its first instant in UTC; a time of day is one of ``ZONE``; a time that is one already stays."""
    text = c.cast("string")
    dates = [F.when(text.rlike(p), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(f)), "UTC")) for p, f in zip((r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{8}$"), DATES, strict=True)]
    times = [F.when(text.rlike(p), F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(f)), ZONE)) for p, f in zip((r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", r"^\d{8} \d{2}:\d{2}:\d{2}$", r"^\d{14}$"), TIMES, strict=True)]
    return F.coalesce(*dates, *times)


def letters(code: Column) -> Column:
    """The letters that a contract's code begins with, in upper case."""
    return F.nullif(F.upper(F.regexp_extract(F.split_part(code.cast("string"), F.lit("."), F.lit(1)), r"^(\p{L}*)", 1)), F.lit(""))


KINDS = {"text": lambda c: c.cast("string"), "number": number, "whole": whole, "time": instant, "upper": lambda c: F.upper(F.coalesce(c.cast("string"), F.lit(""))), "letters": letters}


def fields(kind: str, *names: str) -> dict[str, tuple[str, ...]]:
    return {n: (kind, n) for n in names}


_PRICES = {"open_price": ("number", "open"), "high_price": ("number", "high"), "low_price": ("number", "low"), "close_price": ("number", "close")}
_QUOTE = ("current_price", "pre_settlement", "open_price", "high", "low")
_WEEKLY = ("vol", "vol_yoy", "amount", "cumvol", "cumvol_yoy", "cumamt", "cumamt_yoy", "open_interest", "interest_wow", "mc_close", "close_wow")

#: The providers' names of fields. Output name -> (kind, provider's names in order of preference).
PROVIDERS: dict[str, dict[str, tuple[str, ...]]] = {
    "local_quote": {
        "symbol": ("text", "symbol"), "current_price": ("number", "最新价", "current_price", "close", "last_price"), "pre_settlement": ("number", "昨结算", "昨结算价", "pre_settlement", "settle"), "open_price": ("number", "开盘价", "open_price", "open"),
        "high": ("number", "最高价", "high"), "low": ("number", "最低价", "low"), "volume": ("whole", "成交量", "volume", "vol"), "open_interest": ("whole", "持仓量", "open_interest", "hold"), "bid1": ("number", "买一价", "bid1"), "ask1": ("number", "卖一价", "ask1"),
        "change_percent": ("number", "涨跌幅", "change_percent"), "data_source": ("text", "data_source"), "updated_at": ("time", "更新时间", "time", "updated_at")},
    "local_bar": {
        "contract_code": ("text", "contract_code"), "symbol": ("text", "symbol"), "period": ("text", "period"), "trading_time": ("time", "时间", "datetime", "trading_time"), "open_price": ("number", "开盘", "open", "open_price"), "high_price": ("number", "最高", "high", "high_price"),
        "low_price": ("number", "最低", "low", "low_price"), "close_price": ("number", "收盘", "close", "close_price"), "volume": ("whole", "成交量", "volume", "vol"), "open_interest": ("whole", "持仓量", "持仓", "open_interest", "oi")},
    "exchange_quote": {
        "symbol": ("text", "symbol"), "code": ("text", "ts_code"), "current_price": ("number", "close"), "pre_settlement": ("number", "pre_close", "pre_settle"), "open_price": ("number", "open"), "high": ("number", "high"), "low": ("number", "low"), "volume": ("whole", "vol"), "open_interest": ("whole", "oi"),
        "data_source": ("text", "data_source"), "updated_at": ("time", "trade_time")},
    "exchange_bar": {"contract_code": ("text", "contract_code"), "symbol": ("text", "symbol"), "code": ("text", "ts_code"), "period": ("text", "period"), "trading_time": ("time", "trade_time", "trade_date", "end_date"), **_PRICES, "volume": ("whole", "vol"), "open_interest": ("whole", "oi")},
    "mock_quote": {"symbol": ("text", "symbol"), **fields("number", *_QUOTE), **fields("whole", "volume", "open_interest"), "change_percent": ("number", "change_percent"), "updated_at": ("time", "updated_at")},
    "mock_bar": {**fields("text", "contract_code", "symbol", "period"), "trading_time": ("time", "trading_time"), **fields("number", "open_price", "high_price", "low_price", "close_price"), **fields("whole", "volume", "open_interest")},
    "daily": {
        "ts_code": ("text", "ts_code"), "trade_date": ("time", "trade_date", "end_date"), **fields("number", "pre_close", "pre_settle"), **_PRICES, **fields("number", "settle", "change1", "change2"), "volume": ("whole", "vol"), "amount": ("number", "amount"), "open_interest": ("whole", "oi"), "oi_chg": ("whole", "oi_chg"),
        "period": ("text", "period")},
    "settlement": {"ts_code": ("text", "ts_code"), "trade_date": ("time", "trade_date"), **fields("number", "settle", "trading_fee_rate", "trading_fee", "delivery_fee", "b_hedging_margin_rate", "s_hedging_margin_rate", "long_margin_rate", "short_margin_rate", "offset_today_fee"), "exchange": ("text", "exchange")},
    "weekly": {**fields("text", "exchange", "prd", "name"), **fields("number", *_WEEKLY), "amout_yoy": ("number", "amout_yoy", "amount_yoy"), "week": ("text", "week"), "week_date": ("time", "week_date")},
    "warehouse": {"trade_date": ("time", "trade_date"), **fields("text", "symbol", "fut_name", "warehouse", "wh_id"), **fields("whole", "pre_vol", "vol", "vol_chg", "pd"), **fields("text", "area", "year", "grade", "brand", "place", "is_ct", "unit", "exchange")},
    "holding": {"trade_date": ("time", "trade_date"), **fields("text", "symbol", "broker"), **fields("whole", "vol", "vol_chg", "long_hld", "long_chg", "short_hld", "short_chg"), "exchange": ("text", "exchange")},
    "price_limit": {"ts_code": ("text", "ts_code"), "trade_date": ("time", "trade_date"), "name": ("text", "name"), **fields("number", "up_limit", "down_limit", "m_ratio"), **fields("text", "cont", "exchange")},
    "mapping": {"ts_code": ("text", "ts_code"), "trade_date": ("time", "trade_date"), "mapping_ts_code": ("text", "mapping_ts_code")},
    "contract": {**fields("upper", "ts_code", "symbol", "fut_code"), **fields("text", "name", "exchange"), **fields("time", "list_date", "delist_date"), **fields("number", "multiplier", "per_unit"), **fields("text", "trade_unit", "quote_unit", "d_month")},
}


def contract_type(code: Column, name: Column) -> Column:
    """By name, else by the end of the code before its dot: MAIN, CONTINUOUS or NORMAL."""
    base, name = F.split_part(code, F.lit("."), F.lit(1)), F.coalesce(name, F.lit(""))
    named = F.when(name.contains("主力"), "MAIN").when(name.contains("连续"), "CONTINUOUS")
    return F.coalesce(named, F.when(base.isNull() | (base == "") | base.rlike(r"\p{N}$"), "NORMAL").when(base.endswith("L"), "CONTINUOUS").otherwise("MAIN"))


def adapted(rows: DataFrame, provider: str, today: Column | None = None, **given: str) -> DataFrame:
    """A provider's ``rows`` under the library's names, and what follows from them.

    Columns that the rows lack are missing values. ``given`` are values for names that a request knows (symbol, period,
    contract_code): they go before the rows' own, but for mock rows after. ``today`` (default: the current date) tells which
    contracts are active. A quote's missing change is derived from its price and the settlement before.
    """
    have = {c: F.col(f"`{c}`") for c in rows.columns}

    def value(kind: str, *names: str) -> Column:
        found = [F.when(~have[n].cast("string").isin(*MISSING), have[n]) for n in names if n in have]
        return KINDS[kind](reduce(lambda a, b: F.coalesce(a, b.cast("string")), [found[0].cast("string"), *found[1:]]) if found else F.lit(None).cast("string"))

    out = {}
    for name, (kind, *names) in PROVIDERS[provider].items():
        own = value(kind, *names)
        fixed = F.lit(given[name]) if name in given else None
        out[name] = own if fixed is None else F.coalesce(own, fixed) if provider.startswith("mock") else fixed
    change = lambda base: F.when(base > 0, F.round((out["current_price"] - base) / base * 100, 2))
    if provider == "local_quote":
        out["change_percent"] = F.coalesce(out["change_percent"], change(out["pre_settlement"]))
    elif provider == "exchange_quote":
        out["change_percent"] = F.coalesce(change(out["pre_settlement"]), F.when(~F.coalesce(out["pre_settlement"] > 0, F.lit(False)), change(out["open_price"])), F.lit(0.0))
    if provider in ("exchange_quote", "exchange_bar", "local_bar", "mock_bar"):
        code = out.pop("code", F.lit(None).cast("string"))
        out["symbol"] = F.coalesce(out["symbol"], letters(F.coalesce(out["contract_code"], code) if "contract_code" in out else code))
    if provider.endswith("quote"):
        out["updated_at"] = F.coalesce(out["updated_at"], F.current_timestamp())
    if provider == "contract":
        out["contract_type"] = contract_type(out["ts_code"], out["name"])
        out["is_active"] = F.coalesce((today if today is not None else F.current_date()) < F.to_date(out["delist_date"]), F.lit(True))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def dated_lookup(rows: DataFrame, by: str, values: list[str], start=None, end=None, limit: int = 100, at: str = "trade_date", prefix: bool = False) -> DataFrame:
    """The latest ``limit`` rows of settlements, price limits, holdings or warehouse receipts whose ``by`` is one of ``values``
    (or, with ``prefix``, begins with one), in a range of dates; newest first, then by all columns. A top-k, no full sort."""
    key = F.col(by)
    found = rows.where(reduce(lambda a, b: a | b, [key.startswith(v) for v in values]) if prefix else key.isin(*values)) if values else rows
    if start is not None:
        found = found.where(F.col(at) >= F.lit(start))
    if end is not None:
        found = found.where(F.col(at) <= F.lit(end))
    return found.orderBy(F.desc(at), *[F.col(c) for c in rows.columns if c != at]).limit(limit)
