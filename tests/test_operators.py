"""Operators on small tables with values worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import continuous as C
from tidemark.operators import quality as Q
from tidemark.operators import research as R
from tidemark.operators import simulate as S
from tidemark.plans.formula import FormulaError, factor, parse
from tidemark.sources.io import first_with_data, mock_bars, read_bars_csv, read_quotes_json, upsert, write_partitioned

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def panel(spark, close, symbol="A", **more):
    rows = pd.DataFrame({"symbol": symbol, "date": days(len(close)), "open": close, "high": [c + 1 for c in close], "low": [c - 1 for c in close], "close": close, "volume": [100.0] * len(close), "amount": [1.0] * len(close)} | more)
    return spark.createDataFrame(rows)


def values(df, col="factor"):
    return [r[col] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("bad", ["", "close +", "__import__('os')", "close.x", "lambda: 1", "foo(close)", "price", "close and open", "'a'", "ts_mean(close)", "atr(close)"])
def test_formula_refuses(spark, bad):
    with pytest.raises(FormulaError):
        factor(panel(spark, [1.0]), bad)


def test_formula_macro_expands():
    assert parse("ts_mad(close, 3)") is not None


def test_ema_carries_gaps(spark):
    df = panel(spark, [5.0, 4.0, 6.0, 6.0]).withColumn("close", F.when(F.dayofmonth("date") != 3, F.col("close")))
    assert values(factor(df, "ema(close, 3)")) == pytest.approx([5, 4.5, 4.5, 5.5])


def test_ts_rank_is_place_of_maximum(spark):
    assert values(factor(panel(spark, [3.0, 1, 2, 5, 4]), "ts_rank(close, 3)")) == pytest.approx([1, 0.5, 1 / 3, 1, 2 / 3])


def test_pseudo_return_divides_by_present_value(spark):
    got = values(factor(panel(spark, [1.0] * 5, volume=[100.0, 200, 300, 400, 500]), "0 - ts_pseudo_return(abs(volume), 2)"))
    assert got[:2] == [None, None] and got[2] == pytest.approx(-2 / 3)


def test_sum_delta(spark):
    got = values(factor(panel(spark, [1.0] * 3, open=[1.0, 2, 3], volume=[100.0, 200, 300]), "open + ts_delta(ts_sum(volume, 2), 1)"))
    assert got[2] == 203.0


def filter_rows(spark):
    rows = [(d, s, c, x, v) for d, cs, xs, vs in (("d1", (10, 50, 100), (0, 1, 0), (100, 200, 300)), ("d2", (12, 48, 95), (0, 0, 0), (150, 250, 350))) for s, c, x, v in zip("ABC", cs, xs, vs, strict=True)]
    return spark.createDataFrame(rows, "date string, symbol string, close int, is_suspended int, volume int")


@pytest.mark.parametrize(("conditions", "kept"), [([("is_suspended", "val:==0", True)], 5), ([("close", "val:<100", True)], 5), ([("is_suspended", "val:==0", True), ("close", "val:<100", True)], 4), ([("is_suspended", "val:==0", True), ("close", "val:>20", False)], 6), ([("close", "pct:>=0.5", True)], 4)])
def test_filters(spark, conditions, kept):
    assert R.filter_rows(filter_rows(spark), conditions).where("kept").count() == kept


@pytest.mark.parametrize("text", ["x:>1", "pct:>0.5", "pct:>=2", "val:~1"])
def test_filter_refuses(text):
    with pytest.raises(ValueError):
        R.condition("close", text)


def account(opens, targets, contract, acct=S.Account()):
    bars = pd.DataFrame({"date": days(len(opens)), "open": opens, "high": [o + 2 for o in opens], "low": [o - 2 for o in opens], "close": [o + 1 for o in opens], "target": targets}, dtype=object)
    return S.run_account(bars, contract, acct)


def test_futures_long():
    rows = account([100, 101, 105, 110, 111], [1, 1, 0, 0, 0], S.Contract(10, 0.1))
    assert rows[-1][3] == pytest.approx(100_090) and sum(r[5] for r in rows) == pytest.approx(90)


def test_futures_short():
    assert sum(r[5] for r in account([100, 99, 94, 90, 89], [-2, -2, 0, 0, 0], S.Contract(5, 0.1))) == pytest.approx(90)


def test_futures_margin_clamp():
    assert [r[2] for r in account([100, 101, 102], [100] * 3, S.Contract(100, 0.2), S.Account(cash=10_000))][:2] == [0, 4]


def test_futures_slippage():
    assert sum(r[5] for r in account([100, 100, 105, 105], [1, 0, 0, 0], S.Contract(1, 0.1, tick=0.2, slippage_ticks=2))) == pytest.approx(4.2)


def test_target_lots():
    assert S.target_lots([False, True, False, False, True], [False, False, False, True, False], -3) == [0, -3, -3, 0, -3]


def test_backtest_stop_before_signal(spark):
    df = panel(spark, [100.0, 100, 100, 90, 90]).withColumn("entry", F.dayofmonth("date") == 1).withColumn("exit", F.lit(False))
    trades = S.backtest_trades(df, S.Rules(stop=("percent_below", 0.05), fee_rate=0.0, multiplier=1.0)).collect()
    assert [(t.reason, t.entry_price, t.exit_price) for t in trades] == [("stop_loss", 100.0, 90.0)]


def test_score_without_trades(spark):
    row = spark.range(1).select(S.trade_score(*[F.lit(float(x)) for x in (5, 1, 0, 0)], F.lit(0)).alias("s")).first()
    assert row.s == 0


@pytest.mark.parametrize(("rolling", "n", "windows", "second"), [(False, 210, 4, 0), (True, 180, 3, 30)])
def test_walk_forward(spark, rolling, n, windows, second):
    dates = spark.createDataFrame([(d,) for d in days(n)], "date date")
    got = S.walk_forward_windows(dates, 90, 30, 30, rolling).orderBy("window_id").collect()
    assert len(got) == windows and got[1].train_start == DAY + dt.timedelta(second) and got[1].test_start == DAY + dt.timedelta(120) and got[0].test_end == DAY + dt.timedelta(119)


def roll_fixture(spark):
    bars = spark.createDataFrame([("S", d, c, float(p), float(p), float(p), float(p), 1.0, 1.0) for d, c, p in zip([*days(2), *days(4)[2:]], (0, 0, 1, 1), (100, 105, 110, 112), strict=True)], "symbol string, date date, contract int, open double, high double, low double, close double, volume double, amount double")
    return bars, C.detect_rolls(bars)


@pytest.mark.parametrize(("direction", "closes"), [("backward", [95, 100, 110, 112]), ("forward", [100, 105, 105, 107])])
def test_adjustment(spark, direction, closes):
    bars, rolls = roll_fixture(spark)
    got = C.adjusted(bars, C.gaps(bars, rolls), direction)
    assert values(got, "close") == closes


@pytest.mark.parametrize(("utc", "date"), [("2024-01-15 06:30", "2024-01-15"), ("2024-01-15 11:59", "2024-01-15"), ("2024-01-15 12:00", "2024-01-16"), ("2024-01-15 15:00", "2024-01-16"), ("2024-01-15 16:30", "2024-01-16"), ("2024-01-15 13:00", "2024-01-16"), ("2024-01-12 13:30", "2024-01-13")])
def test_trading_date(spark, utc, date):
    row = spark.range(1).select(C.trading_date(F.lit(utc).cast("timestamp")).alias("d")).first()
    assert str(row.d) == date


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 2, "x"), ("A", 5, "y"), ("A", 9, "z")], "k string, t int, v string")
    assert {(r.k, r.t): r.v for r in C.as_of(left, right, "k", "t", ["v"]).collect()} == {("A", 1): None, ("A", 5): "y", ("B", 5): None}


def test_residual_equals_general(spark):
    rows = [("d", f"s{i}", i % 2, float(10 + i * i), float(i * 3 % 7)) for i in range(14)]
    df = spark.createDataFrame(rows, "date string, symbol string, industry int, cap double, v double")
    a = {r.symbol: r.neutral for r in R.residual(df, "v", "industry", "cap").collect()}
    g = df.withColumn("x", F.ln("cap")).withColumn("z", F.col("industry").cast("double"))
    b = {r.symbol: r.neutral for r in R.residual_general(g, "v", ["x", "z"]).collect()}
    assert a == pytest.approx(b)


def test_quality_score(spark):
    found = spark.createDataFrame([("a", "bad", 0), ("b", "warning", 2), ("c", "info", 1)], "check string, severity string, count long")
    assert tuple(Q.score(found).first()) == (85, "warning")


def test_upsert_last_wins_and_null_keys_match(spark):
    old = spark.createDataFrame([("a", 1, 0), (None, 2, 0), ("c", 3, 0)], "k string, v int, s int")
    new = spark.createDataFrame([("a", 7, 1), ("a", 8, 2), (None, 9, 1)], "k string, v int, s int")
    assert {(r.k, r.v) for r in upsert(old, new, ["k"], "s").collect()} == {("a", 8), (None, 9), ("c", 3)}


def test_failover(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {(r.k, r.v) for r in first_with_data(["k"], a, b).collect()} == {("x", 1), ("y", 3)}


def test_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("trade_date,open,close\n2024-01-02,2,x\n2024-01-01,1,3\n")
    assert [r.close for r in read_bars_csv(spark, str(tmp_path / "b.csv")).collect()] == [3.0, None]
    assert read_bars_csv(spark, str(tmp_path / "b.csv"), 1).first().open == 2.0
    (tmp_path / "q.json").write_text('{"symbol": "A", "price": 1.5, "ts": "2024-01-01T00:00:00"}\n')
    assert read_quotes_json(spark, str(tmp_path / "q.json")).first().price == 1.5
    bars = mock_bars(spark, 2, 3)
    assert bars.count() == 6 and bars.where("high < low").count() == 0
    for _ in range(2):
        write_partitioned(bars, str(tmp_path / "t"), "symbol")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_formula_plans(spark):
    """However deep its windows nest, a formula adds one shuffle; recursive averages of a depth share one pass."""
    from tidemark.plans.formula import with_formulas

    def plan(**formulas):
        return with_formulas(panel(spark, [1.0, 2, 3]), formulas)._jdf.queryExecution().executedPlan().toString()

    assert plan(f="ts_mean(ts_zscore(close / ts_delay(close, 1) - 1, 5), 3) - ts_std(close, 5)").count("Exchange hashpartitioning") == 1
    assert plan(a="ema(close, 3)", b="ema(open, 5)", c="ema(close, 9) - ema(close, 3)").count("FlatMapGroupsInPandas") == 1
    assert plan(a="ema(ema(close, 3), 3)", b="ema(open, 5)").count("FlatMapGroupsInPandas") == 2


def test_pack_dialect():
    from tidemark.functions.pack import convert

    assert convert("add(close, 1, neg(volume))") == "((close + 1) + (0 - volume))"
    assert convert("signed_power(delta(close), exponent=2)") == "signed_power(ts_delta(close, 1), 2)"
    for bad in ("foo(close)", "add(close)", "close[0]", "sub("):
        with pytest.raises(FormulaError):
            convert(bad)


def test_strategy_names_and_conditions(spark):
    from tidemark.operators import strategy as Y

    assert Y.indicator_formula("sma5") == "ts_mean_full(close, 5)" and Y.indicator_formula("nonsense") == "close"
    df = panel(spark, [1.0, 2, 3, 2, 1])
    rule = {"entry": {"conditions": [{"indicator": "close", "operator": "cross_above", "value": 1.5}]}, "exit": {"conditions": [{"indicator": "close", "operator": "no_such", "value": 1}]}}
    assert values(Y.signals(df, rule), "entry") == [False, True, False, False, False] and not any(values(Y.signals(df, rule), "exit"))
    with pytest.raises(ValueError):
        Y.signals(df, {"entry": {"conditions": [{"indicator": "close", "operator": "above", "indicator2": "open", "multiply_value": -1}]}})


# ---------------------------------------------------------------- stored bars


def test_lookup_prunes_and_falls_back(spark, tmp_path):
    from tidemark.sources import store

    rows = [(f"S{k}", p, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h + k)) for k in range(3) for p in ("1d", "60") for h in range(5)]
    store.write_bars(spark.createDataFrame(rows, "symbol string, period string, date timestamp_ntz, close double"), str(tmp_path / "bars"))
    bars = store.read_bars(spark, str(tmp_path / "bars"))
    got = store.lookup(bars, "S1", "1h", start=dt.datetime(2024, 1, 1, 1), limit=2)
    assert [(r.period, r.close) for r in got.collect()] == [("60", 5.0), ("60", 4.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "symbol" in filters.split("PushedFilters")[0] and "period" in filters.split("PushedFilters")[0] and "GreaterThanOrEqual(date" in plan
    assert [r.close for r in store.lookup(bars, "S2", "60", limit=3, newest_first=False).collect()] == [4.0, 5.0, 6.0]
    assert store.lookup(bars, "S1", "5m").count() == 0 and store.lookup(bars, "S9", "1d").count() == 0
    assert store.multi_period(bars, "S0", ["D", "1h"], 2).count() == 4


def test_view_order():
    from tidemark.sources import store

    assert store.build_order(["main_back_adjusted", "raw_contract"]) == ["raw_contract", "main_continuous", "main_back_adjusted"]
    with pytest.raises(ValueError):
        store.build_order(["nothing"])


def test_late_rolls_extend_the_rebuild(spark):
    from tidemark.sources import store

    rolls = spark.createDataFrame([(dt.date(2024, 1, 5), dt.datetime(2024, 2, 2)), (dt.date(2024, 1, 3), dt.datetime(2024, 1, 4))], "effective date, created_at timestamp")
    assert store.late_start(dt.date(2024, 1, 20), dt.datetime(2024, 2, 1), rolls) == dt.date(2024, 1, 5)
    assert store.late_start(dt.date(2024, 1, 20), dt.datetime(2024, 2, 3), rolls) == dt.date(2024, 1, 20)


def test_sinks_and_logs(spark, tmp_path):
    from tidemark.sources import io

    rows = spark.createDataFrame([("a", 1.5), ("ü", None)], "k string, v double")
    io.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "c")).collect())) == [("a", "1.5"), ("ü", None)]
    io.write_report(rows, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"k":"a","v":1.5}', '{"k":"ü"}']
    with pytest.raises(ValueError):
        io.write_report(rows, str(tmp_path / "big"), 10)
    (tmp_path / "m.csv").write_text("name,formula,category\nb,close,\n a ,open,x\n ,,\n")
    assert list(map(tuple, io.read_manifest(spark, str(tmp_path / "m.csv"), 5).collect())) == [("a", "open", "x"), ("b", "close", "other")]
    for _ in range(2):
        io.record_run(spark, str(tmp_path / "log"), "bars", "success", 5, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 3))
    assert [r.seconds for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [3.0, 3.0]


def test_null_keys_are_not_new(spark):
    from tidemark.sources.io import insert_new

    old = spark.createDataFrame([(None, 1), ("a", 1)], "k string, s int")
    assert [r.k for r in insert_new(old, spark.createDataFrame([(None, 2), ("b", 1), ("b", 2)], "k string, s int"), ["k"], "s").collect()] == ["b"]


# ---------------------------------------------------------------- simulation and analysis


def test_grid_windows_of_any_length(spark):
    up = panel(spark, [100.0 + i for i in range(300)])
    got = {r.param_id: r.bars_in for r in S.grid_cross_returns(up, S.grid(spark, short=[5], long=[100, 150])).collect()}
    assert got == {"5_100": 201, "5_150": 151}


def test_short_swaps_the_cross(spark):
    bars = panel(spark, [5.0, 5, 5, 4, 3, 2, 3, 5, 7, 9])
    long, short = (S.ma_cross_signals(bars, 2, 3, side) for side in ("long", "short"))
    assert values(long, "entry") == values(short, "exit") and values(long, "exit") == values(short, "entry") and any(values(short, "entry"))


def test_unknown_stop_kinds_set_none():
    assert S.stop_levels(S.Rules(stop=("moon", 1.0), target=("stars", 1.0)), 100.0, 1.0) == (None, None)


def test_futures_open_at_zero():
    assert len(account([100, 0, 5], [1, 1, 1], S.Contract(10, 0.1))) == 3


def test_strategy_indicator_names(spark):
    from tidemark.operators import strategy as Y

    for name in ("cci", "cci14", "kdj_k9", "kdj_j_5", "boll20"):
        assert Y.indicator_formula(name) != "close"
    assert Y.indicator_formula("boll20") == Y.indicator_formula("sma20") == "ts_mean_full(close, 20)"


def brute_levels(highs, lows, volumes):
    """Turning points of the last 20 bars joined, in order, to the first level whose mean is near."""
    out = []
    for side, v, sign in (("resistance", highs[-20:], 1), ("support", lows[-20:], -1)):
        near, levels, vol = 0.3 * np.std(v) if np.std(v) > 0 else np.mean(v) * 0.005, [], volumes[-20:]
        for i in range(1, 19):
            if sign * v[i] > sign * v[i - 1] and sign * v[i] > sign * v[i + 1]:
                home = next((m for m in levels if abs(np.float64(m[0]) - v[i]) <= near), None)
                if home is None:
                    levels.append([v[i], [i]])
                else:
                    home[0] = (home[0] * len(home[1]) + v[i]) / (len(home[1]) + 1)
                    home[1].append(i)
        for mean, at in levels:
            if len(at) >= 2:
                strength = min(50, len(at) * 15) + min(50, np.mean([vol[i] for i in at]) / np.mean(vol) * 20)
                out.append((side, round(mean, 2), len(at), round(float(strength), 1)))
    return sorted(out, key=lambda x: -x[3])[:5]


def test_price_levels(spark):
    from tidemark.operators import analysis as A

    rng = np.random.default_rng(4)
    rows = [(f"S{k}", DAY + dt.timedelta(i), float(h := rng.integers(100, 112)), float(h - rng.integers(1, 6)), float(rng.integers(50, 150))) for k in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, date date, high double, low double, volume double")
    got = A.price_levels(df).orderBy("symbol", "place").collect()
    assert got
    for k in range(6):
        own = [r for r in rows if r[0] == f"S{k}"]
        want = brute_levels([r[2] for r in own], [r[3] for r in own], [r[4] for r in own])
        mine = [(r.side, r.level, r.touches, r.strength) for r in got if r.symbol == f"S{k}"]
        assert [x[3] for x in mine] == [x[3] for x in want] and len(mine) == len(want)
        assert all(m in want or [w[3] for w in want].count(m[3]) > 1 for m in mine)


def test_decay_rules(spark):
    from tidemark.operators import desk as D

    cols = "symbol string, sharpe double, profit_factor double, win_rate_pct double, trade_count long"
    before = spark.createDataFrame([("a", 2.0, 2.0, 60.0, 10), ("b", 0.0, 0.0, 50.0, 0), ("c", -1.0, 1.0, 40.0, 5)], cols)
    now = spark.createDataFrame([("a", 1.0, 1.0, 50.0, 5), ("b", -0.2, 0.4, 60.0, 3), ("c", -2.0, 2.0, 20.0, 9)], cols)
    got = {r.symbol: (r.decay, r.status) for r in D.decay_score(before, now, "symbol").collect()}
    assert got == {"a": (50.0, "degraded"), "b": (65.0, "degraded"), "c": (55.0, "degraded")}


def test_fitness_counts_fall_linearly(spark):
    from tidemark.operators import desk as D

    m = spark.createDataFrame([(n, 1.0, 10.0, 5.0, 50.0, 1.5) for n in (2, 4, 30, 40, 60, 100, 300)], "trade_count long, sharpe double, annualized_return_pct double, max_drawdown_pct double, win_rate_pct double, profit_factor double")
    assert [r.count_score for r in D.fitness_scores(m, 7).orderBy("trade_count").collect()] == [20.0, 50.0, 100.0, 85.0, 55.0, 38.0, 20.0]
    assert {r.simplicity_score for r in D.fitness_scores(m, 7).collect()} == {5.0}


def test_greedy_decorrelation(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)], "name string, score double")
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", -0.8), ("a", "d", 0.1)], "a string, b string, corr double")
    assert R.greedy_decorrelated(scores, corr) == ["a", "c"]


def test_pareto_of_two_and_three_measures(spark):
    from tidemark.operators import technical as T

    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.integers(0, 6, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    for cols in (["a", "b"], ["a", "b", "c"]):
        at = [1 + "abc".index(c) for c in cols]
        better = lambda x, y: all(x[j] >= y[j] for j in at) and any(x[j] > y[j] for j in at)
        want = {r[0] for r in rows if not any(better(o, r) for o in rows)}
        assert {r.k for r in T.pareto_front(df, "k", cols).collect()} == want
    ranks = {r.k: r.front for r in T.pareto_ranks(df, "k", ["a", "b"]).collect()}
    assert len(ranks) == 60 and min(ranks.values()) == 0
    crowd = T.crowding(T.pareto_front(df, "k", ["a", "b"]), ["a", "b"]).collect()
    assert any(r.crowding == float("inf") for r in crowd)


def test_regression_with_dependent_regressors(spark):
    rows = [("d", f"s{i}", float(i % 7), float(i % 7) * 2, float(i * i % 11)) for i in range(20)]
    df = spark.createDataFrame(rows, "date string, symbol string, x double, z double, v double")
    one, two = ({r.symbol: r.neutral for r in R.residual_general(df, "v", c).collect()} for c in (["x"], ["x", "z"]))
    x, v = np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
    fit = np.polyfit(x, v, 1)
    assert one == pytest.approx(two) and [one[f"s{i}"] for i in range(20)] == pytest.approx((v - np.polyval(fit, x)).tolist())


# ---------------------------------------------------------------- search and registry


def test_evolution_and_suggestions():
    import random

    from tidemark.operators import search as E

    bounds = {"short": (2, 20), "long": (21, 60)}
    peak = lambda xs: [-((x["short"] - 7) ** 2) - (x["long"] - 40) ** 2 / 10 for x in xs]
    best, score, course = E.evolve(peak, bounds, 24, 12)
    assert course == sorted(course) and score > course[0] and abs(best["short"] - 7) <= 2 and abs(best["long"] - 40) <= 6
    first = E.initial(bounds, 19, random.Random(3))
    assert len({E.key(x) for x in first}) == 19 and len({x["short"] for x in first}) == 19
    more = E.suggested(first, peak(first), bounds, 5)
    assert np.mean(peak(more)) > np.mean(peak(first)) and not {E.key(x) for x in more} & {E.key(x) for x in first}


def test_evolution_on_backtests(spark):
    from tidemark.operators import search as E

    rng = np.random.default_rng(1)
    bars = panel(spark, (100 + np.cumsum(rng.normal(size=60))).tolist())

    def score(population):
        sets = spark.createDataFrame([(f"{x['short']}_{x['long']}", x["short"], x["long"]) for x in population], "param_id string, short int, long int")
        got = {r.param_id: r.composite for r in S.optimise_cross(bars, sets, S.Rules()).collect()}
        return [got[f"{x['short']}_{x['long']}"] for x in population]

    best, top, course = E.evolve(score, {"short": (2, 5), "long": (6, 12)}, 6, 2)
    assert top == max(course) and set(best) == {"short", "long"}


def test_registry(spark):
    from tidemark.functions.registry import Registry

    r = Registry()
    r.add("mom_3", "close / ts_delay(close, 3) - 1", "momentum")
    r.add("vol", "ts_std(close, 5)")
    with pytest.raises(FormulaError):
        r.add("bad", "nothing(close)")
    assert r.search("MOM") == ["mom_3"] and r.search(category="other") == ["vol"] and Registry.load(r.table(spark)).factors == r.factors
    assert r.columns(panel(spark, [1.0, 2, 3, 4]), ["mom_3"]).columns[-1] == "mom_3"
    r.remove("vol")
    assert r.search() == ["mom_3"]


def test_strategy_parameters():
    from tidemark.operators import strategy as Y

    doc = {"entry": {"conditions": [{"indicator": "sma{n}", "operator": "above", "value": "{limit}", "note": "{other}"}]}}
    assert Y.with_values(doc, {"n": 5, "limit": 2.5})["entry"]["conditions"] == [{"indicator": "sma5", "operator": "above", "value": 2.5, "note": "{other}"}]
