"""Pack expressions with status, fields and category; seeded factors; a choice of indicators; many parameter sets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.library import SEEDS
from tidemark.functions.pack import with_conversions
from tidemark.functions.registry import Registry, chosen_indicators
from tidemark.operators import simulate as S

CASES = [
    ("mul(amount, log(amplitude))", "(amount * signed_log(((high - low) / close)))", "converted", ["amount", "close", "high", "low"], "volume_price"),
    ("ts_std(ret_5, 10)", "ts_std((close / ts_delay(close, 5) - 1), 10)", "converted", ["close"], "volatility"),
    ("neg(gap)", "(0 - (open / ts_delay(close, 1) - 1))", "converted", ["close", "open"], "momentum"),
    ("log(Market_Cap)", "signed_log(Market_Cap)", "converted", ["Market_Cap"], "fundamental"),
    ("delay(low, 2)", "ts_delay(low, 2)", "converted", ["low"], "technical"),
    ("twirl(high, 2)", None, "unsupported", ["high"], "technical"),
    ("add(close", None, "unsupported", [], "technical"),
    ("", None, "unsupported", [], "technical"),
    (None, None, "unsupported", [], "technical"),
]


def test_conversions(spark):
    rows = spark.createDataFrame([(c[0], "old") for c in CASES], "expression string, status string").repartition(3)
    got = sorted(map(str, [(r.expression, r.formula, r.status, r.fields, r.category) for r in with_conversions(rows).collect()]))
    assert got == sorted(map(str, CASES))
    errors = {r.expression: r.error for r in with_conversions(rows).collect()}
    assert "twirl" in errors["twirl(high, 2)"] and errors["delay(low, 2)"] is None and errors[None]
    assert with_conversions(rows.limit(0)).count() == 0


def bars_of(spark, symbol, closes):
    rows = [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), 10.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_seeds(spark):
    r = Registry.seeded()
    assert len(SEEDS) == 13 and r.table(spark).count() == 13 and r.search(category="趋势") == ["trv_20", "wc_20"]
    assert Registry.load(r.table(spark)).factors == r.factors


def test_choice_of_indicators(spark):
    bars = bars_of(spark, "A", range(10, 40))
    one = chosen_indicators(bars, ["MA5 ", "close"])
    assert one.columns == ["symbol", "date", "open", "high", "low", "close", "volume", "ma5"]
    assert one.orderBy(F.desc("date")).first().ma5 == 37.0
    assert "ewm" not in one._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="macdx, nothing"):
        chosen_indicators(bars, ["ma5", "nothing", "macdx"])


def test_many_sets_as_one_by_one(spark):
    """More sets than one number has bits: each as its own backtest, for both directions, a flat and a single-bar symbol too."""
    rng = np.random.default_rng(4)
    bars = bars_of(spark, "A", 100 + np.cumsum(rng.normal(size=80))).union(bars_of(spark, "B", [5.0] * 30)).union(bars_of(spark, "C", [7.0]))
    sets = S.grid(spark, short=list(range(1, 9)), long=list(range(9, 18)))
    for direction in ("long", "short"):
        rules = S.Rules(direction=direction, stop=("atr_multiple", 2.0), target=("risk_reward_ratio", 1.5))
        got = {(r.param_id, r.symbol): r for r in S.optimise_cross(bars, sets, rules).collect()}
        assert len(got) == 72 * 2
        for short, long in ((1, 9), (4, 12), (7, 17), (8, 17)):
            run = S.backtest(S.with_atr(S.ma_cross_signals(bars, short, long, direction)), rules)
            for want in S.equity_metrics(run, rules.initial_cash).collect():
                one, figures = got[f"{short}_{long}", want.symbol].asDict(), {k: v for k, v in want.asDict().items() if k != "symbol"}
                assert {k: one[k] for k in figures} == pytest.approx(figures, rel=1e-9, abs=1e-9)


def test_sets_move_bars_once(spark):
    """Bars are not multiplied by sets: a row per bar and SETS parameter sets goes into the tasks."""
    bars, sets = bars_of(spark, "A", range(50)), S.grid(spark, short=list(range(1, 9)), long=list(range(9, 18)))
    plan = S.optimise_cross(bars, sets, S.Rules())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Generate inline") == 1 and "param_id" not in plan.split("Generate inline")[1]
