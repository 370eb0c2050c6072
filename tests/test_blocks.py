"""Blocked series against the plain forms: pandas, windows over a symbol, formulas."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators.continuous import as_of
from tidemark.plans.blocked import blocked_formulas
from tidemark.plans.formula import FormulaError, with_formulas

SCHEMA = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def panel(spark):
    """One symbol with most of the rows, small ones, a null one; missing values in runs longer than a block."""
    draw, rows = random.Random(5), []
    for symbol, n in (("hot", 700), ("small", 20), ("one", 1), (None, 30), ("gaps", 150)):
        for i in range(n):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if i < 400 else 400 + (i - 400) ** 2)
            missing = draw.random() < 0.1 or (symbol == "hot" and 100 <= i < 220) or (symbol == "gaps" and i < 100)
            v = None if missing else draw.gauss(100, 20)
            rows.append((symbol, at, *[v and v + k for k in (0.0, 5.0, -5.0, draw.random())], float(draw.randint(0, 3)), v))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def pdf(df):
    out = df.toPandas()
    return out.sort_values(["symbol", "date"], na_position="first").reset_index(drop=True)


def test_blocks_are_even_and_in_order(panel):
    got = pdf(B.deal(panel, 50))
    hot = got[got.symbol == "hot"]
    sizes = hot[B.BLOCK].value_counts()
    assert hot[B.BLOCK].is_monotonic_increasing and len(sizes) == 14 and sizes.max() <= 2 * sizes.median()
    assert set(got[got.symbol != "hot"].groupby("symbol", dropna=False)[B.BLOCK].max()) == {0, 2}


@pytest.mark.parametrize(("alpha", "adjust"), [(0.3, False), (0.3, True), (2 / 61, False), (2 / 61, True), (1.0, False), (0.9, False), (0.9, True), (0.001, True)])
def test_averages_equal_pandas(panel, alpha, adjust):
    got = pdf(B.recursive_averages(B.deal(panel, 30), {"y": ("close", alpha, adjust)}))
    want = got.groupby("symbol", dropna=False)["close"].transform(lambda x: x.ewm(alpha=alpha, adjust=adjust).mean())
    assert np.allclose(got.y, want, rtol=1e-12, atol=0, equal_nan=True) and len(got) == panel.count()


def test_maps_compose_like_one_pass():
    draw = np.random.default_rng(3)
    for _ in range(60):
        x = np.where(draw.random(80) < draw.choice([0.05, 0.5, 0.95]), np.nan, draw.normal(size=80) * 1e3)
        cuts = [0, *sorted(draw.integers(0, 81, size=5).tolist()), 80]
        parts = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        for adjust in (True, False):
            alpha = float(draw.choice([0.05, 0.5, 1.0]))
            states = B.composed([B.affine_map(p, alpha, adjust) for p in parts], alpha, adjust)
            got = np.concatenate([B.averaged(p, alpha, s, adjust) for p, s in zip(parts, states, strict=True)])
            assert np.allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=adjust).mean(), rtol=1e-11, equal_nan=True)


def test_running_totals_equal_windows(panel):
    totals = {"s": ("sum", "close"), "n": ("count", "close"), "top": ("max", "close"), "low": ("min", "close"), "known": ("last", "close")}
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    want = pdf(panel.withColumns({"s": F.sum("close").over(w), "n": F.count("close").over(w), "top": F.max("close").over(w), "low": F.min("close").over(w), "known": F.last("close", ignorenulls=True).over(w)}))
    pd.testing.assert_frame_equal(pdf(B.running(B.deal(panel, 25), totals))[want.columns], want)


def test_halo_spans_blocks(panel):
    """A halo of three blocks: every row comes with exactly the rows before it."""
    dealt = B.with_halo(B.deal(panel, 20), 70).select("symbol", "date", B.BLOCK, "_halo").toPandas()
    whole = pdf(panel.select("symbol", "date"))
    hot = whole[whole.symbol == "hot"].date.tolist()
    for block, rows in dealt[dealt.symbol == "hot"].groupby(B.BLOCK):
        first = hot.index(rows[~rows._halo].date.min())
        assert sorted(rows[rows._halo].date) == hot[max(0, first - 70) : first], block
    assert (~dealt._halo).sum() == len(whole)


def test_as_of_equals_the_plain_form(panel):
    right = panel.where("volume = 1").select("symbol", "date", F.col("close").alias("other"), F.col("volume").alias("v"))
    left = panel.where("volume <> 1").select("symbol", "date", "close").where("symbol is not null")
    want = pdf(as_of(left, right, "symbol", "date", ["other", "v"]))
    pd.testing.assert_frame_equal(pdf(B.as_of_blocks(left, right, "symbol", "date", ["other", "v"], 25))[want.columns], want)
    nulls = panel.where("symbol is null").select("symbol", "date", "close")
    assert B.as_of_blocks(nulls, right, "symbol", "date", ["other"], 25).where("other is not null").count() == 0


FORMULAS = {
    "a": "ts_mean(close, 5) - ts_delay(close, 3)", "b": "ts_std(ts_delta(close, 2), 40)", "c": "ema(close, 12) - ema(close, 26)", "d": "ema(ema(close, 12) - ema(close, 26), 9)", "e": "ts_max(ema(ts_mean(close, 3), 5), 7)",
    "f": "rank(ts_delta(close, 2)) + ts_mean(rank(close), 3)", "g": "ts_median(close, 9) + ts_rank(close, 9) + ts_rank_pct(close, 9)", "h": "atr(high, low, close, 5)", "i": "cum_sum(volume) / ts_sum(volume, 4)", "j": "zscore(close) * 2", "k": "close ** 0.5",
}


def test_formulas_equal_the_plain_form(panel):
    want, got = (pdf(f) for f in (with_formulas(panel, FORMULAS), blocked_formulas(panel, FORMULAS, 60)))
    assert got.columns.tolist() == want.columns.tolist()
    for name in FORMULAS:
        assert np.allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, equal_nan=True), name
    with pytest.raises(FormulaError):
        blocked_formulas(panel, {"x": "ts_delay(close, -1)"})


def test_long_windows_equal_sorted_ones(panel, monkeypatch):
    from tidemark.plans import formula

    formulas = {"m": "ts_median(close, 90)", "r": "ts_rank(close, 90)", "p": "ts_rank_pct(volume, 90)", "d": "ts_deviation(close, 90)", "n": "ts_mean(ts_median(close, 70), 3)"}
    got = pdf(with_formulas(panel, formulas))
    monkeypatch.setattr(formula, "LONG_WINDOW", 10**9)
    want = pdf(with_formulas(panel, formulas))
    for name in formulas:
        assert np.allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_sliding_cost_does_not_grow_with_the_window():
    """Steps in the tree per row: ten times the window costs about the same."""
    draw = np.random.default_rng(1)
    x, steps = draw.normal(size=4000), Counter()
    class Counted(B.RankTree):
        def add(self, *a):
            steps[self.window] += 1
            super().add(*a)
    original, B.RankTree = B.RankTree, Counted
    try:
        for Counted.window in (100, 1000):
            B.sliding("median", x, Counted.window)
    finally:
        B.RankTree = original
    assert steps[1000] <= steps[100]


def test_a_hot_symbol_is_spread(spark):
    """A third of a million rows of one symbol: no task of the averages has twice the median's rows."""
    rows = spark.range(300_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("date"), (F.col("id") % 97).cast("double").alias("x"))
    dealt = B.deal(rows, 10_000)
    out = B.recursive_averages(dealt, {"y": ("x", 0.2, False)})
    sizes = [r["count"] for r in out.groupBy(B.BLOCK).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1.2 * sorted(sizes)[15]
    keyed = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(symbol" in line and "_block" not in line]
    assert all("_block" in line or "300" not in line for line in keyed)


def test_empty_panel(panel):
    empty = panel.limit(0)
    assert blocked_formulas(empty, FORMULAS).count() == 0 and B.as_of_blocks(empty, empty.select("symbol", "date", F.col("close").alias("o")), "symbol", "date", ["o"]).count() == 0
