"""Rules whose figures come from what they are to do, not from the code: metrics, stability, breaker, fronts, recursion."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import desk as D
from tidemark.operators import market as M
from tidemark.operators import search as E
from tidemark.operators import simulate as S
from tidemark.operators import technical as T


def run_of(spark, *pnls):
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1000.0 + i, p, 1.0, "signal") for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, date date, equity double, pnl double, fee double, reason string")


@pytest.mark.parametrize(("pnls", "ratio"), [((5.0, 7.0), 2.0), ((5.0, 7.0, -3.0), 2.0), ((-3.0,), 0.0), ((4.0, 0.0), 1.0), ((), None)])
def test_profit_to_loss(spark, pnls, ratio):
    """Mean win over mean loss; without a loss the number of wins."""
    row = S.equity_metrics(run_of(spark, *pnls), 1000.0).first()
    assert (row and row.profit_loss_ratio) == ratio


def results(spark, *windows):
    rows = [(s, w, p, r, q, 50) for s, w, (tr, te) in windows for p, x in (("train", tr), ("test", te)) if x for r, q in [x]]
    return spark.createDataFrame(rows, "symbol string, window_id int, phase string, total_return_pct double, sharpe double, score int")


def test_stability_needs_windows(spark):
    up, down = (5.0, 1.0), (-5.0, -1.0)
    r = results(spark, ("one", 0, (up, up)), ("good", 0, (up, up)), ("good", 1, (up, up)), ("good", 2, (up, down)), ("bad", 0, (up, down)), ("bad", 1, (up, down)), ("bad", 2, (up, up)), ("lost", 0, (up, up)), ("lost", 1, (up, up)), ("lost", 2, (up, None)))
    got = {x.symbol: x for x in S.stability(r).collect()}
    assert {s: (x.windows, x.failed_windows, x.validation, x.reason) for s, x in got.items()} == {
        "one": (1, 2, "inconclusive", "too_few_windows"), "good": (3, 0, "stable", None), "bad": (3, 0, "unstable", None), "lost": (2, 1, "inconclusive", "failed_windows")}
    assert got["one"].return_mean is None and got["good"].positive_return_rate == pytest.approx(2 / 3) and got["good"].consistency == pytest.approx(100 - 2 / 3 * 20)
    planned = spark.range(5).select(F.col("id").cast("int").alias("window_id"))
    assert {x.validation for x in S.stability(r, planned).collect()} == {"inconclusive"} and {x.failed_windows for x in S.stability(r, planned).collect()} == {4, 2, 3}


def plain_breaker(calls, cool_down):
    """The rules one call at a time: (open, tripped)."""
    count, last, out = 0, None, []
    for ts, ok in calls:
        is_open = count >= 5 and (count >= 10 or ts - last < cool_down)
        if count >= 5 and not is_open:
            count = 0
        count = 0 if ok else min(count + 1, 10)
        last = ts if not ok else last
        out.append((is_open, count >= 5))
    return out


@pytest.mark.parametrize("block_rows", [1_000_000, 7])
def test_breaker(spark, block_rows):
    draw, rows = random.Random(3), []
    for source, share, n in (("a", 0.1, 200), ("b", 0.5, 60), ("c", 0.9, 30), ("d", 0.02, 150), (None, 0.2, 40)):
        ts = 0.0
        for i in range(n):
            ts += draw.choice([1, 5, 60, 700])
            rows.append((source, ts, i, draw.random() < share))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, ts double, call_id int, ok boolean")
    got = {}
    for r in sorted(M.breaker(df, 600, block_rows).collect(), key=lambda r: r.ts):
        got.setdefault(r.source, []).append((r.open, r.tripped))
    for source in got:
        assert got[source] == plain_breaker(sorted((ts, ok) for s, ts, _, ok in rows if s == source), 600), source


def test_a_success_empties_the_window(spark):
    calls = [(float(i), ok) for i, ok in enumerate([False] * 4 + [True] * 2 + [False] * 4 + [True, False])]
    df = spark.createDataFrame([("s", t, i, ok) for i, (t, ok) in enumerate(calls)], "source string, ts double, call_id int, ok boolean")
    assert not any(r.open or r.tripped for r in M.breaker(df).collect()) and M.breaker(df.limit(0)).count() == 0


def test_rows_that_lack_a_measure_stay_on_the_front(spark):
    rows = [("x", 1.0, 1.0, 1.0), ("y", 2.0, 2.0, 2.0), ("n", None, 5.0, 0.0), ("m", 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double")
    for cols in (["a", "b"], ["a", "b", "c"]):
        assert {r.k for r in T.pareto_front(df, "k", cols).collect()} == {"y", "n", "m"}


def test_crowding(spark):
    """Neighbours' gaps as shares of the range: ends are infinite."""
    df = spark.createDataFrame([("p", 0.0, 10.0), ("q", 2.0, 6.0), ("r", 3.0, 5.0), ("s", 10.0, 0.0)], "k string, a double, b double")
    got = {r.k: r.crowding for r in T.crowding(df, ["a", "b"]).collect()}
    assert got == {"p": float("inf"), "s": float("inf"), "q": pytest.approx(0.3 + 0.5), "r": pytest.approx(0.8 + 0.6)}


def test_suggestions_end_with_the_space():
    bounds = {"a": (1, 2)}
    tried = [{"a": 1}, {"a": 2}]
    assert E.suggested(tried, [0.1, 0.2], bounds, 3) == []


def test_a_cycle_ends_and_names_are_values(spark):
    edges = spark.createDataFrame([("o'x", "b"), ("b", "c"), ("c", "o'x"), ("b", "d"), ("c", "d")], "parent string, child string")
    got = sorted(map(tuple, M.children_of(edges, "o'x").collect()))
    assert got == [("b", 1), ("c", 2), ("d", 2), ("d", 3), ("o'x", 0)]
    other = spark.createDataFrame([("o'x", "z")], "parent string, child string")
    first, second = M.children_of(edges, "b"), M.children_of(other, "o'x")
    assert sorted(map(tuple, second.collect())) == [("o'x", 0), ("z", 1)] and first.count() == 5


@pytest.mark.parametrize(("inner", "outer", "stability"), [(2.0, 1.0, 50.0), (1.0, 3.0, 100.0), (1.0, -1.0, 0.0), (-1.0, -0.5, 50.0), (0.0, 0.0, 100.0), (0.0, 1.0, 0.0), (1.0, None, 0.0), (1.0, "none", 50.0)])
def test_fitness_out_of_sample(spark, inner, outer, stability):
    parts = dict.fromkeys(D.FITNESS, 60.0)
    scored = spark.createDataFrame([("S", inner, *parts.values())], "symbol string, sharpe double, " + ", ".join(f"{c} double" for c in parts))
    test = spark.createDataFrame([] if outer == "none" else [("S", outer)], "symbol string, sharpe double")
    r = D.fitness_out_of_sample(scored, test, ["symbol"]).first()
    weights = {c: w - 0.05 if c in ("win_score", "profit_score") else w for c, w in D.FITNESS.items()}
    weights = {c: max(0.05, w) for c, w in weights.items()}
    want = (60 * sum(weights.values()) + stability * 0.25) / (sum(weights.values()) + 0.25)
    assert r.stability_score == stability and r.fitness == pytest.approx(want, abs=0.0051)
