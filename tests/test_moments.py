"""Factors evaluated together against pandas, one at a time."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import moments as M

K = 300


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    n = 40 * 25
    df = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=40).repeat(25).date, "symbol": np.tile([f"S{i:02d}" for i in range(25)], 40)})
    base = draw.normal(size=(n, 8))
    x = base @ draw.normal(size=(8, K)) + draw.normal(size=(n, K)) + 1e4 * (np.arange(K) % 3 == 0)
    x[draw.random((n, K)) < 0.1] = np.nan
    x[:, 5], x[:, 6], x[30:, 7], x[3, 8] = 4.0, np.nan, np.nan, np.inf
    x[:, 9] = np.round(x[:, 10])
    df["fwd"] = np.where(draw.random(n) < 0.05, np.nan, base[:, 0] + draw.normal(size=n))
    return pd.concat([df, pd.DataFrame(x, columns=[f"f{i}" for i in range(K)])], axis=1)


FACTORS = [f"f{i}" for i in range(K)]


@pytest.fixture(scope="module")
def found(spark, rows):
    return M.moments(spark.createDataFrame(rows.sample(frac=1, random_state=1)), FACTORS, "fwd").cache()


def test_scores_equal_pandas(rows, found):
    got = M.factor_scores(found, FACTORS).toPandas().set_index("factor")
    assert sorted(got.index) == sorted(FACTORS)
    for f in ["f0", "f3", "f5", "f6", "f7", "f8", "f9", "f10", "f299"]:
        ics = {"pearson": [], "spearman": []}
        for _, day in rows.groupby("date"):
            pair = day[[f, "fwd"]].replace([np.inf, -np.inf], np.nan).dropna()
            if len(pair) >= 3 and pair[f].nunique() > 1:
                for kind in ics:
                    x = pair.rank() if kind == "spearman" else pair
                    ics[kind].append(x[f].corr(x["fwd"]))
        p, s = (pd.Series(ics[k], dtype=float) for k in ics)
        assert got.dates[f] == len(p)
        for value, want in ((got.ic_mean[f], p.mean()), (got.ic_std[f], p.std()), (got.icir[f], p.mean() / p.std()), (got.rank_ic_mean[f], s.mean()), (got.rank_icir[f], s.mean() / s.std())):
            assert value == pytest.approx(want, rel=1e-9, nan_ok=True) or np.isnan(want) and pd.isna(value), f


def test_correlations_equal_pandas(rows, found):
    """Every pair, with the floor of common values; large means do not cost digits."""
    got = M.factor_correlations(found, FACTORS).toPandas()
    x = rows[FACTORS].replace([np.inf, -np.inf], np.nan)
    want = x.corr(min_periods=20)
    assert len(got) == sum(((~x[[a]].isna().to_numpy()) & ~x.isna().to_numpy()).sum(axis=0)[FACTORS.index(a) + 1 :].__ge__(20).sum() for a in FACTORS)
    values = got["corr"].astype(float).to_numpy()
    expected = want.to_numpy()[got.a.str[1:].astype(int), got.b.str[1:].astype(int)]
    off = ~np.isclose(values, expected, rtol=1e-8, atol=1e-9, equal_nan=True)
    assert not off.any(), got[off].assign(want=expected[off])


def test_the_panel_is_read_once(spark, rows):
    plan = M.moments(spark.createDataFrame(rows), FACTORS, "fwd")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1


def test_choice_is_greedy(spark):
    scores = spark.createDataFrame([("a", 0.10, 1.0), ("b", -0.09, 1.0), ("c", 0.05, 0.1), ("d", 0.05, 0.9), ("e", 0.01, 9.0), ("f", None, None), ("g", 0.08, None)], "factor string, rank_ic_mean double, rank_icir double")
    pairs = spark.createDataFrame([("a", "b", -0.7), ("b", "c", 0.99), ("a", "d", 0.69), ("c", "d", 0.95)], "a string, b string, corr double")
    assert [r.factor for r in M.chosen_factors(scores, pairs).orderBy("place").collect()] == ["a", "g", "c"]
    assert [r.factor for r in M.chosen_factors(scores, pairs, least_icir=0.5).orderBy("place").collect()] == ["a", "d"]
    assert [r.factor for r in M.chosen_factors(scores, pairs, top=1).collect()] == ["a"]


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "date date, f double, g double, fwd double")
    found = M.moments(empty, ["f", "g"], "fwd")
    assert M.factor_correlations(found, ["f", "g"]).count() == 0 and [r.dates for r in M.factor_scores(found, ["f", "g"]).collect()] == [0, 0]
