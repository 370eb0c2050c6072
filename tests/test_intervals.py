import random

import pytest

from tidemark.operators import intervals as I


def numbers(spark):
    draw = random.Random(5)
    some = lambda n: None if draw.random() < 0.2 else draw.randrange(n)
    points = [(k, some(3), some(100)) for k in range(150)]
    spans = [(k, some(3), some(100), some(100)) for k in range(120)]
    return points, spans, spark.createDataFrame(points, "p int, k int, at int"), spark.createDataFrame(spans, "s int, k int, a int, z int")


@pytest.mark.parametrize("size", [256, 4])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_all_pairs(spark, monkeypatch, size, how):
    monkeypatch.setattr(I, "LIST_ROWS", size)
    points, spans, p, s = numbers(spark)
    meets = lambda q, r: None not in (q[1], q[2]) and q[1] == r[1] and (r[2] is None or q[2] >= r[2]) and (r[3] is None or q[2] < r[3])
    empty = lambda r: None not in r[2:] and r[2] >= r[3]
    pairs = [(q[0], r[0]) for q in points for r in spans if meets(q, r) and not empty(r)]
    lone = {q[0] for q in points} - {q for q, _ in pairs} if how == "left" else set()
    got = [(r.p, r.s) for r in I.interval_join(p, s, ["k"], "at", "a", "z", 9.0, how).collect()]
    assert sorted(got, key=str) == sorted([*pairs, *[(q, None) for q in lone]], key=str)


def test_joins_lists_and_never_gathers_points(spark):
    """The join makes a row per point and list, not per pair, and does not build a table of the points."""
    points, spans, p, s = numbers(spark)
    joined = I.interval_join(p, s, ["k"], "at", "a", "z", 9.0)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate inline" in plan and "SortMergeJoin" in plan and "BuildLeft" not in plan.split("Generate inline")[1].split("\n")[1]


def test_rows_of_near_points_repeat_the_same_intervals(spark, monkeypatch):
    """However many intervals a bucket has, neighbours in the result share theirs, so files stay small; pairs are unfolded one by one."""
    monkeypatch.setattr(I, "LIST_ROWS", 10)
    p = spark.range(100).selectExpr("id AS p", "1 AS k", "CAST(id % 9 AS INT) AS at")
    s = spark.range(500).selectExpr("id AS s", "1 AS k", "CAST(NULL AS INT) AS a", "CAST(NULL AS INT) AS z")
    joined = I.interval_join(p, s, ["k"], "at", "a", "z", 9.0)
    got = [(r.p, r.s) for r in joined.collect()]
    assert sorted(got) == [(i, j) for i in range(100) for j in range(500)]
    for i in range(0, len(got), 100):
        assert len({j for _, j in got[i : i + 100]}) == 10 and len({j for j, _ in got[i : i + 100]}) == 10
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Project [_points" in plan and ") Project [_points" not in plan  # a part of the join's or the unfolding's loop would hold all pairs of a list
