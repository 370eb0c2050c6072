import numpy as np
import pandas as pd
import pytest

from tidemark.llm import embedding_dedup as E
from tidemark.llm.shared import least_roots, table


def brute(rows, cosine=0.98):
    n = len(rows)
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    a, b, links = [], [], [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    a.append(i), b.append(j)
                    links[i] += 1
                    links[j] += 1
    root = least_roots(n, np.array(a, int), np.array(b, int))
    least = [min(rows[k][0] for k in range(n) if root[k] == root[i]) for i in range(n)]
    return sorted((r[0], links[i], least[i], r[0] == least[i]) for i, r in enumerate(rows))


def test_matches_brute_force(spark):
    t = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    assert sorted(map(tuple, E.embedding_groups(t).collect())) == brute(rows)


def test_dense_group_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.08).astype("f4").tolist(), 1) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(40)] + [(400 + i, rng.normal(size=64).astype("f4").tolist(), i % 3) for i in range(200)]
    got = sorted(map(tuple, E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    want = brute(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (2**60 + 1, [1.0, 0.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS links")
    got = sorted(map(tuple, E.embedding_groups(df).collect()))
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *[(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)], (2**60 + 1, 3, 1, False)]
    assert E.embedding_groups(df.limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(None, [1.0, 0.0], 1), (None, None, 1), (2**60 + 2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1", "2")).coalesce(1)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_groups(more).collect()}
    assert {(None, 4, 1, False), (None, 0, None, False), (2, 4, 1, False), (2**60 + 1, 4, 1, False), (2**60 + 2, 0, 2**60 + 2, True)} <= got


def test_zeros_of_either_sign(spark):
    """Vectors that differ in the sign of a zero are equal, and each row finds its vector."""
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [-0.0, 1.0], 1), (4, [0.0, 1.0], 1), (5, [0.0, 1.0], 2)]
    for kind in ("float", "double"):
        got = sorted(map(tuple, E.embedding_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()))
        assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_bits_lose_no_pair(least):
    """Candidate pairs of units against every pair looked at one by one, with many pivots on few bits."""
    rng = np.random.default_rng(least)
    rows = []
    for unit in range(60):
        for node in range(int(rng.integers(2, 30))):
            pivots = np.append(rng.choice(np.setdiff1d(np.arange(0, 2048, 64), [640]), 5, replace=False), 640)
            rng.shuffle(pivots)
            rows.append((1, 4, 640, unit, unit, 0, unit * 100 + node, 1, pivots.astype("i4"), rng.uniform(0.5, 0.9, 6).astype("f4")))
    t = pd.DataFrame(rows, columns=["label", "dim", "pivot", "ublock", "vblock", "own", "node", "copies", "pivots", "angles"])
    units = E._Units(t, 0.98, least)
    got = sorted((int(a), int(b)) for x, y in units.pairs() for a, b in zip(x, y, strict=True))
    want = []
    for a in range(len(t)):
        for b in range(a + 1, len(t)):
            if t.ublock[a] == t.ublock[b]:
                one, two = (dict(zip(t.pivots[k].tolist(), t.angles[k].tolist(), strict=True)) for k in (a, b))
                both = one.keys() & two.keys()
                if len(both) >= least and min(both) == 640 and all(abs(one[p] - two[p]) <= units.most for p in both):
                    want.append((a, b))
    assert got == want and want


def test_spread_leaves_out_near_pivots():
    p = np.eye(4)
    assert len(E.spread(np.vstack([p, p]))) == 4


def turned(rng, x, cosine):
    """A vector at the given cosine to ``x``."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_recall_near_the_threshold(spark, dim):
    """Pairs of cosine 0.98 to 0.99 among many other vectors, alone and in groups: at least 99 in 100 are found."""
    rng = np.random.default_rng(dim)
    points = [v / np.linalg.norm(v) for v in rng.normal(size=(1500, dim))]
    for k in range(400):
        points.append(turned(rng, points[k], rng.uniform(0.9801, 0.99)))
    for k in range(20):
        points += [turned(rng, points[500 + k], rng.uniform(0.985, 0.995)) for _ in range(15)]
    x = np.array(points, dtype="f4")
    near = x.astype(float) @ x.astype(float).T / np.outer(*[np.linalg.norm(x.astype(float), axis=1)] * 2) >= 0.98
    want = near.sum() - len(x)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in E.embedding_groups(df).collect()}
    assert all(n <= near[i].sum() - 1 for i, n in got.items())
    assert sum(got.values()) >= 0.99 * want, (sum(got.values()), want)


def test_strips_make_no_difference(spark, monkeypatch):
    t = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = sorted(map(tuple, E.embedding_groups(t).collect()))
    unit = pd.DataFrame({"label": 1, "dim": 2, "pivot": 0, "ublock": 0, "vblock": 0, "own": 0, "node": range(30), "copies": 1, "pivots": [[0, 1]] * 30, "angles": [[0.1, 0.2]] * 30, "embedding": [[1.0, 0.001 * i] for i in range(30)]})
    whole = pd.concat(E._verify(0.98, 2)(iter([unit])))
    monkeypatch.setattr(E, "CELLS", 70)
    assert pd.concat(E._verify(0.98, 2)(iter([unit]))).equals(whole)
    monkeypatch.setattr(E, "SMALL", 3)
    assert pd.concat(E._verify(0.98, 2)(iter([unit]))).equals(whole) and (whole.links == 29).all() and (whole.root == 0).all()
    assert rows == brute([(r.vec_id, r.embedding, r.label) for r in t.collect()])
