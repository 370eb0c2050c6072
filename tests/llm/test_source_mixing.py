from collections import Counter, defaultdict
from math import log

import pytest

from tidemark.llm import source_mixing as M

from .test_packing import library_ids


def mixed(spark, **how):
    rows = [(i, "big", "w " * 10) for i in range(900)] + [(1000 + i, "mid", "w " * 10) for i in range(90)] + [(2000 + i, "small", "w " * 10) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return M.mix(df, **how)


def shares(rows):
    c = Counter()
    for r in rows:
        c[r.source] += r.mix_tokens
    return c


def test_entropy_target(spark):
    rows = mixed(spark, target_entropy=0.6, repeat_limit=1000.0).collect()
    w = {r.source: r.mix_weight for r in rows}
    assert -sum(x * log(x) for x in w.values()) / log(3) == pytest.approx(0.6, abs=1e-4) and sum(w.values()) == pytest.approx(1)
    got = shares(rows)
    assert all(got[s] / sum(got.values()) == pytest.approx(w[s], abs=0.01) for s in w)
    assert len({r.doc_id for r in rows}) == 1000  # at least one whole pass of every source


def test_repetition_limit(spark):
    rows = mixed(spark, target_entropy=1.0, repeat_limit=2.0).collect()
    times = Counter(r.doc_id for r in rows)
    by = defaultdict(list)
    for d, n in times.items():
        by[d // 1000].append(n)
    assert set(by[0]) == {1} and set(by[2]) == {2}


def test_budget_cuts_a_pass(spark):
    rows = mixed(spark, budget=5000.0, target_entropy=0.0).collect()
    got = shares(rows)
    assert got["big"] == pytest.approx(4500, abs=20) and got["small"] == pytest.approx(50, abs=20) and max(r.mix_pass for r in rows) == 1


def test_passes_are_permuted(spark):
    rows = mixed(spark, target_entropy=1.0, repeat_limit=3.0).where("source = 'small'").collect()
    order = lambda p: [r.doc_id for r in sorted((r for r in rows if r.mix_pass == p), key=lambda r: (r.mix_block, r.mix_place))]
    assert sorted(order(1)) == sorted(order(2)) and order(1) != order(2)


def test_rows_equal_a_plain_computation(documents):
    docs = documents.collect()
    words = lambda t: len(library_ids(t))
    tokens = Counter()
    for d in docs:
        tokens[d.source] += words(d.text)
    rows = M.mix(documents, target_entropy=0.999, repeat_limit=1.5).collect()
    w = {r.source: r.mix_weight for r in rows}
    spend = max(tokens[s] / w[s] for s in w)
    for s in w:
        passes = w[s] * spend / tokens[s]
        got = sum(r.mix_tokens for r in rows if r.source == s)
        largest = max(words(d.text) for d in docs if d.source == s)
        assert int(passes + 1e-9) * tokens[s] <= got <= passes * tokens[s] + 1e-6 and got > passes * tokens[s] - largest - 1


def test_odd_rows(odd, empty):
    got = M.mix(odd, plan_columns=False)
    assert got.columns == odd.columns and Counter(r.doc_id for r in got.collect()).keys() == {1, 2, 3, None, 4, 5, 2**60 + 1}
    assert M.mix(empty).count() == 0 and len(M.mix(odd).columns) == len(odd.columns) + 5


def test_rows_without_ids_have_places_of_their_own(spark):
    df = spark.createDataFrame([(None, "a", "w " * 10)] * 100, "doc_id long, source string, text string")
    tokens = len(library_ids("w " * 10))
    assert M.mix(df, budget=50.0 * tokens).count() == 50


def brute(rows, budget, target, limit):
    """Which ids come how often, from the same hashes but by plain loops over passes, blocks and places."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    tokens = {s: sum(r.n for r in rs) for s, rs in by.items()}

    def entropy(e):
        x = [t**e for t in tokens.values()]
        return -sum(v / sum(x) * log(v / sum(x)) for v in x)

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) >= target * log(len(by)) else (low, middle)
    e = max(low, 1 - log(limit) / log(max(tokens.values()) / min(tokens.values())))
    z = sum(t**e for t in tokens.values())
    spend, got = budget or max(tokens[s] / (tokens[s] ** e / z) for s in by), Counter()
    for s, rs in by.items():
        passes = tokens[s] ** e / z * spend / tokens[s]
        left = (passes - int(passes + 1e-6)) * tokens[s]
        for r in rs:
            got[r.doc_id] += int(passes + 1e-6)
        for r in sorted(rs, key=lambda r: (r.turn, r.block, r.place)):
            if r.n > left + 1e-6:
                break
            left -= r.n
            got[r.doc_id] += 1
    return +got


@pytest.mark.parametrize(("budget", "target", "limit"), [(20_000.0, 0.8, 3.0), (None, 0.99, 1.7)])
def test_rows_equal_brute_force(spark, budget, target, limit):
    from pyspark.sql import functions as F

    rows = [(i, "big" if i % 10 else "mid" if i % 50 else "small", "w " * (5 + i % 37)) for i in range(1, 901)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix(df, budget=budget, target_entropy=target, repeat_limit=limit)
    key = F.struct(F.lit(False), F.col("source"))
    block = F.pmod(F.xxhash64(F.lit(M.SEED + 1), "doc_id"), F.lit(M.BLOCKS))
    whole = {r.source: r.w for r in mixed.groupBy("source").agg(F.max("mix_pass").alias("w")).collect()}
    turns = df.withColumn("block", block).withColumn("place", F.xxhash64(F.lit(M.SEED), "doc_id")).withColumn("n", M.n_tokens(F.col("text")))
    got = Counter(r.doc_id for r in mixed.collect())
    for last in (0, 1):  # the partial pass is the last that a source has, or the one after it if it took no row
        named = F.create_map(*[F.lit(v) for s, w in whole.items() for v in (s, w + last)])
        turned = turns.withColumn("turn", F.xxhash64(F.lit(M.SEED + 2), key, F.element_at(named, F.col("source")).cast("long"), "block"))
        if got == brute(turned.collect(), budget, target, limit):
            return
    raise AssertionError("the rows differ")


def test_order_of_the_files(spark):
    """Without plan columns the rows lie in the order of passes, blocks and places."""
    planned = mixed(spark, target_entropy=1.0, repeat_limit=3.0).orderBy("mix_pass", "mix_block", "mix_place").collect()
    plain = mixed(spark, target_entropy=1.0, repeat_limit=3.0, plan_columns=False).collect()
    assert [r.doc_id for r in plain] == [r.doc_id for r in planned]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i, "a", "w", 1) for i in range(5)], "doc_id long, source string, text string, `a.b` int")
    assert M.mix(df, plan_columns=False).columns == df.columns and M.mix(df).count() == 5


def test_the_query_binds(spark, documents):
    """Bisected exponent below 1, whole and partial passes, the budget spent: row by row as by brute force."""
    from .conftest import DATA

    got = M.op9_source_mixing(spark, DATA).collect()
    tokens = Counter()
    for d in documents.collect():
        tokens[d.source] += len(library_ids(d.text))
    budget, shares_ = M.QUERY_BUDGET * sum(tokens.values()), Counter()
    for r in got:
        shares_[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    passes = {s: weight[s] * budget / tokens[s] for s in weight}
    entropy = -sum(w * log(w) for w in weight.values()) / log(len(weight))
    repeated = max(passes.values()) / min(passes.values())
    assert repeated <= M.REPEAT_LIMIT + 1e-6 and (entropy == pytest.approx(M.QUERY_ENTROPY, abs=2e-6) or repeated == pytest.approx(M.REPEAT_LIMIT, rel=1e-6))
    assert {r["pass"] for r in got} >= {1, 2} and any(weight[s] != pytest.approx(tokens[s] / sum(tokens.values()), rel=1e-3) for s in weight)
    longest = max(r.n_tokens for r in got)
    assert all(weight[s] * budget - longest <= shares_[s] <= weight[s] * budget + 1e-6 for s in weight)
    times = Counter((r.source, r.doc_id) for r in got)
    for s in weight:
        whole = int(weight[s] * budget / tokens[s] + 1e-9)
        assert {n for (source, _), n in times.items() if source == s} <= {whole, whole + 1}
