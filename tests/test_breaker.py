import random

import numpy as np
import pytest

from tests.test_rules import plain_breaker
from tidemark.operators import market as M


@pytest.mark.parametrize("cut", [1, 13, 4000])
def test_counts_pass_from_batch_to_batch(cut):
    """Batches of any size give the steps of the machine, whatever count a source starts from."""
    draw = np.random.default_rng(4)
    n = 4000
    late, ok, first, start = draw.random(n) < 0.3, draw.random(n) < np.repeat([0.02, 0.5], n // 2), draw.random(n) < 0.02, draw.integers(0, 11, n)
    first[0], state, want, got = True, 0, [], []
    for i in range(n):
        state = int(start[i]) if first[i] else state
        want.append(state)
        state = int(M.breaker_steps(np.array([state]), late[i], ok[i])[0])
    carried = 0
    for i in range(0, n, cut):
        part = slice(i, i + cut)
        before = M.failures_before(late[part], ok[part], first[part], start[part], carried)
        carried = int(M.breaker_steps(before[-1:], late[part][-1], ok[part][-1])[0])
        got += before.tolist()
    assert got == want


@pytest.mark.parametrize("block_rows", [1_000_000, 40])
def test_sources_are_not_groups(spark, block_rows):
    """Sources of any size are one sorted pass; the rows keep their columns, null ids among them."""
    draw = random.Random(8)
    rows = [(s, float(draw.randrange(10**6)), None if i == 3 else 2**60 + i, draw.random() < 0.1, f"{s}-{i}") for s in range(40) for i in range(300 if s == 7 else 12)]
    df = spark.createDataFrame(rows, "source int, ts double, call_id long, ok boolean, note string")
    found = M.breaker(df, 2_000, block_rows)
    got = found.collect()
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[4] for r in got) == sorted(r[4] for r in rows) and {(r.note, r.call_id) for r in got} == {(r[4], r[2]) for r in rows}
    for s in range(40):
        of = sorted((r for r in got if r.source == s), key=lambda r: (r.ts, r.call_id or 2**62))
        assert [(r.open, r.tripped) for r in of] == plain_breaker([(r.ts, r.ok) for r in of], 2_000)
