import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash_dedup as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """Smallest id reachable, for (id, print) rows."""
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in out and bin(prints[a] ^ prints[b]).count("1") <= 3:
                    out[b] = start
                    todo.append(b)
    return out


def test_matches_brute_force(documents, texts):
    prints = {d: brute_print(t) for d, t in texts.items()}
    groups = brute_groups(prints)
    for r in S.simhash_groups(documents).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]


def test_masks_cover_every_triple():
    masks = S.covering_masks()
    assert len(masks) == 15
    for bits in combinations(range(64), 3):
        v = sum(1 << b for b in bits)
        assert any(not m & v for m in masks)


def test_links_are_complete(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    signed = {x: int(np.uint64(x).view(np.int64)) for x in fps}
    want = {}
    for node, least in brute_groups({signed[x]: x for x in fps}).items():
        want[node] = least
    got = {r.node: r.component for r in S.fingerprint_groups(spark.createDataFrame([(s,) for s in signed.values()], "fp long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_dedup_keeps_one_of_each_group(documents, texts):
    groups = brute_groups({d: brute_print(t) for d, t in texts.items()})
    kept = S.simhash_dedup(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_odd_rows(odd, empty):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(odd).collect()}
    assert {(d, "0" * 16, 2) for d in (2, 3, 4)} <= got
    kept = S.simhash_dedup(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 5, 2**60 + 1] and sum(r.doc_id is None for r in kept) == 1
    assert S.simhash_groups(empty).count() == 0 and S.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "É É é x", "a\xa0b c d"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("radius", [1, 2])
def test_other_radii(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(62) for _ in range(20)}
    fps |= {f ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for f in fps} | {f ^ (1 << rng.randrange(62)) for f in fps}
    got = {r.node: r.component for r in S.fingerprint_groups(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()}
    near = {f: {g for g in fps if g != f and bin(f ^ g).count("1") <= radius} for f in fps}
    assert {f for f in fps if near[f]} == set(got) and all(got[f] == got[g] for f in fps for g in near[f])


def test_repeated_ids_keep_the_least_text(spark):
    rows = [(1, "b c d e", "x"), (1, "a c d e f", "y"), (1, "a c d e f", "w"), (2, "q r s t u v", "z")]
    kept = S.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a c d e f"), (2, "q r s t u v")]
