import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence_audit as D


def brute(rows, least_docs, top_terms=50):
    """Plain Python over (lang, source, text) rows, all sums over all kept terms."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top_terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least_docs", [1, 3, 10_000])
def test_equals_brute_force(documents, least_docs):
    rows = [(r.lang, r.source, r.text) for r in documents.collect()]
    assert got(D.divergence_audit(documents, least_docs=least_docs)) == brute(rows, least_docs)


def test_many_small_blocks(spark, documents, monkeypatch):
    """A block spilled after every few documents, pairs handed on at once: the same rows."""
    monkeypatch.setattr(D, "BLOCK", 50)
    docs = documents.limit(40)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert got(D.divergence_audit(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=2)) == brute(rows, 2)


def test_runs_merge_in_several_passes():
    rows = [("en", f"s{i % 3}", f"b{i % 7} a{i % 5} a{i % 5} ü") for i in range(200)]
    runs = list(D.inverted(rows, 1, most=5))
    once, often = D.Shard(), D.Shard(most=1)
    for _, groups, postings in runs:
        once.add(groups, postings)
        often.add(groups, postings)
    assert len(runs) > 20 and len(often.runs) < 4
    assert sorted(once.frequencies(1), key=str) == sorted(often.frequencies(1), key=str)
    assert {t: n for _, s, t, n in once.frequencies(1) if s == "s0"}["ü"] == 67
    assert [t for t, _ in once.merged()] == sorted(t for t, _ in once.merged())


def test_runs_are_sorted_and_sharded():
    runs = [(s, g, D.unpacked(p)) for s, g, p in D.inverted([("a", None, "z y x z"), (None, "b", "x ß Y")], 4)]
    assert all(words == sorted(words) for _, _, (words, *_) in runs)
    assert all(D.zlib.crc32(w) % 4 == s for s, _, (words, *_) in runs for w in words)
    assert {g for _, groups, _ in runs for g in groups} == {("a", ""), ("", "b")}


def test_odd_rows(odd, empty):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert got(D.divergence_audit(odd, least_docs=1)) == brute(rows, 1)
    assert D.divergence_audit(empty).count() == 0


def test_ties_and_groups_without_terms(spark):
    rows = [("en", "a", "x y"), ("en", "b", "x y"), ("en", "c", None), ("en", "d", ""), ("en", "d", "x y"), ("en", "é", "12 - 3"), ("xx", "only", "word"), ("yy", "a", None), ("yy", "b", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(D.divergence_audit(df, least_docs=1)) == brute(rows, 1)
    assert got(D.divergence_audit(df, least_docs=9)) == brute(rows, 9)


def test_shares_beyond_64_bits(spark):
    n = 10**13
    row = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(3 * n), D.F.lit(7).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (3 * n + 35)
