import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import pytest

from tidemark.llm import importance_resampling as R
from tidemark.llm.shared import table

from .conftest import DATA


def brute(docs, target, longest=1, least_words=20, percent=10, buckets=10_000, seed=2024):
    """Plain Python over lists of (doc_id, text) and of texts: (doc_id, n_features, weight, score, rank)."""

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    gain = {b: floor(1000 * log(float(t[b] + 1) * float(sum(s.values()) + buckets) / (float(s[b] + 1) * float(sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    wanted = percent * len(may) // 100
    out = [(*r[:4], k + 1 if k < wanted else None) for k, r in enumerate(may)]
    return out + [(*r[:4], None) for r in rows if r[4] < least_words]


def same(df, expected):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 100), (2, 37), (1, 0)])
def test_equals_brute_force(spark, texts, documents, longest, percent):
    target = table(spark, DATA, "benchmark")
    got = R.resample(documents, target, longest=longest, percent=percent)
    same(got, brute(list(texts.items()), [r.text for r in target.collect()], longest, percent=percent))


def test_ties_at_the_cutoff(spark, monkeypatch):
    """Scores all alike: the least ids are drawn, null before them; alike rows share a cutoff id and only some are drawn."""
    text = "same words " * 10
    rows = [(None, text), *[(i, text) for i in (-5, 3, 3, 3, 2**60 + 1, 7, 8, 9, 10)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", R.F.lit("clash"))
    scored = R.score_documents
    monkeypatch.setattr(R, "score_documents", lambda *a: scored(*a).withColumn("score", R.F.lit(5).cast("long")))
    for percent, ids in ((10, [None]), (20, [None, -5]), (30, [None, -5, 3]), (40, [None, -5, 3, 3]), (90, [None, -5, 3, 3, 3, 7, 8, 9, 10])):
        got = R.resample(docs, docs, percent=percent).where("rank is not null").orderBy("rank").collect()
        assert [r.doc_id for r in got] == ids and [r["rank"] for r in got] == [*range(1, len(ids) + 1)]


def test_section_is_the_least():
    for values in ([0], [5, 5, 5], [-9, 0, 1, 100], list(range(0, 5000, 7))):
        counts = lambda xs, v=values: [sum(y <= x for y in v) for x in xs]
        for wanted in range(1, min(len(values), 40) + 1):
            assert R.section(min(values), max(values), wanted, counts) == sorted(values)[wanted - 1]


def test_odd_rows(odd, empty):
    got = R.resample(odd, odd, least_words=0, percent=50)
    same(got, brute([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in odd.collect()], least_words=0, percent=50))
    assert R.resample(empty, odd).count() == 0 and R.resample(odd, empty).count() == odd.count()


def test_features_take_lower_case_of_ascii_only():
    assert R.words("ÄB c9-D_e\x00f ß") == ["Äb".encode(), b"c9", b"d", b"e", b"f", "ß".encode()] and R.words(None) == []
