import hashlib

import numpy as np
import pytest

from tidemark.llm import minhash as M
from tidemark.llm.shared import least_roots


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w[: i + 1]) for i in range(len(w))}


def brute(rows):
    """The contract's rows in plain Python; fingerprints by the text alone."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, M.xxhash.xxh64_intdigest((r[1] or "").encode())))
    out, prints = [], [M.fingerprint(t) for _, t in rows]
    like = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / M.PERMUTATIONS
    for k, (i, text) in enumerate(rows):
        nxt = (k + 1) % len(rows)
        text, after = text or "", rows[nxt][1] or ""
        gone = len(text) // 4
        edited = text[: len(text) - gone] + after[:gone]
        e = M.fingerprint(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[k], e, like(prints[k], e), like(prints[k], prints[nxt])))
    return out


def same(df, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(brute(rows), key=key)


def test_equals_brute_force(documents, texts):
    same(M.fingerprint_documents(documents.repartition(5)), list(texts.items()))


def test_odd_rows(odd, empty, large_ids):
    same(M.fingerprint_documents(odd), [(r.doc_id, r.text) for r in odd.collect()])
    same(M.fingerprint_documents(large_ids), [(r.doc_id, r.text) for r in large_ids.collect()])
    assert M.fingerprint_documents(empty).count() == 0 and M.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rows", [[(7, "one text alone of six words")], [(None, None), (None, "a b")], [(3, "x"), (3, "y"), (3, "x"), (-9, "é" * 9)]])
def test_few_rows(spark, rows):
    same(M.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_both_minima_equal_those_of_each_text(texts):
    every = list(texts.values())
    for a, b in zip([*every[:60], "", "a b", "one two three four five six sevén", " x" * 30, "ab" * 40], [*every[1:61], "zz", "", "q r s", "wordwordword", "c d e"], strict=True):
        edited = M.edited_text(a, b)
        own, other = M.both_minima(a, edited)
        for got, text in ((own, a), (other, edited)):
            assert np.array_equal(got, M.minima(M.shingles(M.word_hashes(text.encode()))))


def test_likeness_estimates_jaccard(texts):
    """An error of five standard deviations would be 0.22; the edited texts are near, other texts are not."""
    errors, every = [], [t for t in texts.values() if len(words(t)) > 40]
    for a, b in zip(every[:-1], every[1:], strict=True):
        e = M.edited_text(a, b)
        x, y = shingle_set(a), shingle_set(e)
        near = M.likeness(*map(M.numbers, M.both_minima(a, e)))
        errors.append(near - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.22 and abs(np.mean(errors)) < 0.01
    assert M.fingerprint("A b\tc") == M.fingerprint("a B c ") != M.fingerprint("b a c")


def classes(rows):
    """component_id per row by all pairs of shingle sets."""
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    a, b = np.array(links or [(0, 0)]).T
    root = least_roots(len(rows), a, b)
    name = {}
    for r, (i, _) in zip(root, rows, strict=True):
        name[r] = min([x for x in (name.get(r), i) if x is not None], default=None)
    return sorted(((i, name[r]) for r, (i, _) in zip(root, rows, strict=True)), key=str)


def test_near_duplicates_equal_all_pairs(documents, texts):
    assert sorted(map(tuple, M.near_duplicates(documents).collect()), key=str) == classes(list(texts.items()))


def test_a_chain_whose_ends_differ(spark):
    """Each text is near the next only: links between texts that are not the least of a bucket are found."""
    base = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join([*base[: 400 - 12 * k], *[f"x{k}y{i}" for i in range(12 * k)]])) for k in range(12)]
    rows += [(200 + k, " ".join([*base[:200], *[f"z{k}y{i}" for i in range(200)]])) for k in range(60)]  # share half, no link
    rows += [(None, " ".join(base)), (5, None), (6, ""), (7, "W0 w1"), (8, "w0\tw1"), (8, "w0 w1"), (9, "w1 w0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicates(df).collect()), key=str) == classes(rows)


def test_odd_rows_have_classes(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, M.near_duplicates(odd).collect()), key=str) == classes(rows)


def test_rows_without_a_near_fingerprint_fetch_no_shingles():
    """Of a unit of 3 near texts and 300 that only share a band, only the near ones go on, whatever the batches."""
    base = [f"w{i}" for i in range(400)]
    near = [" ".join([*base[: 400 - 4 * k], *[f"x{k}y{i}" for i in range(4 * k)]]) for k in range(3)]
    far = [" ".join(f"z{k}y{i}" for i in range(60)) for k in range(300)]
    rows = [(0, 7, 0, 0, 0, t.encode(), t.encode(), bytes.fromhex(M.fingerprint(t))) for t in [*far[:150], *near, *far[150:]]]
    frame = M.pd.DataFrame(rows, columns=[f.split()[0] for f in M.UNIT_ROWS.split(", ")])
    for size in (1_000, 40):
        parts = (frame[i : i + size] for i in range(0, len(frame), size))
        got = [k for some in M._with_partners(parts) for k in some["key"]]
        assert sorted(got) == sorted(t.encode() for t in near)
