import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np

from tidemark.llm import packing as P
from tidemark.llm.token_ids import default_tokenizer, encode


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def check(rows, want):
    """Pieces cover each row's ids once; sequences are gapless and fit the window. ``want``: id lists by doc."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.WINDOW
    for doc, lists in want.items():
        crcs = sorted((s, zlib.crc32(np.array(ids[s : s + P.WINDOW], "<u4").tobytes()), len(ids)) for ids in lists for s in range(0, len(ids), P.WINDOW))
        assert sorted((r.start, r.ids_crc32, r.doc_tokens) for r in pieces[doc]) == crcs
    return sequences


def test_pieces_match_the_library(documents, texts):
    rows = P.pack(documents, with_ids=False).collect()
    want = {d: [[*library_ids(t), P.END_ID]] for d, t in texts.items()}
    sequences = check(rows, want)
    padding = sum(P.WINDOW - sum(n for _, n in s) for s in sequences.values())
    assert padding < 0.01 * sum(len(i[0]) for i in want.values()) + P.WINDOW


def test_ids_are_kept(documents):
    for r in P.pack(documents.limit(20)).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_fill_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = np.zeros(41, dtype=int)
        for length in rng.integers(1, 30, 4):
            counts[length] = rng.integers(1, 4)
        lengths = np.flatnonzero(counts)
        best = max(s for c in product(*[range(counts[n] + 1) for n in lengths]) if (s := int(np.dot(c, lengths))) <= 40)
        used = P.fill(counts, 40)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_plan_covers_every_rank():
    lengths = {3: 1_000_000, 7: 5, 500: 2000, 1500: 999, 2048: 4}
    seen = defaultdict(int)
    for length, first, end, *_ in P.plan_patterns(lengths, 2048):
        assert first == seen[length]
        seen[length] = end
    assert seen == lengths


def test_odd_rows(odd, empty):
    rows = P.pack(odd, with_ids=False).collect()
    want = defaultdict(list)
    for r in odd.collect():
        want[r.doc_id].append([*library_ids(r.text), P.END_ID])
    check(rows, want)
    assert P.pack(empty).count() == 0


def test_encoder_agrees_with_the_library_on_spaces_and_added_tokens():
    rng = np.random.default_rng(3)
    parts = ["a", "Zb", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "'s", "9", "²", "é", "中", "😀", "-.", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(2000)]
    for text, ids in zip(texts, encode(default_tokenizer(), texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text), repr(text)


def test_large_ids_beside_nulls(large_ids):
    rows = P.pack(large_ids, with_ids=False).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "None", str(2**60 + 1), str(2**60 + 2)])
    want = defaultdict(list)
    for r in large_ids.collect():
        want[r.doc_id].append([*library_ids(r.text), P.END_ID])
    check(rows, want)


def test_long_texts_are_handed_on_in_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_BYTES", 1000)
    docs = spark.createDataFrame([(i, "some words " * (i * 300)) for i in range(9)], "doc_id long, text string").coalesce(1)
    check(P.pack(docs, with_ids=False).collect(), {i: [[*library_ids("some words " * (i * 300)), P.END_ID]] for i in range(9)})


def test_bases_are_merged_not_broadcast(documents):
    plan = P.pack(documents, with_ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_other_tokenizers_are_left_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["Some Words, don't  split\n here", "日本 語", "", "a" * 50]
    assert [np.frombuffer(i, "<u4").tolist() for i in encode(path, texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
