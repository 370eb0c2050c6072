import corpus_pipeline as C
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import quality_report
from tidemark.llm.shared import table
from tidemark.llm.simhash_dedup import simhash_dedup

from .test_simhash_dedup import brute_groups, brute_print

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    seen = docs
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, seen, DATA)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
            out = out.cache()
        if k == 0:
            kept = {r.doc_id for r in quality_report(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept and 0 < len(kept) < docs.count()
        if k == 2:
            groups = brute_groups({r.doc_id: brute_print(r.text) for r in seen.collect()})
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))
        if k == 3:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in seen.collect()}
        if k == 4:
            assert out.groupBy().sum("length").first()[0] == pack(seen, with_ids=False).groupBy().sum("length").first()[0]
        seen = out


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0


def test_dedup_is_idempotent(spark):
    once = simhash_dedup(table(spark, "/root/testdata/sf0.001", "documents")).cache()
    assert simhash_dedup(once).count() == once.count()


def test_run_equals_brute_force(spark):
    """All stages by plain loops (but for the trained weights), against the pieces that the pipeline returns."""
    from collections import Counter, namedtuple

    from pyspark.sql import functions as F

    from tidemark.llm import source_mixing as M
    from tidemark.llm.token_ids import default_tokenizer, encode
    from tidemark.llm.toxicity import fit

    from .test_quality_rules import brute_kept
    from .test_source_mixing import brute

    data = "/root/testdata/sf0.001"
    docs = table(spark, data, "documents")
    good = [r for r in docs.collect() if brute_kept(r.text)]
    model = fit(docs.join(spark.createDataFrame([(r.doc_id,) for r in good], "doc_id long"), "doc_id"), table(spark, data, "labels"))
    civil = {r.doc_id: r for r in good if model.score(r.text) < 0.5}
    alone = set(brute_groups({d: brute_print(r.text) for d, r in civil.items()}).values())
    left = docs.where(F.col("doc_id").isin(sorted(alone)))
    ids = {r.doc_id: len(encode(default_tokenizer(), [r.text])[0]) // 4 for r in left.collect()}
    places = left.select("doc_id", "source", F.xxhash64(F.lit(M.SEED), "doc_id").alias("place"), F.pmod(F.xxhash64(F.lit(M.SEED + 1), "doc_id"), F.lit(M.BLOCKS)).alias("block"), *[F.xxhash64(F.lit(M.SEED + 2), F.struct(F.lit(False), F.col("source")), F.lit(n).cast("long"), F.pmod(F.xxhash64(F.lit(M.SEED + 1), "doc_id"), F.lit(M.BLOCKS))).alias(f"turn{n}") for n in range(1, 9)]).collect()
    row, whole = namedtuple("row", "doc_id source n turn block place"), {}
    pieces = C.run(spark, data).collect()
    got = Counter(r.doc_id for r in pieces if r.start == 0)
    for r in places:
        whole[r.source] = min(whole.get(r.source, 99), got[r.doc_id])
    want = brute([row(r.doc_id, r.source, ids[r.doc_id], r[f"turn{whole[r.source] + 1}"], r.block, r.place) for r in places], None, M.TARGET_ENTROPY, M.REPEAT_LIMIT)
    assert got == want and set(got) == alone
    assert sum(r.length for r in pieces) == sum(n * (ids[d] + 1) for d, n in got.items())


def test_stages_with_odd_rows_and_none(spark, odd, empty, large_ids):
    for docs in (odd.unionByName(large_ids, allowMissingColumns=True), empty):
        for k, (name, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            rows = out.collect()
            if k < len(C.STAGES) - 1:
                assert out.columns == docs.columns, name
            if docs is empty:
                assert not rows, name
            elif k > 0:  # quality rules drop short texts
                assert {2**60 + 1, 2**60 + 2, None} <= {r.doc_id for r in rows}, name
