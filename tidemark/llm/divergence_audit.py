"""How far the sources of a language differ in their words, by single-pass in-memory indexing.

One pass over the texts builds postings (term, group, occurrences, documents) in a block in memory, a group being a pair
of language and source. When the block is full its postings are sorted by term, cut into hash shards and spilled as one
run a shard to the shuffle; each shard's runs are heap-merged to frequencies, several times over where they outgrow the
memory for it (Heinz and Zobel's single-pass indexing). A run holds a term once a group however often it occurs, so
frequent terms and large sources are summed up before anything moves.

Shares are integers in billionths. The distance of two sources is a sum over all kept terms of their language; most
terms occur in few sources, so it is taken apart: what it would be if no term occurred, a change for each source alone
(from its histogram of shares), and a correction for each term that both have. The corrections are streamed by term and
added up per pair in the task before they are shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import cut, staged, struct, table, whole_groups

#: Documents of a language that a kept term needs; terms listed for a group.
LEAST_DOCS, TOP_TERMS = 30, 50
#: Shares are in units of 1 / SCALE, smoothed by PRIOR occurrences of each kept term.
SCALE, PRIOR = 1_000_000_000, 5
#: Postings of a block (some 150 MB); packed bytes of runs that a merge holds before it makes one run of them.
BLOCK, MERGE_BYTES = 500_000, 16 << 20
#: Pairs of sources whose corrections a task holds before it hands them on.
PAIRS = 200_000
#: Terms are runs of ASCII letters and of all that is not ASCII; A-Z count as a-z, the rest of ASCII parts them.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUN = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("groups", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]))),
    T.StructField("postings", T.BinaryType()),
])
GROUPS = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TERM_BYTES).split()


def packed(words: list[bytes], at: np.ndarray, n: np.ndarray, docs: np.ndarray) -> bytes:
    """A run: its terms in order, parted by zero bytes, after three columns of numbers."""
    head = np.array([len(words)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + at.astype("<i4").tobytes() + n.astype("<i8").tobytes() + docs.astype("<i8").tobytes() + b"\x00".join(words))


def unpacked(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    return raw[8 + 20 * k :].split(b"\x00") if k else [], np.frombuffer(raw, "<i4", k, 8), np.frombuffer(raw, "<i8", k, 8 + 4 * k), np.frombuffer(raw, "<i8", k, 8 + 12 * k)


def spilled(block: dict[tuple[str, str], tuple[Counter, Counter]], shards: int) -> Iterator[tuple[int, list, bytes]]:
    """The block's term-sorted runs, one a shard, and a last one without postings that names all its groups."""
    groups = list(block)
    words = [w for counts, _ in block.values() for w in counts]
    n = np.fromiter((x for counts, _ in block.values() for x in counts.values()), dtype=np.int64, count=len(words))
    docs = np.fromiter((among[w] for counts, among in block.values() for w in counts), dtype=np.int64, count=len(words))
    at = np.repeat(np.arange(len(groups)), [len(counts) for counts, _ in block.values()])
    shard = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % shards
    column = pa.array(words, pa.large_binary())
    order = pc.sort_indices(pa.table({"shard": shard, "term": column}), [("shard", "ascending"), ("term", "ascending")]).to_numpy()
    words, n, docs, at, shard = column.take(pa.array(order)).to_pylist(), n[order], docs[order], at[order], shard[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for i, j in zip(edges[:-1], edges[1:], strict=True) if len(words) else ():
        own, codes = np.unique(at[i:j], return_inverse=True)
        yield int(shard[i]), [groups[g] for g in own], packed(words[i:j], codes, n[i:j], docs[i:j])
    yield zlib.crc32(repr(groups[:1]).encode()) % shards, groups, packed([], at[:0], n[:0], docs[:0])


def inverted(rows: Iterable[tuple[str | None, str | None, str | None]], shards: int, most: int = BLOCK) -> Iterator[tuple[int, list, bytes]]:
    """Runs of (lang, source, text) rows; a block is spilled once it holds ``most`` postings."""
    block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for lang, source, text in rows:
        counts, among = block.setdefault((lang or "", source or ""), (Counter(), Counter()))
        found, before = terms(text), len(counts)
        counts.update(found)
        among.update(set(found))
        held += len(counts) - before
        if held >= most:
            yield from spilled(block, shards)
            block, held = {}, 0
    if block:
        yield from spilled(block, shards)


def _invert(shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, groups, postings in inverted(rows, shards, most):
            named = pa.array([[{"lang": a, "source": b} for a, b in groups]], GROUPS)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), named, pa.array([postings], pa.binary())], names=RUN.names)

    return run


class Shard:
    """The runs of one shard, as they come in; each is term-sorted."""

    def __init__(self, most: int = MERGE_BYTES):
        self.numbers: dict[tuple[str, str], int] = {}
        self.runs: list[tuple] = []
        self.held, self.most = 0, most

    def add(self, groups: list[tuple[str, str]], postings: bytes) -> None:
        own = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in groups], dtype=np.int64)
        self.runs.append((own, postings))
        self.held += len(postings)
        if self.held > self.most and len(self.runs) > 1:
            words, at, n, docs = [], [], [], []
            for term, sums in self.merged():
                words += [term] * len(sums)
                at += sums
                n += [x for x, _ in sums.values()]
                docs += [x for _, x in sums.values()]
            one = packed(words, np.array(at, dtype=np.int64), np.array(n, dtype=np.int64), np.array(docs, dtype=np.int64))
            self.runs, self.held = [(np.arange(len(self.numbers)), one)], len(one)
            self.most = max(self.most, 2 * self.held)

    def merged(self) -> Iterator[tuple[bytes, dict[int, tuple[int, int]]]]:
        """Each term once, in order, with its (occurrences, documents) by group number."""

        def stream(own: np.ndarray, postings: bytes):
            words, at, n, docs = unpacked(postings)
            return zip(words, own[at].tolist() if len(at) else [], n.tolist(), docs.tolist(), strict=True)

        for term, postings in groupby(heapq.merge(*[stream(*r) for r in self.runs]), key=itemgetter(0)):
            sums: dict[int, tuple[int, int]] = {}
            for _, g, n, d in postings:
                a, b = sums.get(g, (0, 0))
                sums[g] = a + n, b + d
            yield term, sums

    def frequencies(self, least_docs: int) -> Iterator[tuple[str, str, str | None, int]]:
        """Rows (lang, source, term, n) of the terms in enough documents of a language; a null term names a group."""
        groups = list(self.numbers)
        yield from ((lang, source, None, 0) for lang, source in groups)
        for term, sums in self.merged():
            among: Counter = Counter()
            for g, (_, d) in sums.items():
                among[groups[g][0]] += d
            for g, (n, _) in sums.items():
                if among[groups[g][0]] >= least_docs:
                    yield *groups[g], term.decode("utf-8"), n


def _merge(least_docs: int):
    columns = ["lang", "source", "term", "n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, last = Shard(), None
        for batch in batches:
            for number, groups, postings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != last:
                    yield from shard.frequencies(least_docs)
                    shard, last = Shard(), number
                shard.add([(g["lang"], g["source"]) for g in groups], postings)
        yield from shard.frequencies(least_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for r in rows(batches):
            kept.append(r)
            if len(kept) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in kept], pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())]))
                kept = []
        yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in kept], pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())]))

    return run


def term_frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, term, n) of kept terms that occur in the group, and a row with a null term for each group and shard."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.col(c).cast("string").alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    runs = rows.mapInArrow(_invert(shards, BLOCK), RUN)
    return runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merge(least_docs), struct("lang string, source string, term string, n long"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exact; null where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, low = (wide(n) + F.lit(PRIOR)) * F.lit(SCALE), wide(total) + wide(kept) * F.lit(PRIOR)
    return F.when(kept > 0, (top - F.pmod(top, low)) / low + 1).cast("long")


def _corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pair of groups of a language the sum over terms in both of what the parts by source get wrong."""
    numbers: dict[tuple[str, str], int] = {}
    sums: dict[tuple[int, int], int] = {}

    def flushed() -> pd.DataFrame:
        names = list(numbers)
        rows = [(names[a][0], names[a][1], names[b][1], x) for (a, b), x in sums.items()]
        return pd.DataFrame(rows, columns=["lang", "source", "item", "both"])

    for rows in whole_groups(batches, ["lang", "term"]):
        at = np.array([numbers.setdefault(g, len(numbers)) for g in zip(rows["lang"], rows["source"], strict=True)], dtype=np.int64)
        p, none = rows["p"].to_numpy(dtype=np.int64), rows["p_none"].to_numpy(dtype=np.int64)
        new = ((rows["term"] != rows["term"].shift()) | (rows["lang"] != rows["lang"].shift())).to_numpy()
        term = np.cumsum(new)
        for d in range(1, len(rows)):
            i = np.flatnonzero(term[d:] == term[:-d])
            if not len(i):
                break
            j = i + d
            x = abs(p[i] - p[j]) - abs(p[i] - none[j]) - abs(none[i] - p[j]) + abs(none[i] - none[j])
            pairs, where = np.unique(np.stack([at[i], at[j]]), axis=1, return_inverse=True)
            total = np.zeros(pairs.shape[1], dtype=np.int64)
            np.add.at(total, where.ravel(), x)
            for a, b, t in zip(*pairs.tolist(), total.tolist(), strict=True):
                sums[a, b] = sums.get((a, b), 0) + t
        if len(sums) >= PAIRS:
            yield flushed()
            sums = {}
    yield flushed()


def divergence_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value (long), rank (int) for every group (lang, source) of ``docs``.

    Part ``pair``: each other source of the language with the sum of the differences of shares over all kept terms. Part
    ``term``: the ``top_terms`` terms of the group whose share is above the language's by most. Ranks go by falling value,
    then by item.

    Null language, source or text count as ''. A group whose texts are all empty has pairs and no terms; a language
    without kept terms has pairs of value 0; a source alone in its language has none. Repeated rows count each time. Other
    columns are ignored, ids too. An empty table gives an empty result. Texts of any length are read whole. Jobs run
    while the result is being put together.
    """
    found = staged(term_frequencies(docs, least_docs, lang_col, source_col, text_col), "divergence-frequencies")
    kept = found.where(F.col("term").isNotNull())
    of_lang = cut(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    groups = cut(groups.withColumn("p_none", share(F.lit(0), F.col("total"), F.col("kept"))))
    shares = staged(kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))), "divergence-shares")

    # pairs: no term in either; each source's terms against the other's share of none; terms in both
    other = groups.select("lang", F.col("source").alias("item"), F.col("p_none").alias("item_none"))
    levels = shares.groupBy("lang", "source", "p_none", "p").agg(F.count(F.lit(1)).alias("times"))
    change = F.sum(F.col("times") * (F.abs(F.col("p") - F.col("item_none")) - F.abs(F.col("p_none") - F.col("item_none"))))
    alone = levels.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(change.alias("change"))
    by_term = shares.select("lang", "term", "source", "p", "p_none").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = by_term.mapInPandas(_corrections, struct("lang string, source string, item string, both long"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), df[df.columns[-1]].alias("change"))
    parts = alone.union(turned(alone)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    pairs = groups.join(other, "lang").where("source <> item").join(parts, ["lang", "source", "item"], "left")
    value = F.coalesce(F.col("kept") * F.abs(F.col("p_none") - F.col("item_none")), F.lit(0)) + F.coalesce("change", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    above = shares.join(of_lang, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).union(above.withColumn("rank", rank).where(F.col("rank") <= top_terms))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


def oracle_sql(least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> str:
    p = f"(1 + ({SCALE}::HUGEINT * (%s + {PRIOR})) // (%s + {PRIOR} * kept))::BIGINT"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tokens AS (SELECT id, lang, source, unnest(ws) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= {least_docs}),
langs AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM vocabulary GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN vocabulary USING (lang, term) GROUP BY ALL),
totals AS (
  SELECT lang, source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {p % ("coalesce(n, 0)", "total")} AS p, {p % ("lang_n", "lang_total")} AS q
  FROM totals JOIN langs USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= {top_terms}"""
