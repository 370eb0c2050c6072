"""Resampling towards a target distribution by importance weights over hashed word features.

Two feature distributions are counted over all rows, one of the raw documents and one of the target texts, each a table
of at most ``buckets`` sums. The log ratio of the two per bucket, in thousandths, is an array of that fixed size; a
document's weight is the mean gain of its features, looked up as an array, and its score adds Gumbel noise drawn from
its id (Xie et al., 2023). The best share of the long enough documents is drawn: scores are written once to the shared
folder, the cutoff score and, among its ties, the cutoff id are found by bisection, every step an exact count job over
that table, and the drawn rows alone are sorted by range to number them. Nothing is sorted whole or sent to the driver
but counts, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import staged, struct, table

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words are never drawn; of the others this share is.
LEAST_WORDS, PERCENT = 20, 10
#: Thresholds judged by one count job.
SECTIONS = 16
#: Distinct words whose bucket a worker keeps.
KEPT = 400_000
#: Words are runs of ASCII letters and digits and of all that is not ASCII; A-Z count as a-z, the rest of ASCII parts them.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORD_BYTES).split()


class Buckets(dict):
    """The bucket of each word, worked out when first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % self.buckets
        return bucket


@lru_cache(maxsize=2)
def _known(buckets: int) -> Buckets:
    """A worker's own, kept from batch to batch."""
    return Buckets(buckets)


def feature_buckets(text: str | None, known: Buckets, longest: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``longest`` words of a whole text, repeats included."""
    w = words(text)
    found = list(map(known.__getitem__, w))
    for n in range(2, longest + 1):
        found += [zlib.crc32(b" ".join(w[i : i + n])) % known.buckets for i in range(len(w) - n + 1)]
    return len(w), np.array(found, dtype=np.int64)


def feature_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts: an array of ``buckets`` sums, added up in the tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = _known(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(feature_buckets(text, known, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    parts = rows.select(F.col(text_col).alias("text")).mapInPandas(count, struct("bucket long, n long"))
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    total = np.zeros(buckets, dtype=np.int64)
    for r in sums:
        total[r.bucket] = r.n
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored thousandfold log ratio of the smoothed target share to the smoothed raw share."""
    k, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([floor(1000 * log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def score_documents(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight and score (all long)."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]))
    def weigh(texts: pd.Series) -> pd.DataFrame:
        known, out = _known(len(gain)), np.zeros((len(texts), 3), dtype=np.int64)
        for i, text in enumerate(texts):
            n, found = feature_buckets(text, known, longest)
            out[i] = n, len(found), int(gain[found].sum()) // len(found) if len(found) else 0
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    weighed = docs.select(F.col(id_col).cast("long").alias("doc_id"), weigh(F.col(text_col)).alias("w"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.select("doc_id", "w.*", (F.col("w.weight") + noise).alias("score"))


def section(low: int, high: int, wanted: int, counts: Callable[[list[int]], list[int]]) -> int:
    """The least x in [low, high] with count(x) >= wanted, for a count that rises with x and reaches it at ``high``.

    Each step asks for the counts of up to ``SECTIONS`` - 1 thresholds at once.
    """
    while low < high:
        inner = sorted({low + (high - low) * k // SECTIONS for k in range(SECTIONS)})
        reached = [x for x, n in zip(inner, counts(inner), strict=True) if n >= wanted]
        if reached:
            high = reached[0]
            low = max([x + 1 for x in inner if x < high], default=low)
        else:
            low = inner[-1] + 1
    return high


def cutoff(scored: DataFrame, wanted: int) -> tuple[int, int | None] | None:
    """The score and id of the last row drawn if ``wanted`` rows of highest score, then of least id, are.

    A null id stands before all others. None if nothing is wanted.
    """
    if wanted <= 0:
        return None

    def counts_of(rows: DataFrame, holds: Callable[[int], Column]) -> Callable[[list[int]], list[int]]:
        return lambda xs: list(rows.agg(*[F.count(F.when(holds(x), 1)).alias(str(i)) for i, x in enumerate(xs)]).first())

    least, most = scored.agg(F.min("score"), F.max("score")).first()
    score = -section(-most, -least, wanted, counts_of(scored, lambda x: F.col("score") >= -x))
    tied = scored.where(F.col("score") == score)
    above, nulls = scored.agg(F.count(F.when(F.col("score") > score, 1)), F.count(F.when((F.col("score") == score) & F.col("doc_id").isNull(), 1))).first()
    if above + nulls >= wanted:
        return score, None
    first, last = tied.agg(F.min("doc_id"), F.max("doc_id")).first()
    return score, section(first, last, wanted - above - nulls, counts_of(tied, lambda x: F.col("doc_id") <= x))


def ranked(drawn: DataFrame, wanted: int) -> DataFrame:
    """Adds ``rank`` by falling score, rising id: rows are sorted by range and numbered from the counts of the ranges.

    Rows past ``wanted`` (rows that are alike in all columns share the cutoff) get none.
    """
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = staged(drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-drawn")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per partition
    starts, before = [], 0
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    offset = drawn.sparkSession.createDataFrame(starts or [(0, 0)], "part long, before long")
    numbered = placed.withColumn("part", part).join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + at + 1)
    return numbered.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*drawn.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (from 1; null if not drawn).

    floor(``percent`` * N / 100) of the N rows of at least ``least_words`` words are drawn. A null or empty text has no
    features and weight 0. A null id gets the noise of the empty id and comes before others of its score. Repeated ids
    get the same noise; rows of equal score and id rank by n_features and weight, and rows alike in these too are
    interchangeable. Other columns are ignored. An empty target weighs every bucket by the raw shares alone; an empty
    table gives an empty result. Jobs run while the result is being put together.
    """
    gain = gains(feature_counts(docs, text_col, buckets, longest), feature_counts(target, target_text_col, buckets, longest))
    scored = staged(score_documents(docs, gain, id_col, text_col, longest, seed), "resample-scores")
    may = scored.where(F.col("n_words") >= least_words)
    wanted = percent * may.count() // 100
    last = cutoff(may, wanted)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, doc_id = last
    tied = F.col("doc_id").isNull() if doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") <= doc_id)
    is_drawn = (F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & tied))
    rest = scored.where(~is_drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(is_drawn).select(*columns), wanted).union(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """The query for single words in SQL; crc32 is folded over the bytes of each distinct word."""
    tokens = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE table_steps(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT b, {step}, k + 1 FROM table_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM table_steps WHERE k = 8),
doc_words AS (SELECT doc_id, {tokens} AS ws FROM documents),
doc_tokens AS (SELECT doc_id, unnest(ws) AS w FROM doc_words),
target_tokens AS (SELECT unnest({tokens}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM doc_tokens UNION SELECT w FROM target_tokens)),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS n FROM doc_tokens JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_tokens JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT h.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM doc_tokens JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM doc_words d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {least_words}) AS of FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= {least_words} AND place <= {percent} * of // 100 THEN place END AS rank FROM placed"""
