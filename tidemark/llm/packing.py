"""Packing token ids into training windows by minimum bin slack.

Documents are cut into full windows and a rest. Rests are packed by length, of which there are at most a window's
many: the driver sees counts per length only, however large the corpus. It repeatedly takes the longest rest left,
finds by a bitset subset-sum the multiset of other lengths that fills the window closest to capacity, backtracks the
counts, and uses that pattern as often as the counts allow. A pattern is a set of rank intervals per length; each piece
finds its sequence and offset from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, struct, table
from tidemark.llm.token_ids import default_tokenizer, encoded

WINDOW, END_ID = 2048, 1
#: Bytes of ids after which a task hands its pieces on.
BATCH_BYTES = 4 << 20
#: Ids of documents travel as text: beside a null, pandas would turn large ones into floats.
PIECES = "doc_id string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, rank long"


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """The pieces of all documents. ``rank`` counts those of a length within a task's partition ``part``."""

    names = [f.split()[0] for f in PIECES.split(", ")]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        rows, held = [], 0
        for batch in batches:
            for doc, ids in zip(batch["doc_id"], encoded(tokenizer, batch["text"], end_id), strict=True):
                for at in range(0, len(ids), 4 * window):
                    own = ids[at : at + 4 * window]
                    n = len(own) // 4
                    rows.append((doc, at // 4, n, own, zlib.crc32(own), len(ids) // 4, part, seen[n]))
                    seen[n] += 1
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    slim = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(pieces, struct(PIECES)).withColumn("doc_id", F.col("doc_id").cast("long"))


def fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length (``counts`` by length) to take so that their sum is the largest up to ``room``."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, step = min(int(counts[length]), room // length), 1
        while left:
            step = min(step, left)
            layers.append((length, step, reach))
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, step, before in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + step
            total -= step * length
    return used


def plan_patterns(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence, first offset) for all pieces.

    ``lengths`` has the number of pieces by length. A pattern ends when some length runs short, so there are about as
    many patterns as lengths, and none has over sqrt(2 window) lengths: the plan's size is bounded by the window.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    given, plan, sequence = np.zeros(window + 1, dtype=np.int64), [], 0
    while counts.any():
        seed = int(np.flatnonzero(counts)[-1])
        counts[seed] -= 1
        used = fill(counts, window - seed) if seed < window else {}
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(int(counts[length]) // n for length, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            plan.append((length, int(given[length]), int(given[length]) + times * n, sequence, n, offset))
            given[length] += times * n
            counts[length] -= times * n
            offset += n * length
        sequence += times
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unless ``with_ids`` is false), ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like others, row by row; other
    columns are ignored. An empty table gives an empty result. Sequences are not padded in the table: a reader pads
    each to the window.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), window, end_id)
    pieces = staged(pieces if with_ids else pieces.drop("ids"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    lengths = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}  # a row per length at most
    plan = spark.createDataFrame(plan_patterns(lengths, window), "length long, first long, end long, sequence long, per long, at long")
    # a row per length and partition grows with the corpus, so it is never broadcast
    ranked = pieces.join(bases.drop("n").hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).drop(plan["length"])
    nth = F.col("rank") - F.col("first")
    columns = ["doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens"]
    return placed.select(*columns, (F.col("sequence") + F.expr("(rank - first) div per")).alias("sequence_id"), (F.col("at") + nth % F.col("per") * F.col("length")).alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
