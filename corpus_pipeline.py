"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage reads what its predecessor wrote. Stages one to four return documents with the columns they came with; the
last returns packed pieces. Whatever the stage: null ids stay null and are told apart by nothing but their rows, columns
other than id, text and source are carried along under any name, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import quality_filter
from tidemark.llm.shared import drop_path, new_path, table
from tidemark.llm.simhash_dedup import simhash_dedup
from tidemark.llm.source_mixing import mix
from tidemark.llm.toxicity import fit, toxicity_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the word and repetition rules or the compression bands; so null and empty texts go.

    Each row is judged on its own, repeated ones alike, texts of any length whole.
    """
    return quality_filter(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic by a model fitted to the labelled ones among ``docs``.

    Rows without an id teach nothing but are scored; a null or empty text scores as the model's bias; repeated rows are
    scored alike. Without labels of both classes nothing is known and all or none is toxic, as the labels say.
    """
    return toxicity_filter(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies.

    Null and empty texts are copies of each other. Where an id is repeated one of its rows stays; rows without an id
    cannot be named and all stay.
    """
    return simhash_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated to meet the target entropy or repetition limit.

    They are written in the order of passes, blocks and places, which packing then follows. A null source is a source of
    its own; rows without tokens come once a whole pass.
    """
    return mix(docs, plan_columns=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in training windows; a null or empty text is its end id alone."""
    return pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of compression, learned scores, XXH64 or byte-pair encoding; the tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all stages over ``documents``; each stage's rows are written to the shared folder and read again.

    What a stage wrote is deleted once its successor's rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_path(spark, "stage-" + name.split()[0])
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
