"""Token-id files: each document's ids compressed on their own with one shared zstandard dictionary.

Short documents compress badly alone; a dictionary trained on the serialized ids of a bounded sample fixes that and
keeps every document readable without its neighbours. A container is a folder with two Parquet tables: ``dictionary``
(its bytes and their SHA-256) and ``blocks``, in ascending doc_id order. A block holds the frames of up to
``BLOCK_BYTES`` of documents back to back with their ids, token counts and frame offsets, the hash of the dictionary,
and how many ids come before it in its shard. Reading one document takes one block (Parquet statistics on first_id and
last_id find it) and one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import new_path, struct, table
from tidemark.llm.token_ids import default_tokenizer, encoded, vocabulary_size

END_ID, LEVEL = 2, 3
BLOCK_BYTES = 1 << 20
#: Bytes of text in a shard, the part of a container that one task writes.
SHARD_BYTES = 64 << 20
#: The dictionary's size, and the bound of its training sample: documents (those of least id hash) and bytes of each.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 64 << 10, 800, 16 << 10
BLOCKS = "shard int, block int, first_id long, last_id long, doc_ids array<long>, counts array<long>, offsets array<long>, tokens_before long, n_tokens long, width int, dict_hash string, payload binary"


def serialize(ids: bytes, width: int) -> bytes:
    """Ids of 4 bytes as ids of ``width`` bytes."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def deserialize(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from the sample's serialized ids; of too small a sample, the sample itself; empty for no rows."""
    order = F.xxhash64("doc_id")
    chosen = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(SAMPLE_DOCS)

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": [serialize(c, width)[:SAMPLE_BYTES] for c in encoded(tokenizer, batch["text"], end_id)]})

    few = docs.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    samples = [bytes(r[0]) for r in few.mapInPandas(ids, struct("ids binary")).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return raw if len(raw) >= 8 else b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_container(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents to ``path``, null ids first, then by ascending id; equal ids in input order.

    A null or empty text is the end id alone. Ids are kept in two bytes if the tokenizer has no larger ones, else in four.
    Other columns are ignored; an empty table gives a container without blocks. The texts are dealt to as many shards as
    their bytes ask for.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        before, number, held = 0, 0, []

        def block() -> pd.DataFrame:
            nonlocal before, number
            ids = [h[0] for h in held]
            known = [i for i in ids if i is not None]
            counts, frames = [h[1] for h in held], [h[2] for h in held]
            row = (shard, number, min(known, default=None), max(known, default=None), ids, counts, [0, *np.cumsum([len(f) for f in frames]).tolist()], before, sum(counts), width, digest, b"".join(frames))
            before, number = before + sum(counts), number + 1
            held.clear()
            out = pd.DataFrame([row], columns=[f.split()[0] for f in BLOCKS.split(", ")])
            return out.astype({"first_id": "Int64", "last_id": "Int64"})

        size = 0
        for batch in batches:
            for doc, ids in zip(batch["doc_id"], encoded(tokenizer, batch["text"], end_id), strict=True):
                frame = packer.compress(serialize(ids, width))
                held.append((None if doc is None else int(doc), len(ids) // 4, frame))
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield block()
                    size = 0
        if held:
            yield block()

    # documents are dealt and sorted as texts, so that they are tokenized once, after the shuffle; their ids go to Python
    # as text, as pandas would turn large ones beside a null into floats
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    rows = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows.mapInPandas(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row[1])).hexdigest() != row[0]:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    return row[0], bytes(row[1])


def read_container(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a container: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (4 bytes each)."""
    digest, dictionary = _dictionary(spark, path)
    stored = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    stored = stored.join(F.broadcast(bases), "shard").select(F.col("doc_ids").cast("array<string>").alias("doc_ids"), "counts", "offsets", "width", "dict_hash", "payload", (F.col("base") + F.col("tokens_before")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = zstandard.ZstdDecompressor(**_codec(dictionary))
        for batch in batches:
            for b in batch.itertuples():
                if b.dict_hash != digest:
                    raise ValueError(f"a block needs dictionary {b.dict_hash}, the container has {digest}")
                texts = [deserialize(opener.decompress(b.payload[s:e]), b.width) for s, e in zip(b.offsets, b.offsets[1:], strict=False)]
                sizes = np.array([len(t) // 4 for t in texts])
                if sizes.tolist() != list(b.counts):
                    raise ValueError("a document does not have the number of ids its block states")
                out = pd.DataFrame({"doc_id": pd.array([None if d is None else int(d) for d in b.doc_ids], dtype="Int64"), "start": b.start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(t) for t in texts]})
                if with_ids:
                    out["ids"] = texts
                yield out

    return stored.mapInPandas(documents, struct(schema))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents named ``doc_id`` (more than one if the id is repeated): opens their frames only."""
    _, dictionary = _dictionary(spark, path)
    opener = zstandard.ZstdDecompressor(**_codec(dictionary))
    found = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    hits = found.select("width", "payload", "offsets", F.posexplode("doc_ids").alias("k", "id")).where(F.col("id") == doc_id)
    frames = hits.select("width", F.expr("substring(payload, int(offsets[k]) + 1, int(offsets[k + 1] - offsets[k]))"))
    return [np.frombuffer(deserialize(opener.decompress(bytes(f)), w), dtype="<u4").tolist() for w, f in frames.collect()]


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_container(table(spark, sf_dir, "documents"), path)
    return read_container(spark, path, with_ids=False)
