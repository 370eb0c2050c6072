"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 hashes of word shingles. To find every pair within Hamming distance
r without comparing all, each fingerprint enters 2^(r+1) - 1 tables: bit i gets a vector f(i) of r + 1 bits, and table v
keeps the bits with <f(i), v> = 1. The at most r bits in which two fingerprints differ span at most r dimensions, so
some v is orthogonal to all of them; table v masks all of those bits and the two fingerprints collide there (Pagh,
"Locality-sensitive hashing without false negatives", 2016). Collisions are verified; a bucket yields a spanning forest
of its links, never all of its pairs, and connected components give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import components, cut, deal_groups, least_roots, own_columns, table, whole_groups

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: The bits of each value of an octet, lowest first.
OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the covering family: for any ``radius`` bits some mask has none of them.

    Bit i gets the nonzero vector 1 + i mod (2^(radius+1) - 1), so all masks have about the same number of bits.
    """
    vectors = 2 ** (radius + 1) - 1
    f = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(f[i] & v).count("1") % 2) for v in range(1, vectors + 1)]


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), dtype="<u8", count=n)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ OCTET_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """As Spark's signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _bucket_links(batches: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links inside each unit of ``deal_groups``: edges (a, b) to the least of each part."""
    keys = ["mask", "bits", "ublock", "vblock"]
    for rows in whole_groups(batches, keys):
        fp = rows["fp"].to_numpy().view(np.uint64)
        own, cross = rows["own"].to_numpy(), (rows["ublock"] != rows["vblock"]).to_numpy()
        new = np.ones(len(rows), dtype=bool)
        new[1:] = np.any([(rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1]) for k in keys], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rows)))
        found = [np.empty((0, 2), dtype=np.int64)]
        # all groups at once, by distance between the rows of a pair
        group = np.repeat(np.arange(len(start)), size)
        for d in range(1, min(int(size.max()), 17)):
            i = np.flatnonzero(group[d:] == group[:-d])
            i = i[(size[group[i]] <= 16)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            i = i[~cross[i] | (own[i] != own[i + d])]
            found.append(np.stack([i, i + d], axis=1))
        for s, n in zip(start[size > 16], size[size > 16], strict=True):
            near = np.bitwise_count(fp[s : s + n, None] ^ fp[None, s : s + n]) <= radius
            if cross[s]:
                near &= own[s : s + n, None] != own[None, s : s + n]
            found.append(np.argwhere(np.triu(near, 1)) + s)
        pairs = np.concatenate(found)
        # one edge from each row to the least of its part, within this batch's groups
        root = least_roots(len(rows), pairs[:, 0], pairs[:, 1])
        linked = np.flatnonzero(root != np.arange(len(rows)))
        yield pd.DataFrame({"a": rows["fp"].to_numpy()[root[linked]], "b": rows["fp"].to_numpy()[linked]}).drop_duplicates()


def fingerprint_groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) for the linked ones among the distinct longs in ``fps.fp``."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in covering_masks(radius)])
    postings = fps.select("fp", F.posexplode(masks).alias("mask", "m")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("m")).alias("bits"))
    units = deal_groups(postings, ["mask", "bits"], "fp")
    keys = ["mask", "bits", "ublock", "vblock"]
    links = units.select("fp", "own", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return components(links.mapInPandas(lambda batches: _bucket_links(batches, radius), "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null or empty texts, and texts of spaces, have fingerprint zero and link like any other. Equal fingerprints are one
    node, so copies are never paired with each other. A null id stays null and never names a group (a group of nulls
    alone has a null component). Repeated rows give repeated rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(text_col).alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = fingerprint_groups(fps.select("fp"))
    linked = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = cut(linked)
    named = cut(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    names = cut(linked.join(named, "component").select("fp", "component_id"))
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each group stays, with its columns.

    Rows without an id cannot be named and stay. Where an id is repeated, the row of its least text
    stays, of equal texts the one of least hash over all columns (columns of maps aside).
    """
    groups = simhash_groups(docs.select(id_col, text_col), id_col, text_col)
    keep = cut(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("times")))
    named = docs.join(keep.where("times = 1").select(id_col), id_col, "left_semi").select(own_columns(docs))
    again = docs.join(keep.where("times > 1").select(id_col), id_col, "left_semi")
    hashed = [c for c, (_, t) in zip(own_columns(docs), docs.dtypes, strict=True) if "map<" not in t and "variant" not in t]
    first = F.min_by(F.struct(*own_columns(docs)), F.struct(F.col(text_col), F.xxhash64(*hashed)))
    one = again.groupBy(id_col).agg(first.alias("__row")).select("__row.*").select(own_columns(docs))
    return named.union(one).union(docs.where(F.col(id_col).isNull()))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
