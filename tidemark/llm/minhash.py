"""MinHash fingerprints of documents, and near-duplicates by bands of them.

A text's shingles are its runs of five words. Each of ``PERMUTATIONS`` functions a * x + b modulo 2^64 (universal, a odd)
orders the 64-bit shingle hashes; the least value per function, cut to its upper 16 bits, is one number of the
fingerprint, and the share of equal numbers of two fingerprints estimates the Jaccard similarity of their shingles. All
functions are applied to a block of shingles at once in numpy.

``fingerprint_documents`` compares each document with an edited form of itself and with its neighbour by id. Neighbours
meet without a sort of the whole table in one place: ids are cut at approximate quantiles, a row lies in one cell, and the
first row of a cell is sent to the cell before it as well. ``near_duplicates`` groups documents whose shingles have a
Jaccard similarity of 0.8 or more: fingerprints that agree in a band are joined, and every link is verified on the
shingles of the two texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import components, cut, deal_groups, staged, struct, table, whole_groups

SHINGLE, PERMUTATIONS, SEED = 5, 128, 7
#: Bands of the fingerprint and numbers in each: a pair of similarity 0.8 shares no band in 1 of 20,000 cases.
BANDS, BAND_NUMBERS = 25, 5
SIMILARITY = 0.8
#: Pairs whose fingerprints agree in less than this share are not verified: five standard deviations below 0.8.
LEAST_ESTIMATE = 0.62
#: Nodes of half a unit in which the pairs of a large bucket are verified.
UNIT = 512
#: Cells of ids per shuffle partition; words whose hash a worker keeps; shingles hashed at once.
CELLS, KEPT, CHUNK = 4, 400_000, 512
#: A-Z count as a-z; words are parted by ASCII white space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


@lru_cache(maxsize=1)
def _worker() -> tuple[WordHashes, np.ndarray, np.ndarray, np.ndarray]:
    """A worker's word hashes, the factors of a shingle's words, and the functions' a and b."""
    draw = np.random.default_rng(SEED).integers(0, 2**64, size=SHINGLE + 2 * PERMUTATIONS, dtype=np.uint64)
    return WordHashes(), draw[:SHINGLE] | np.uint64(1), draw[SHINGLE : SHINGLE + PERMUTATIONS] | np.uint64(1), draw[SHINGLE + PERMUTATIONS :]


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER).split()
    return np.fromiter(map(_worker()[0].__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each run of five words; of a shorter text, of each run from its first word on. Repeats included."""
    factors, n = _worker()[1], len(words)
    if n >= SHINGLE:
        x = sum(words[i : n - SHINGLE + 1 + i] * factors[i] for i in range(SHINGLE))
    else:
        x = np.cumsum(words * factors[:n], dtype=np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    x = x ^ (x >> np.uint64(32))
    return x * factors[0]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each function over the shingles; the largest number if there are none."""
    _, _, a, b = _worker()
    least = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK):
        x = hashes[i : i + CHUNK, None] * a
        x += b
        np.minimum(least, x.min(axis=0), out=least)
    return least


def numbers(least: np.ndarray) -> np.ndarray:
    return (least >> np.uint64(48)).astype(">u2")


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text as hex digits, four per number; a text without words has all ones."""
    return numbers(minima(shingles(word_hashes((text or "").encode("utf-8"))))).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, after: str) -> str:
    """A text whose last quarter gives way to the beginning of the next."""
    gone = len(text) // 4
    return text[: len(text) - gone] + after[:gone]


def both_minima(text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
    """The minima of a text and of its edited form; shingles of the words that both begin with count once."""
    keep = text[: len(text) - len(text) // 4].encode("utf-8")
    same = keep.split()
    ends = not same or keep[-1:].isspace()  # else the last word may go on differently
    shared, start = (len(same), len(keep)) if ends else (len(same) - 1, len(keep) - len(same[-1]))
    own = word_hashes(text.encode("utf-8"))
    other = np.concatenate([own[:shared], word_hashes(edited.encode("utf-8")[start:])])
    a, b, common = shingles(own), shingles(other), shared - SHINGLE + 1
    if common <= 0:
        return minima(a), minima(b)
    base = minima(a[:common])
    return np.minimum(base, minima(a[common:])), np.minimum(base, minima(b[common:]))


DEALT = pa.schema([("cell", pa.int32()), ("is_next", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Bounded record batches of rows; an empty one if there are none."""
    rows = iter(rows)
    while True:
        some = list(islice(rows, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)] if some else [pa.array([], t) for t in schema.types], schema=schema)
        if len(some) < size:
            return


def _firsts(quantiles: list[int]):
    """The least id of each cell between the (inexact) quantiles, as far as a partition knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for (doc_id,) in _rows(batches):
            cell = bisect_right(quantiles, doc_id)
            least[cell] = min(doc_id, least.get(cell, doc_id))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], names=["cell", "doc_id"])

    return run


def _dealt(bounds: list[int], nulls: bool):
    """Rows of ``DEALT``: each text in its cell, the first text of a cell also as the next one of the cell before.

    Cell i holds the ids from bounds[i] up to the next bound, the first one null ids too. Of rows that share a cell's
    first id the one of least tie is handed on, one from each partition.
    """
    first, edges, last = None if nulls else bounds[0], bounds[1:], len(bounds) - 1
    before = {b: i for i, b in enumerate(edges)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pack, ahead = zstandard.ZstdCompressor(level=3).compress, {}
        for doc_id, text in _rows(batches):
            raw = (text or "").encode("utf-8")
            tie, packed = xxhash.xxh64_intdigest(raw) - 2**63, pack(raw)
            yield 0 if doc_id is None else bisect_right(edges, doc_id), False, doc_id, tie, packed
            for to in ([last] if doc_id == first else []) + ([before[doc_id]] if doc_id in before else []):
                if to not in ahead or tie < ahead[to][3]:
                    ahead[to] = to, True, doc_id, tie, packed
        yield from ahead.values()

    return lambda batches: _batches(rows(batches), DEALT)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of cells and ids: one row per document, made once the next two texts are known."""
    unpack = zstandard.ZstdDecompressor().decompress

    def rows() -> Iterator[tuple]:
        cell, held, waiting = None, None, None

        def done(row: tuple, following: np.ndarray) -> tuple:
            doc_id, text, edited, own, other = row
            return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following)

        for at, is_next, doc_id, packed in _rows(batches):
            if at != cell:
                cell, held, waiting = at, None, None
            elif held is None:
                continue  # another row of the next cell's first id
            text = unpack(packed).decode("utf-8")
            if held is not None:
                edited = edited_text(held[1], text)
                own, other = map(numbers, both_minima(held[1], edited))
                if waiting:
                    yield done(waiting, own)
                waiting = (*held, edited, own, other)
            if is_next:
                yield done(waiting, numbers(minima(shingles(word_hashes(text.encode("utf-8"))))))
                held, waiting = None, None
            else:
                held = doc_id, text

    return _batches(rows(), pa.schema([(f, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for f, t in (x.split() for x in COMPARED.split(", "))]))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by as many of the next document's first ones (or
    all it has), documents in the order of their ids and the first after the last. near_edited and near_next are the
    shares of equal numbers of the fingerprints: to the edited text's and to the next document's.

    A null text is empty; texts without words have equal fingerprints. Null ids come before all others; rows of equal id
    come in the order of a hash of their texts, and alike rows in any. A single row is its own next. Other columns are
    ignored. An empty table gives an empty result. Very many rows of one id, or without one, lie in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (CELLS * parts) for i in range(1, CELLS * parts)]
    quantiles, nulls = rows.agg(F.percentile_approx("doc_id", shares, 100 * CELLS * parts), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    firsts = rows.select("doc_id").where("doc_id is not null").mapInArrow(_firsts(sorted(set(quantiles or []))), struct("cell int, doc_id long"))
    bounds = sorted(r[0] for r in firsts.groupBy("cell").agg(F.min("doc_id")).select("min(doc_id)").collect()) or [0]  # one per cell
    dealt = rows.mapInArrow(_dealt(bounds, nulls > 0), struct("cell int, is_next boolean, doc_id long, tie long, packed binary"))
    order = ["cell", "is_next", F.asc_nulls_first("doc_id"), "tie"]
    ordered = dealt.repartition(parts, "cell").sortWithinPartitions(*order).select("cell", "is_next", "doc_id", "packed")
    return ordered.mapInArrow(_compared, struct(COMPARED))


def op12_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def _key(text: str | None) -> bytes:
    """Equal for texts of the same words."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8").translate(LOWER).split()))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("print", pa.binary())])
    return _batches(((i, _key(t), bytes.fromhex(fingerprint(t))) for i, t in _rows(batches)), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of the texts whose words are those looked for."""
    found = ((key, np.unique(shingles(word_hashes((t or "").encode("utf-8")))).tobytes()) for key, t in _rows(batches) if _key(t) == key)
    return _batches(found, pa.schema([("key", pa.binary()), ("shingles", pa.binary())]), 200)


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of sets of 64-bit hashes, each sorted; 1 for two empty ones."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
    return pd.Series(out, dtype="float64")


UNIT_KEYS = ["band", "bucket", "ublock", "vblock"]
UNIT_ROWS = "band int, bucket long, ublock int, vblock int, own int, key binary, component binary, print binary"


def _partners(i: int, prints: np.ndarray, bands: np.ndarray, part: np.ndarray, own: np.ndarray, one_block: bool) -> np.ndarray:
    """The later rows of a unit that row i is to be compared with: in another component, with a fingerprint that is near
    enough, and not met in an earlier band."""
    at = np.flatnonzero((part[i + 1 :] != part[i]) & ((own[i + 1 :] != own[i]) | one_block)) + i + 1
    at = at[(prints[at] == prints[i]).mean(axis=1) >= LEAST_ESTIMATE]
    return at[~(bands[at] == bands[i]).all(axis=2).any(axis=1)]


def _units(some: pd.DataFrame) -> Iterator[tuple]:
    """The place and the arrays of each unit of a batch of whole units."""
    prints, part, own = np.frombuffer(b"".join(some["print"]), ">u2").reshape(len(some), -1), pd.factorize(some["component"])[0], some["own"].to_numpy()
    places = [some[k].to_numpy() for k in UNIT_KEYS]
    edges = np.flatnonzero(np.any([p[1:] != p[:-1] for p in places], axis=0)) + 1
    for low, high in zip([0, *edges], [*edges, len(some)], strict=True):
        band, rows = int(places[0][low]), slice(low, high)
        bands = np.ascontiguousarray(prints[rows, : band * BAND_NUMBERS]).reshape(high - low, band, BAND_NUMBERS)
        yield rows, prints[rows], bands, part[rows].copy(), own[rows], bool(places[2][low] == places[3][low])


def _with_partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of units that are to be compared with any other of their unit: most of a bucket's meet by chance."""
    for some in whole_groups(batches, UNIT_KEYS):
        kept = np.zeros(len(some), dtype=bool)
        for rows, *unit in _units(some):
            mine = kept[rows]
            for i in range(len(mine) - 1):
                at = _partners(i, *unit)
                mine[at] = True
                mine[i] |= len(at) > 0
        yield some[kept]


def _unit_links(similarity: float):
    """A spanning forest of the verified links in each unit of ``deal_groups``, over the components known before.

    A pair is looked at in the first band that it shares and if its fingerprints are near enough; pairs that are
    connected already are not verified.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_groups(batches, UNIT_KEYS):
            every, keys, found = [np.frombuffer(x, "<u8") for x in some["shingles"]], some["key"].to_numpy(), []
            for rows, prints, bands, part, own, one_block in _units(some):
                sets, key = every[rows], keys[rows]
                for i in range(len(key) - 1):
                    for j in _partners(i, prints, bands, part, own, one_block):
                        if part[j] != part[i]:
                            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                                part[part == part[j]] = part[i]
                                found.append((min(key[i], key[j]), max(key[i], key[j])))
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest id reachable by links).

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more; this is verified
    for every link. Texts of the same words are one node. A band of fingerprints that agree is a bucket; each node is
    first tried with the least of its bucket, and only buckets whose nodes are in several components then look at their
    pairs, in units of bounded size: first by fingerprints, then those rows with a near one by their shingles. Pairs that
    no band finds are lost, 1 in 20,000 at 0.8.

    Texts without words are copies of each other. A null id stays null and names no component (one of null ids alone has
    a null). Repeated rows give repeated rows. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(rows.mapInArrow(_prints, struct("doc_id long, key binary, print binary")), "minhash-prints")
    nodes = staged(prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("print").alias("print")), "minhash-nodes")

    width = 2 * BAND_NUMBERS
    bands = F.array(*[F.xxhash64(F.substring("print", i * width + 1, width)) for i in range(BANDS)])
    postings = nodes.select("key", F.posexplode(bands).alias("band", "bucket"))
    buckets = postings.groupBy("band", "bucket").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = staged(postings.join(buckets, ["band", "bucket"]), "minhash-buckets")
    stars = cut(shared.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct())

    # the shingles of the nodes that share a bucket, from one text of each
    needed = shared.select("key").distinct().join(nodes.select("key", F.col("doc_id").alias("of")), "key")
    texts = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("of"))).select("key", "text")
    sets = staged(texts.mapInArrow(_sets, struct("key binary, shingles binary")).groupBy("key").agg(F.first("shingles").alias("shingles")), "minhash-shingles")
    of = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}"))
    links = cut(stars.join(of("a"), "a").join(of("b"), "b").where(jaccard("of_a", "of_b") >= similarity).select("a", "b"))

    placed = shared.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = cut(placed.select("band", "bucket", "key", "component"))
    open_buckets = cut(placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "bucket"))
    units = deal_groups(placed.join(open_buckets, ["band", "bucket"]), ["band", "bucket"], "key", UNIT)
    units = units.join(nodes.select("key", "print"), "key").select(*[f.split()[0] for f in UNIT_ROWS.split(", ")])
    together = lambda rows: rows.repartition(*UNIT_KEYS).sortWithinPartitions(*UNIT_KEYS)
    near = cut(together(units).mapInPandas(_with_partners, struct(UNIT_ROWS)))  # shingles are fetched for these rows only
    more = together(near.join(sets, "key")).mapInPandas(_unit_links(similarity), struct("a binary, b binary")).distinct()
    links = cut(links.union(more))
    groups = cut(nodes.select("key", "doc_id").join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    named = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = cut(groups.join(named, "component").select("key", "component_id"))
    return prints.select("doc_id", "key").join(names, "key").select("doc_id", "component_id")


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
