"""Near-duplicate embeddings by a pivot-permutation index.

Near vectors see the same reference points nearest, in much the same order. Every distinct vector is described by its
``PREFIX`` nearest pivots in order of nearness and the angles to them; inverted lists per label and pivot bring together
vectors that share pivots. Pairs that share at least ``LEAST_SHARED`` pivots, and whose angles to each shared one differ by
no more than theirs to each other may (the triangle inequality), are candidates; each is verified by its cosine in double
precision. A pair is verified in one place only: the list of the least pivot it shares. So no vector needs an entry in the
lists of the last ``LEAST_SHARED`` - 1 of its pivots.

The lists hold ids, pivots and angles alone. Vectors are fetched only for what is a candidate in some list. The pivots are
a bounded sample of the vectors, those of least hash that are not close to one another (pivots inside one dense group
would split its members at random); they grow with the square root of the number of vectors, so lists grow no faster than
that. A list is cut into blocks (see ``deal_groups``), and a unit reports per vector its number of links and the least
vector it hangs together with: never its pairs.

Equal vectors are found by comparing vectors, once; after that a row finds its vector by label and two 64-bit hashes, so
that vectors are not moved or stored again. (Among 10^10 vectors two share both hashes with a chance of 2 in 10^19.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import components, cut, deal_groups, least_roots, struct, table, whole_groups

COSINE = 0.98
PREFIX, LEAST_SHARED = 8, 2
#: Pivots: PER_ROOT times the square root of the number of vectors, within these limits.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 65_536
#: Pivots are less similar than this to each other.
APART = 0.8
#: Cells of a matrix of pairs, or pairs, that are held at once; rounding that an angle may have. Units of up to SMALL
#: vectors are searched together, larger ones strip by strip.
CELLS, SLACK, SMALL = 1 << 20, 1e-5, 128
#: Words of 64 bits that a vector's pivots beyond its list's are hashed to.
WORDS = 4
UNIT = ["label", "dim", "pivot", "ublock", "vblock"]


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of norm 1."""
    m = np.array(vectors.tolist(), dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _numbers(vectors: DataFrame, vector_col: str) -> str:
    """Floats stay floats, which take half the room; any other numbers are doubles."""
    kind = dict(vectors.dtypes)[vector_col]
    return kind if kind == "array<float>" else "array<double>"


def spread(points: np.ndarray, apart: float = APART, block: int = 512) -> np.ndarray:
    """The points, in order, without those as similar as ``apart`` to one taken before; a block at a time."""
    taken = np.empty_like(points)
    n = 0
    for i in range(0, len(points), block):
        some = points[i : i + block]
        if n:
            some = some[(some @ taken[:n].T).max(axis=1) < apart]
        close = some @ some.T >= apart
        own: list[int] = []
        for k in range(len(some)):
            if not close[k, own].any():
                own.append(k)
        taken[n : n + len(own)] = some[own]
        n += len(own)
    return taken[:n]


def _describe(pivots: Broadcast, prefix: int):
    """The ordered nearest pivots of rows of (node, label, dim, embedding), and the angles to them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                points = pivots.value[dim]
                step = max(1, CELLS // len(points))
                for i in range(0, len(rows), step):
                    part = rows.iloc[i : i + step]
                    near = _unit_rows(part["embedding"]) @ points.T
                    k = min(prefix, len(points))
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    cosines = np.take_along_axis(near, top, axis=1)
                    order = np.argsort(-cosines, axis=1, kind="stable")
                    angles = np.arccos(np.clip(np.take_along_axis(cosines, order, axis=1), -1, 1))
                    out = part.drop(columns="embedding")
                    out["pivots"] = np.take_along_axis(top, order, axis=1).astype(np.int32).tolist()
                    out["angles"] = angles.astype(np.float32).tolist()
                    yield out

    return run


@dataclass
class _Units:
    """Whole units of vectors of one length, in order, as arrays."""

    rows: pd.DataFrame
    cosine: float
    least_shared: int

    def __post_init__(self):
        rows, n = self.rows, len(self.rows)
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in UNIT], axis=0)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n))
        self.group = np.repeat(np.arange(len(self.start)), self.size)
        self.own, self.cross = rows["own"].to_numpy(), (rows["ublock"] != rows["vblock"]).to_numpy()
        self.pivot = rows["pivot"].to_numpy()
        self.pivots, self.angles = np.array(rows["pivots"].tolist()), np.array(rows["angles"].tolist())
        self.here = self.angles[self.pivots == self.pivot[:, None]]  # the angle to the list's pivot, which each row has
        self.least = min(self.least_shared, self.pivots.shape[1])
        self.most = float(np.arccos(self.cosine)) + SLACK
        beyond, word, bit = self.pivots > self.pivot[:, None], self.pivots % WORDS, np.uint64(1) << (self.pivots // WORDS % 64).astype(np.uint64)
        self.bits = [np.bitwise_or.reduce(np.where(beyond & (word == w), bit, np.uint64(0)), axis=1) for w in range(WORDS)]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The candidate pairs of all small units, a part at a time.

        A pair belongs to the list of the least pivot it shares, so one of several shared pivots is beyond the list's: most
        pairs have no bit of such a pivot in common and are told by that; the pivots of the others are compared.
        """
        small = self.size[self.group] <= SMALL
        for d in range(1, int(self.size[self.size <= SMALL].max(initial=1))):
            i = np.flatnonzero((self.group[d:] == self.group[:-d]) & small[d:])
            i = i[np.abs(self.here[i] - self.here[i + d]) <= self.most]
            i = i[~self.cross[i] | (self.own[i] != self.own[i + d])]
            if self.least > 1:
                i = i[reduce(np.bitwise_or, [b[i] & b[i + d] for b in self.bits]) != 0]
            for k in range(0, len(i), CELLS >> 4):
                a = i[k : k + (CELLS >> 4)]
                shared = self.pivots[a][:, :, None] == self.pivots[a + d][:, None, :]
                apart = np.abs(self.angles[a][:, :, None] - self.angles[a + d][:, None, :])
                mine = shared.any(axis=2)
                fits = (mine.sum(axis=1) >= self.least) & ~(shared & (apart > self.most)).any(axis=(1, 2))
                fits &= ~(mine & (self.pivots[a] < self.pivot[a][:, None])).any(axis=1)
                yield a[fits], a[fits] + d

    def strips(self) -> Iterator[tuple[slice, int, np.ndarray]]:
        """Of each large unit: its rows, and strip by strip the first row and the matrix of candidate pairs with all."""
        for s, n in zip(self.start[self.size > SMALL], self.size[self.size > SMALL], strict=True):
            unit = slice(s, s + n)
            values, at = np.unique(self.pivots[unit], return_inverse=True)
            has = np.zeros((n, len(values)), dtype=np.float32)
            has[np.arange(n)[:, None], at.reshape(n, -1)] = 1
            lower, angle, own = has[:, values < self.pivot[s]], self.here[unit], self.own[unit]
            step = max(1, CELLS // n)
            for i in range(0, n, step):
                to = slice(i, i + step)
                here = has[to] @ has.T >= self.least
                here &= lower[to] @ lower.T == 0
                here &= np.abs(angle[to, None] - angle[None, :]) <= self.most
                if self.cross[s]:
                    here &= own[to, None] != own[None, :]
                here[np.arange(len(here)), np.arange(i, i + len(here))] = False
                yield unit, i, here


def _of_one_length(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in whole_groups(batches, UNIT):
        for _, part in rows.groupby("dim", sort=False):
            yield part


def _with_partners(cosine: float, least_shared: int):
    """The rows of each unit that are in a candidate pair there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _of_one_length(batches):
            units, some = _Units(rows, cosine, least_shared), np.zeros(len(rows), dtype=bool)
            for a, b in units.pairs():
                some[a] = some[b] = True
            for unit, i, here in units.strips():
                some[unit][i : i + len(here)] |= here.any(axis=1)
            yield rows[some]

    return run


def _verify(cosine: float, least_shared: int):
    """Per unit and linked vector: (node, links to it counting copies, the least node of its part)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _of_one_length(batches):
            units, n = _Units(rows, cosine, least_shared), len(rows)
            node, copies, x = rows["node"].to_numpy(), rows["copies"].to_numpy(), _unit_rows(rows["embedding"])
            order = np.argsort(node, kind="stable")  # so that the least position is the least node
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)
            links, all_, edges = np.zeros(n, dtype=np.int64), np.arange(n), []
            for a, b in units.pairs():
                near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                edges.append((rank[a], rank[b]))
            for unit, i, here in units.strips():
                here &= x[unit][i : i + len(here)] @ x[unit].T >= cosine
                links[unit][i : i + len(here)] += here @ copies[unit]
                a, b = np.nonzero(here)  # of a strip's links, a forest is kept
                own, inverse = np.unique(np.concatenate([rank[unit][a + i], rank[unit][b]]), return_inverse=True)
                edges.append((own, own[least_roots(len(own), inverse[: len(a)], inverse[len(a) :])]))
            root = least_roots(n, *map(np.concatenate, zip(*edges, strict=True))) if edges else all_
            some = np.flatnonzero(links)
            yield pd.DataFrame({"node": node[some], "links": links[some], "root": node[order][root[rank[some]]]})

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, prefix: int = PREFIX, least_shared: int = LEAST_SHARED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal labels and lengths are compared. Null labels, null or empty vectors, zero vectors, and vectors
    with null or non-finite components link with nothing: each is its own component. Equal vectors are one node with a
    number of copies; every row is a vector, so a repeated row links with its twin. A null id stays null, counts as a
    link of others, and never names a component that has an id. Pivots equally near are taken in either order: it decides
    no pair by itself. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(_numbers(vectors, vector_col)).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fits", fits)
    mark, marks = [F.xxhash64(F.lit(k), F.col("embedding")).alias(f"h{k}") for k in (1, 2)], ["label", "h1", "h2"]
    nodes = rows.where("fits").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "label", *mark, F.size("embedding").alias("dim"), "least", "copies", "embedding"))

    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}  # a row per vector length
    pivots = {}
    for dim, n in sizes.items():
        m = max(LEAST_PIVOTS, min(MOST_PIVOTS, PER_ROOT * isqrt(n)))
        few = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "node").limit(m).toPandas()
        pivots[dim] = spread(_unit_rows(few["embedding"]))
    told = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    label = f"label {dict(rows.dtypes)['label']}"
    described = nodes.select("node", "label", "dim", "embedding").mapInPandas(_describe(told, prefix), f"node long, {label}, dim int, pivots array<int>, angles array<float>")
    listed = F.when(F.size("pivots") >= least_shared, F.slice(F.sort_array("pivots"), 1, F.size("pivots") - (least_shared - 1))).otherwise(F.col("pivots"))
    postings = cut(described).select("*", F.explode(listed).alias("pivot"))

    def dealt(units: DataFrame) -> DataFrame:
        return units.repartition(*UNIT).sortWithinPartitions(*UNIT)

    units = deal_groups(postings, ["label", "dim", "pivot"], "node")
    fields = f"{label}, dim int, pivot int, node long, pivots array<int>, angles array<float>, own int, ublock int, vblock int"
    paired = cut(dealt(units).select(*[f.split()[0] for f in fields.split(", ")]).mapInPandas(_with_partners(cosine, least_shared), fields))
    whole = dealt(paired.join(nodes.select("node", "copies", "embedding"), "node"))
    links = cut(whole.mapInPandas(_verify(cosine, least_shared), struct("node long, links long, root long")))

    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("root").alias("a"), F.col("node").alias("b")))
    linked = nodes.drop("embedding").join(degrees, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = cut(linked.select(*marks, "least", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    names = cut(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    linked = cut(linked.join(names, "component").select(*marks, "n_links", "component_id"))
    good = rows.where("fits").select("vec_id", "label", *mark).join(linked, marks).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fits").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
