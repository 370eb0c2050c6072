"""Helpers shared by the training-data operators: staging, grouped batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space.
ASCII_SPACE = "\x20\x09-\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, else (local masters only) a temporary one.

    On a cluster that names no folder this raises: executors would not see each other's temporary files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one, for all that it stages."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can reach."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that the application has staged. For when no result of its operators is to be read any more."""
    drop_path(spark, staging_dir(spark))


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for slim tables that are read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` under their names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever case its own names use."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cuts batches that are sorted by ``keys`` so that no group is split between two of them.

    Holds one group beyond a batch at most; callers bound the size of a group.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = np.ones(len(batch), dtype=bool)
        for k in keys:
            last &= (batch[k] == batch[k].iloc[-1]).to_numpy()
        start = int(np.argmax(last))
        if start == 0 and held and all(held[-1][k].iloc[-1] == batch[k].iloc[-1] for k in keys):
            held.append(batch)
            continue
        head = pd.concat([*held, batch.iloc[:start]], ignore_index=True)
        if len(head):
            yield head
        held = [batch.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def deal_groups(rows: DataFrame, keys: list[str], item: str, block: int = 128) -> DataFrame:
    """Deals groups of rows into work units of a bounded size, so that no task ever holds a large group.

    Groups of one row go. A group of n rows is cut by a hash of ``item`` into blocks of about max(``block``,
    2 sqrt(n)) rows, and each pair of blocks is a unit. Adds the columns ``ublock, vblock`` (the unit) and ``own``
    (the row's block); rows of the same block are to be compared only in the unit (b, b), rows of two blocks only in
    their common unit, so every pair of a group meets exactly once.
    """
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    dealt = rows.join(sizes, keys)
    dealt = dealt.withColumn("__b", F.ceil(F.col("__n") / F.greatest(F.lit(float(block)), 2 * F.sqrt("__n"))).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), F.col(item)), F.col("__b")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.expr("sequence(0, __b - 1)")))
    return dealt.withColumn("ublock", F.least("own", "__o")).withColumn("vblock", F.greatest("own", "__o")).drop("__n", "__b", "__o")


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, given edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b; orderable): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge changes; each round is a
    minimum per node and a join back, so nothing is gathered beyond a row per edge. Nodes without edges are not
    returned. An edge table is checkpointed per round.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = _signature(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are checkpointed so that Spark can split the rows of a node with very many edges in the join
        low = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")))
        large = cut(both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct())
        low = cut(large.groupBy("b").agg(F.min("a").alias("low")))
        edges = cut(large.join(low, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
        now = _signature(edges)
        if now == state:
            member = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return member.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = now


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def struct(fields: str) -> T.StructType:
    """A schema from "name type, ...", without the session that a DDL string needs."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])
