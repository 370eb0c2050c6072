"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder, else (local masters only) a temporary one.

    On a cluster that names no folder this raises: executors would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """The application's own folder for stored tables of the market part."""
    return f"{shared_dir(spark)}/tidemark-market-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def drop_path(spark: SparkSession, path: str) -> None:
    fs, folder = file_system(spark, path)
    fs.delete(folder, True)


def clear_staged(spark: SparkSession) -> None:
    """Deletes what the application has stored for its queries. For when their results are not to be read any more."""
    drop_path(spark, application_dir(spark))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The entries of a folder; none if it does not exist."""
    fs, folder = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def file_marks(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: differs once the table is written anew."""
    fs, folder = file_system(spark, path)
    files = fs.listFiles(folder, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    fs, file = file_system(spark, path)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small text file in one step: readers see the old text or the new one."""
    new = f"{path}.{uuid.uuid4().hex}"
    fs, file = file_system(spark, new)
    stream = fs.create(file, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(file), fs.makeQualified(file_system(spark, path)[1]), how)
