"""Stored inverted indexes of the project's texts, built once for a state of a table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fts, vector
from ..session import shared_dir, table
from . import base as B

#: What is indexed: (table, key, columns that come along).
SOURCES = {"documents": ("documents", "doc_id", []), "chunks": ("chunks", "chunk_id", ["project_id"]), "chunks_ids": ("chunks", "chunk_id", ["project_id"]), "messages": ("git_commits", "commit_hash", [])}


def _rows(spark: SparkSession, d: str, source: str) -> tuple[DataFrame, str]:
    """The texts of a source and the name of their column."""
    if source == "documents":
        return table(spark, d, "documents"), "text"
    if source == "messages":
        return B.commits(spark, d).where("message is not null"), "message"
    c = B.chunks(spark, d)
    return (c.withColumn("content", F.concat_ws(" ", "chunk_id", "project_id", "content")), "content") if source == "chunks_ids" else (c, "content")


def _kept(spark: SparkSession, d: str, name: str, tag: str, write: Callable[[str], None]) -> str:
    """The folder of what `write` makes of a table, below the shared one; it is named by the table's path, bytes and time, so that a
    table that was written again has another."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = f"{fs.makeQualified(at)}|{fs.getContentSummary(at).getLength()}|{fs.getFileStatus(at).getModificationTime()}|{tag}|1"
    path = f"{shared_dir(spark)}/index-{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    home = jvm.org.apache.hadoop.fs.Path(path)
    own = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not own.exists(home):
        temp = f"{path}-{uuid.uuid4().hex}"
        write(temp)
        if not own.rename(jvm.org.apache.hadoop.fs.Path(temp), home):
            own.delete(jvm.org.apache.hadoop.fs.Path(temp), True)  # another session was first
    return path


def stored(spark: SparkSession, d: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(postings, totals) of a source, read from the shared folder, where they are written sorted by term when the table is new."""
    name, key, also = SOURCES[source]

    def write(to: str) -> None:
        rows, text = _rows(spark, d, source)
        fts.totals(rows, text).write.parquet(f"{to}/totals")
        fts.postings(rows, key, text, also).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{to}/postings")

    path = _kept(spark, d, name, source, write)
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")


def stored_cells(spark: SparkSession, d: str, name: str, key: str, column: str, dim: int) -> tuple[DataFrame, np.ndarray] | None:
    """The vectors of a table with their cells, and the cells' centres, fitted once for a state of the table; None without vectors."""

    def write(to: str) -> None:
        found = vector.ivf_cells(table(spark, d, name), key, column, dim)
        if found is None:
            spark.createDataFrame([], "n int, centre array<double>").write.parquet(f"{to}/centres")
            return
        rows, centres = found
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "n int, centre array<double>").write.parquet(f"{to}/centres")
        rows.select(key, column, "prediction").repartitionByRange("prediction").sortWithinPartitions("prediction").write.parquet(f"{to}/cells")

    path = _kept(spark, d, name, f"cells of {column}", write)
    centres = [r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("n").collect()]  # NLIST rows
    return (spark.read.parquet(f"{path}/cells"), np.array(centres)) if centres else None


def search(spark: SparkSession, d: str, source: str, query: str, mode: str = "strict", limit: int | None = None, project_id: str | None = None) -> DataFrame:
    """(key, score) of a query on a source's index; statistics are those of all projects."""
    index, sums = stored(spark, d, source)
    _, key, also = SOURCES[source]
    within = F.col("project_id") == project_id if project_id is not None else None
    if limit:
        return fts.best(index, sums, key, query, limit, mode, also if within is not None else None, within)
    return fts.match(index, sums, key, fts.parse(query, mode), also if within is not None else None, within).select(key, "score")
