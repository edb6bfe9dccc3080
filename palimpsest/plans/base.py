"""The project's tables with repeated rows made one, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import newest
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views that the SQL below builds on; the engine ignores those a statement doesn't use.
BASE = """
WITH c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, access_count DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
cm AS (SELECT DISTINCT * FROM git_commits WHERE commit_hash IS NOT NULL),
gd AS (SELECT DISTINCT * FROM git_diffs WHERE id IS NOT NULL),
fm AS (SELECT DISTINCT * FROM file_metadata WHERE project_id IS NOT NULL AND file_path IS NOT NULL),
fc AS (SELECT DISTINCT * FROM file_chunks WHERE project_id IS NOT NULL AND file_path IS NOT NULL AND chunk_id IS NOT NULL),
ss AS (SELECT DISTINCT * FROM search_sessions WHERE session_id IS NOT NULL),
ec AS (SELECT content_hash, model_name, min(created_at) AS created_at, min(embedding) AS embedding FROM embedding_cache WHERE content_hash IS NOT NULL GROUP BY 1, 2),
jb AS (SELECT DISTINCT * FROM scan_runs WHERE job_id IS NOT NULL),
pr AS (SELECT DISTINCT * FROM projects WHERE project_id IS NOT NULL),
nodes AS (SELECT concat('src/part_', CAST(p_partkey AS VARCHAR), '.py:function:', p_name) AS node_id, 'function' AS node_type, p_name AS name, concat('src/part_', CAST(p_partkey AS VARCHAR), '.py') AS file_path, p_size AS start_line, p_size + 10 AS end_line FROM part
  UNION ALL SELECT concat('src/supp_', CAST(s_suppkey AS VARCHAR), '.py:class:', s_name), 'class', s_name, concat('src/supp_', CAST(s_suppkey AS VARCHAR), '.py'), 1, 100 FROM supplier),
edges AS (SELECT DISTINCT concat('src/supp_', CAST(l_suppkey AS VARCHAR), '.py:class:', s_name) AS source_id, concat('src/part_', CAST(l_partkey AS VARCHAR), '.py:function:', p_name) AS target_id, 'calls' AS edge_type FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    """Registers a query, and its SQL on top of the base views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if base:
                body = BASE.strip() + (", " + body[4:].lstrip() if body[:5].upper() == "WITH " else "\n" + body)
            ORACLE[name] = body
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "chunks").where("chunk_id is not null"), ["chunk_id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("access_count")])


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "git_commits").where("commit_hash is not null").distinct()


def diffs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "git_diffs").where("id is not null").distinct()


def repeated_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Diffs with their repeated rows, for operators that take pairs of commit and path once anyway: contents stay unread."""
    return table(spark, d, "git_diffs").where("id is not null")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_metadata").where("project_id is not null and file_path is not null").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_chunks").where("project_id is not null and file_path is not null and chunk_id is not null").distinct()


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_sessions").where("session_id is not null").distinct()


def cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_cache").where("content_hash is not null").groupBy("content_hash", "model_name").agg(F.min("created_at").alias("created_at"), F.min("embedding").alias("embedding"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_runs").where("job_id is not null").distinct()


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").where("project_id is not null").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    pf = F.concat(F.lit("src/part_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    sf = F.concat(F.lit("src/supp_"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    a = p.select(F.concat(pf, F.lit(":function:"), "p_name").alias("node_id"), F.lit("function").alias("node_type"), F.col("p_name").alias("name"), pf.alias("file_path"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 10).cast("int").alias("end_line"))
    b = s.select(F.concat(sf, F.lit(":class:"), "s_name").alias("node_id"), F.lit("class").alias("node_type"), F.col("s_name").alias("name"), sf.alias("file_path"), F.lit(1).alias("start_line"), F.lit(100).alias("end_line"))
    return a.unionByName(b)


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.concat(F.lit("src/supp_"), F.col("l_suppkey").cast("string"), F.lit(".py:class:"), "s_name").alias("source_id"), F.concat(F.lit("src/part_"), F.col("l_partkey").cast("string"), F.lit(".py:function:"), "p_name").alias("target_id"), F.lit("calls").alias("edge_type")).distinct()


def commit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(commit_hash, vector): a vector for every commit, the test embedding whose number its time says."""
    e = table(spark, d, "embeddings")
    n = e.count()
    at = commits(spark, d).select("commit_hash", F.pmod("timestamp", F.lit(n)).alias("vec_id"))
    return at.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("commit_hash", "vector")


def us(c: str):
    return F.unix_micros(c)
