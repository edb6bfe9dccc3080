"""The pN_ queries of this subpackage over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import cutting, encode, langid, neardup, neighbors, pack, provenance, secrets, together

DIM = 64


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, line_no, start, end): where each secret value stands; rows that repeat are one record."""
    chunks = secrets.find(table(spark, d, "chunks"), "chunk_id", "content").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), "line_no", "start", "end")
    diffs = secrets.find(table(spark, d, "git_diffs"), "id", "diff_content").select(F.lit("git_diffs").alias("tbl"), F.col("id").alias("row_id"), "line_no", "start", "end")
    return chunks.unionByName(diffs).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_spans(spark, d).select("tbl", "row_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = secrets.redacted(table(spark, d, "chunks"), "chunk_id", "content").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), F.col("content").alias("text"), "n_secrets")
    diffs = secrets.redacted(table(spark, d, "git_diffs"), "id", "diff_content").select(F.lit("git_diffs").alias("tbl"), F.col("id").alias("row_id"), F.col("diff_content").alias("text"), "n_secrets")
    return chunks.unionByName(diffs).dropDuplicates(["tbl", "row_id"])


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(table(spark, d, "file_metadata"), table(spark, d, "file_chunks"), table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_labels(spark, d).where("label <> 'handwritten'").select("project_id", "file_path")


def _near_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_classes(table(spark, d, "chunks"), "chunk_id", "content", "0.7", width=3, min_tokens=30)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(*_near_chunks(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_near_chunks(spark, d)).withColumnRenamed("key", "chunk_id")


def p5_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, vec): the usable vector of each chunk, its own or else that of its content in the cache."""
    good = lambda c: (F.size(c) == DIM) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    chunks = table(spark, d, "chunks").select("chunk_id", "content", "vector").where("chunk_id is not null")
    own = chunks.where(good(F.col("vector"))).select("chunk_id", F.col("vector").alias("vec"))
    lack = chunks.where(~F.coalesce(good(F.col("vector")), F.lit(False))).where("content is not null").select("chunk_id", F.sha2("content", 256).alias("content_hash"))
    cache = table(spark, d, "embedding_cache").where(good(F.col("embedding"))).groupBy("content_hash").agg(F.min("embedding").alias("vec"))
    found = lack.join(cache, "content_hash").select("chunk_id", "vec").join(own.select("chunk_id"), "chunk_id", "left_anti")
    return own.unionByName(found)


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(p5_vectors(spark, d), "chunk_id", "vec", 5, DIM)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = p5_neighbors(spark, d)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, project_id, record, item) of searches and commits, a row for each item: no record is collected."""
    found = table(spark, d, "search_sessions").select(F.lit("search_sessions").alias("tbl"), "project_id", F.col("session_id").alias("record"), F.explode("result_chunk_ids").alias("item"))
    diffs = table(spark, d, "git_diffs").where("commit_hash is not null").select("commit_hash", "project_id", F.col("file_path").alias("item"))
    other = diffs.groupBy("commit_hash").agg(F.max("project_id").alias("other"))
    commits = table(spark, d, "git_commits").where("commit_hash is not null").groupBy("commit_hash").agg(F.max("project_id").alias("own"))
    owner = other.join(commits, "commit_hash", "left").select("commit_hash", F.coalesce("own", "other").alias("project_id"))
    rows = diffs.select("commit_hash", "item").join(owner, "commit_hash").select(F.lit("git_diffs").alias("tbl"), "project_id", F.col("commit_hash").alias("record"), "item")
    return found.unionByName(rows)


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return together.together(_baskets(spark, d), ["tbl", "project_id"], "record", "item", 4, 3.0)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("tbl", "project_id", "item_a", "item_b")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.split_oversized(table(spark, d, "chunks"), "chunk_id", "content")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("piece_no = 0").select("chunk_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(encode.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "size")


def p9_certificates(spark: SparkSession, d: str) -> DataFrame:
    """The containers and lower bounds of every partition of the packing, and of all of it."""
    return pack.pack_certified(encode.count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "size")[1]


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.detect(table(spark, d, "documents"), "doc_id", "text", "lang", table(spark, d, "lang_codes"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(cut(p10_segments(spark, d)), "doc_id")


def queries():
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and name != "p5_vectors"}


ORACLE = {
    "p4_found": r"""
WITH t AS (SELECT chunk_id, regexp_extract_all(any_value(content), '[^ \t\n\r\f\x0B]+') AS w FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], chr(10), w[i + 1], chr(10), w[i + 2]))) AS g FROM t WHERE len(w) >= 30),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 10 * c >= 7 * (x.n + y.n - c)""",
    "p6_found": """
WITH b AS (
  SELECT DISTINCT 'search_sessions' AS tbl, project_id, session_id AS rec, i.x AS item
  FROM search_sessions, unnest(result_chunk_ids) AS i(x) WHERE i.x IS NOT NULL AND session_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'git_diffs', coalesce(c.project_id, d.other), d.commit_hash, d.file_path
  FROM (SELECT commit_hash, file_path, max(project_id) OVER (PARTITION BY commit_hash) AS other FROM git_diffs) d
  LEFT JOIN (SELECT commit_hash, max(project_id) AS project_id FROM git_commits GROUP BY 1) c USING (commit_hash)
  WHERE d.commit_hash IS NOT NULL AND d.file_path IS NOT NULL),
n AS (SELECT tbl, project_id, count(DISTINCT rec) AS n FROM b GROUP BY 1, 2),
k AS (SELECT tbl, project_id, item, count(*) AS n_item FROM b GROUP BY 1, 2, 3),
ab AS (SELECT x.tbl, x.project_id, x.item AS item_a, y.item AS item_b, count(*) AS n_ab
  FROM b x JOIN b y ON x.tbl = y.tbl AND x.project_id IS NOT DISTINCT FROM y.project_id AND x.rec = y.rec AND x.item < y.item GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4)
SELECT ab.tbl, ab.project_id, item_a, item_b FROM ab
JOIN n ON n.tbl = ab.tbl AND n.project_id IS NOT DISTINCT FROM ab.project_id
JOIN k ka ON ka.tbl = ab.tbl AND ka.project_id IS NOT DISTINCT FROM ab.project_id AND ka.item = item_a
JOIN k kb ON kb.tbl = ab.tbl AND kb.project_id IS NOT DISTINCT FROM ab.project_id AND kb.item = item_b
WHERE n_ab * n.n >= 3 * ka.n_item * kb.n_item""",
    "p6_pairs": """@P6@
SELECT ab.tbl, ab.project_id, item_a, item_b, n.n, ka.n_item AS n_a, kb.n_item AS n_b, n_ab, n_ab * n.n / (ka.n_item * kb.n_item) AS lift, (n_ab + 0.5) * (n.n - ka.n_item - kb.n_item + n_ab + 0.5) / ((ka.n_item - n_ab + 0.5) * (kb.n_item - n_ab + 0.5)) AS odds_ratio FROM ab""",
    "p7_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(content, '[^ \t\n\r\f\x0B]+')) > 400",
}


_WITH, _FROM = ORACLE["p6_found"].split("\nSELECT ab.tbl, ab.project_id, item_a, item_b FROM ab\n")
ORACLE["p6_pairs"] = ORACLE["p6_pairs"].replace("@P6@", _WITH) + "\n" + _FROM


def oracle_sql():
    return dict(ORACLE)
