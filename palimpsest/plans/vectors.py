"""Queries over vectors, rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, vector
from ..session import table
from . import base as B
from .base import query
from .index import search, stored_cells
from .text import match_sql

DIM = 64
_GOOD = "v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DOT = f"round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6)"


def _query_vector(spark, d):
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def _long_rank(df):
    return df.withColumn("vec_rank", F.col("vec_rank").cast("long"))


@query("vec_normalize", f"""SELECT chunk_id, round(sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS norm, round(CAST(v[1] AS DOUBLE) / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS x_first, round(CAST(v[64] AS DOUBLE) / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS x_last
FROM (SELECT chunk_id, vector AS v FROM c) WHERE {_GOOD}""")
def vec_normalize(spark, d):
    rows = B.chunks(spark, d).where(vector.usable(F.col("vector"), DIM)).select("chunk_id", vector.norm(F.col("vector")).alias("n"), vector.normalize(F.col("vector")).alias("u"))
    return rows.select("chunk_id", F.round("n", 5).alias("norm"), F.round(F.col("u")[0], 5).alias("x_first"), F.round(F.col("u")[DIM - 1], 5).alias("x_last"))


_KNN = f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS vec_rank FROM (SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20)"


@query("knn_exact", _KNN)
def knn_exact(spark, d):
    return _long_rank(vector.knn_arrow(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20))


@query("knn_sharded", _KNN)
def knn_sharded(spark, d):
    return _long_rank(vector.knn_sharded(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20, 4))


@query("knn_ivf")
def knn_ivf(spark, d):
    """The cells are fitted once for a table and kept; a query reads those it looks into."""
    asked, cells = _query_vector(spark, d), stored_cells(spark, d, "embeddings", "vec_id", "embedding", DIM)
    if cells is None:
        return vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", asked, 20)
    return vector.knn_in_cells(*cells, "vec_id", "embedding", asked, 20)


@query("embed_hashing")
def embed_hashing(spark, d):
    return table(spark, d, "documents").select("doc_id", vector.hashing_embedder(DIM)("text").alias("embedding"))


_VECTORS = f"vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS vec_rank FROM (SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 200))"
_LEX = "lex AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS lex_rank FROM ({}))".format(match_sql("documents", "doc_id", "text", ["ranking", "cache", "vector"], "f0 > 0 OR f1 > 0 OR f2 > 0", 200))
_RRF = f"WITH {_LEX}, {_VECTORS}, fu AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, lex_rank, vec_rank, round(coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0), 6) AS score FROM lex l FULL JOIN vec v ON l.doc_id = v.doc_id)"
_BOOST = "round(fu.score + CASE WHEN kind = 'memory_bank' THEN 0.05 WHEN kind = 'insight' THEN 0.002 ELSE 0 END, 6)"


def _fused(spark, d, k=200):
    lex = fusion.ranked(search(spark, d, "documents", "ranking cache vector", "any", k), "score", "doc_id", "lex_rank")
    vec = vector.knn_arrow(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), k)
    return fusion.rrf(lex, vec.withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("rrf_fusion", _RRF + " SELECT doc_id, coalesce(lex_rank, 0) AS lex_rank, coalesce(vec_rank, 0) AS vec_rank, score FROM fu")
def rrf_fusion(spark, d):
    rank = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return _fused(spark, d).select("doc_id", rank("lex_rank"), rank("vec_rank"), "score")


@query("rrf_boost", _RRF + f" SELECT fu.doc_id, {_BOOST} AS score FROM fu JOIN documents dd ON dd.doc_id = fu.doc_id")
def rrf_boost(spark, d):
    both = _fused(spark, d).join(table(spark, d, "documents").select("doc_id", "kind"), "doc_id")
    return fusion.boost(both, "kind").select("doc_id", "score")


@query("hybrid_search", _RRF + f" SELECT fu.doc_id, {_BOOST} AS score FROM fu JOIN documents dd ON dd.doc_id = fu.doc_id ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_search(spark, d):
    return rrf_boost(spark, d).orderBy(F.desc("score"), "doc_id").limit(10)


def _mmr_sql(cand: str, key: str, k: int = 3) -> str:
    """MMR unrolled for `cand`, the SQL of rows (key, rel, e): k CTEs s1, s2, ... and `chosen` (key, mmr_pos)."""
    sim = "list_inner_product(x.u, y.u)"
    out = [f"raw AS ({cand}), cand AS (SELECT {key}, rel, list_transform(e, lambda a: a / sqrt(list_inner_product(e, e))) AS u FROM raw), s1 AS (SELECT * FROM cand ORDER BY rel DESC, {key} LIMIT 1)"]
    done = ["SELECT * FROM s1"]
    for i in range(2, k + 1):
        prior = " UNION ALL ".join(done)
        out.append(f"s{i} AS (SELECT x.{key}, x.rel, x.u FROM cand x, ({prior}) y WHERE x.{key} NOT IN (SELECT {key} FROM ({prior})) GROUP BY x.{key}, x.rel, x.u ORDER BY round(0.3 * max({sim}) - 0.7 * x.rel, 9), x.rel DESC, x.{key} LIMIT 1)")
        done.append(f"SELECT * FROM s{i}")
    return ", ".join(out) + ", chosen AS (" + " UNION ALL ".join(f"SELECT {key}, CAST({i} AS BIGINT) AS mmr_pos FROM s{i}" for i in range(1, k + 1)) + ")"


_TOP = f"top AS (SELECT fu.doc_id, {_BOOST} AS score FROM fu JOIN documents dd ON dd.doc_id = fu.doc_id ORDER BY score DESC, doc_id LIMIT 50)"
_CAND = "SELECT top.doc_id, score AS rel, CAST(embedding AS DOUBLE[]) AS e FROM top JOIN embeddings ON vec_id = top.doc_id"


@query("hybrid_search_mmr", f"{_RRF}, {_TOP}, {_mmr_sql(_CAND, 'doc_id')} SELECT doc_id, part, pos FROM (SELECT doc_id, 0 AS part, CAST(mmr_pos AS DOUBLE) AS pos FROM chosen UNION ALL SELECT doc_id, 1, -score FROM top WHERE doc_id NOT IN (SELECT doc_id FROM chosen)) ORDER BY part, pos, doc_id LIMIT 10")
def hybrid_search_mmr(spark, d):
    """Of the 50 best fused three chosen for relevance and difference, then the others in their order, up to ten."""
    top = rrf_boost(spark, d).orderBy(F.desc("score"), "doc_id").limit(50)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return fusion.diversified(top, vectors, "doc_id", "embedding", "score", 3, 10)


@query("mmr_rerank", "WITH " + _mmr_sql(f"SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_DOT} AS rel FROM embeddings ORDER BY rel DESC, vec_id LIMIT 10", "vec_id") + " SELECT * FROM chosen")
def mmr_rerank(spark, d):
    e = table(spark, d, "embeddings")
    top = vector.knn_arrow(e, "vec_id", "embedding", _query_vector(spark, d), 10)
    chosen = fusion.mmr(top.join(e.select("vec_id", "embedding"), "vec_id"), "vec_id", "embedding", "score", 3)
    return chosen.select("vec_id", F.col("mmr_pos").cast("long").alias("mmr_pos"))


# The embedding memo.
@query("embedding_cache_hits", "SELECT DISTINCT c.chunk_id, ec.model_name FROM c JOIN ec ON ec.content_hash = sha256(c.content) WHERE ec.model_name IS NOT NULL AND c.content IS NOT NULL")
def embedding_cache_hits(spark, d):
    c = B.chunks(spark, d).where("content is not null").select("chunk_id", F.sha2("content", 256).alias("content_hash"))
    return c.join(B.cache(spark, d).where("model_name is not null").select("content_hash", "model_name"), "content_hash").select("chunk_id", "model_name").distinct()


@query("embedding_cache_misses", "SELECT DISTINCT sha256(content) AS content_hash FROM c WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT content_hash FROM ec)")
def embedding_cache_misses(spark, d):
    c = B.chunks(spark, d).where("content is not null").select(F.sha2("content", 256).alias("content_hash")).distinct()
    return c.join(B.cache(spark, d), "content_hash", "left_anti")


@query("vectors_missing", f"SELECT chunk_id FROM (SELECT chunk_id, vector AS v FROM c) WHERE NOT coalesce({_GOOD}, false)")
def vectors_missing(spark, d):
    return B.chunks(spark, d).where(~vector.usable(F.col("vector"), DIM)).select("chunk_id")


@query("vectors_resolved", f"""WITH k AS (SELECT content_hash, min(v) AS v FROM (SELECT content_hash, embedding AS v FROM embedding_cache WHERE content_hash IS NOT NULL) WHERE {_GOOD} GROUP BY 1),
o AS (SELECT chunk_id, content, v, coalesce({_GOOD}, false) AS ok FROM (SELECT chunk_id, content, vector AS v FROM c))
SELECT chunk_id, CASE WHEN ok THEN 'own' WHEN k.v IS NOT NULL THEN 'cache' ELSE 'none' END AS source, round(CAST(CASE WHEN ok THEN o.v[1] ELSE k.v[1] END AS DOUBLE), 5) AS x_first FROM o LEFT JOIN k ON NOT ok AND k.content_hash = sha256(o.content)""")
def vectors_resolved(spark, d):
    """The vector of every chunk: its own, or that of its content in the memo."""
    cache = table(spark, d, "embedding_cache").where("content_hash is not null")
    rows = vector.resolved(B.chunks(spark, d), "chunk_id", "vector", "content", cache, DIM)
    return rows.select("chunk_id", "source", F.round(F.col("vec")[0].cast("double"), 5).alias("x_first"))
