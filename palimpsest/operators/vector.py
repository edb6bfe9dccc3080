"""Exact and approximate nearest neighbours of a query vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Cells of an inverted file, and how many of them a query looks into: for a recall of 0.9. The reference looks into 16.
NLIST, NPROBE = 100, 64


def usable(v: Column, dim: int) -> Column:
    """Of the right length, finite and not all zero; false for null."""
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score, vec_rank): the k largest inner products, ties by key. A top-k per task, then of those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = df.where(usable(F.col(vector), len(query))).select(key, F.round(dot(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return found.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def knn_arrow(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """As `knn`, with one matrix product per Arrow batch and the batch's top k only leaving it."""
    ship(df.sparkSession)
    q = np.array(query, np.float64)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
            s = np.round(m @ q, 6)
            # All that tie with the k-th stay: ties are settled by key afterwards.
            at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s[at])], [key, "score"])

    rows = df.where(usable(F.col(vector), len(query))).select(key, vector).mapInArrow(run, f"`{key}` {kind}, score double")
    found = rows.orderBy(F.desc("score"), key).limit(k)
    return found.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def knn_sharded(df: DataFrame, key: str, vector: str, query: list[float], k: int, shards: int) -> DataFrame:
    """The k best of each shard (key modulo shards), merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.where(usable(F.col(vector), len(query))).select(key, F.pmod(F.col(key), F.lit(shards)).alias("shard"), F.round(dot(F.col(vector), q), 6).alias("score"))
    w = Window.partitionBy("shard").orderBy(F.desc("score"), key)
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, "score", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("vec_rank"))


def shard_count(n: int, threshold: int = 1_000_000, size: int = 250_000) -> int:
    """1 below the threshold, else as many as hold `size` each."""
    return 1 if n < threshold else -(-n // size)


def shards(n: Column, threshold: int = 1_000_000, size: int = 250_000) -> Column:
    """`shard_count` of a column of counts."""
    return F.when(n < threshold, 1).otherwise(F.ceil(n / size)).cast("long")


def ivf_cells(df: DataFrame, key: str, vector: str, dim: int, nlist: int = NLIST, sample: int = 20_000, seed: int = 3) -> tuple[DataFrame, np.ndarray] | None:
    """Usable rows with their cell in `prediction`, and the cells' centres, fitted on a bounded sample; None without rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(usable(F.col(vector), dim)).select(key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = rows.count()
    nlist = max(1, min(nlist, n // 10))
    if n == 0:
        return None
    part = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    model = KMeans(k=nlist, maxIter=8, seed=seed).fit(part)
    return model.transform(rows), np.array(model.clusterCenters())


def knn_ivf(df: DataFrame, key: str, vector: str, query: list[float], k: int, nlist: int = NLIST, nprobe: int = NPROBE, sample: int = 20_000, seed: int = 3) -> DataFrame:
    """The k best among the cells nearest to the query; cells are fitted on a bounded sample, every row is indexed."""
    cells = ivf_cells(df, key, vector, len(query), nlist, sample, seed)
    return knn(df, key, vector, query, k) if cells is None else knn_in_cells(*cells, key, vector, query, k, nprobe)


def knn_in_cells(rows: DataFrame, centres: np.ndarray, key: str, vector: str, query: list[float], k: int, nprobe: int = NPROBE) -> DataFrame:
    """The k best of rows with their cell in `prediction`, among the cells whose centres are nearest to the query; only those are read."""
    probe = np.argsort(-(centres @ np.array(query)))[:nprobe].tolist()
    return knn(rows.where(F.col("prediction").isin(probe)), key, vector, query, k)


def hashing_embedder(dim: int = 64):
    """A deterministic offline embedder: signed token hashes, normalised. Null and blank texts give zeros.

    Works on whole Arrow batches: each different token of a batch is hashed once, all texts are summed up at once.
    """
    import pandas as pd

    def embed(texts: pd.Series) -> pd.Series:
        import xxhash

        parts = [(t or "").lower().split() for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        code, words = pd.factorize(np.array([w for p in parts for w in p], object))
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        at, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(owner * dim + at[code], sign[code], len(parts) * dim).reshape(len(parts), dim) if len(code) else np.zeros((len(parts), dim))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(norms == 0, 1, norms)))

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(embed, "array<double>")


def resolved(rows: DataFrame, key: str, vector: str, text: str, cache: DataFrame, dim: int) -> DataFrame:
    """(key, vec, source): the usable vector of each row: its own, else that of its text in `cache` (content_hash, embedding), else none.

    Only rows without a vector of their own are joined. Of several usable vectors of a text the smallest counts; a key has one row.
    """
    own = rows.select(F.col(key).alias(key), F.col(vector).alias("__v"), F.col(text).alias("__t"), usable(F.col(vector), dim).alias("__ok"))
    mine = own.where("__ok").select(key, F.col("__v").alias("vec"), F.lit("own").alias("source"))
    known = cache.where(usable(F.col("embedding"), dim)).groupBy("content_hash").agg(F.min("embedding").alias("vec"))
    lack = own.where(~F.col("__ok")).select(key, F.sha2("__t", 256).alias("content_hash")).join(known, "content_hash", "left")
    return mine.unionByName(lack.select(key, "vec", F.when(F.col("vec").isNotNull(), "cache").otherwise("none").alias("source")))
