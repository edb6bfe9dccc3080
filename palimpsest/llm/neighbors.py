"""The k most similar vectors of every vector through a permutation index.

Pivots are fitted on a bounded sample. A vector is represented by the ordered
list of its nearest pivots and posted, with its rank, in the inverted file of
each. A query looks into the whole files of its own pivots, however long they are, ranks what is posted there by footrule
distance between the truncated permutations, and reranks the nearest by exact cosine.

Equal vectors are one class, so copies are never paired with each other in the
files; their rows come back when the classes' lists are expanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

#: Rows that the pivots are fitted on, at most.
SAMPLE = 20_000
#: Pivots: PIVOTS_PER_ROOT * sqrt(vectors), between MIN_PIVOTS and MAX_PIVOTS.
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 2.0, 16, 8192
#: Pivots in a permutation, and how many of them a vector is posted under.
PERMUTATION, POSTED = 64, 4
#: Candidates of a query in one file, nearest by footrule, that are reranked by cosine: RERANK times k, and SHARE of the file at least.
RERANK, SHARE = 24, 0.6
#: Queries of one block of an inverted file; a longer file's queries are cut into blocks, each of which meets the whole file.
BLOCK = 2048
#: Postings up to which 64 queries at least are compared with a file at once; the longer it is, the fewer. No result depends on it.
SPLIT = 32_768
#: Decimals of a cosine: what is equal in them is a tie, settled by key.
DECIMALS = 12

def normed(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def fit_pivots(sample: np.ndarray, m: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """m unit pivots by spherical k-means on a sample."""
    rng = np.random.default_rng(seed)
    pivots = sample[rng.choice(len(sample), m, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ pivots.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        has = np.linalg.norm(sums, axis=1) > 1e-9
        pivots[has] = sums[has]
        pivots = normed(pivots)
    return pivots


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, unordered."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (score.shape[0], 1))
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def nearness(q_perm: np.ndarray, x_perm: np.ndarray) -> np.ndarray:
    """sum(min(w, w')) of the weights L - rank of pivots that permutations share; a row for each of q_perm.

    The footrule distance of truncated permutations, with absent pivots at rank
    L, is 2 * (sum(w) - sum(min(w, w'))): the larger this, the nearer.
    """
    size = q_perm.shape[1]
    local = np.unique(q_perm)  # only pivots that queries have can bring two permutations nearer
    at = np.searchsorted(local, x_perm)
    at[at == len(local)] = 0
    at[local[at] != x_perm] = len(local)  # a pivot no query has
    weights = np.zeros((len(q_perm), len(local) + 1), np.uint8)
    rows = np.arange(len(q_perm))
    for r in range(size):
        weights[rows, np.searchsorted(local, q_perm[:, r])] = size - r
    out = np.zeros((len(q_perm), len(x_perm)), np.int32)
    for r in range(size):
        out += np.minimum(weights[:, at[:, r]], np.uint8(size - r))
    return out.astype(np.int64)


def search_block(q_ids: np.ndarray, q_perm: np.ndarray, q_vec: np.ndarray, x_ids: np.ndarray, x_perm: np.ndarray, x_vec: np.ndarray, k: int, rerank: int = RERANK, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of the best k + 1 of x for each q, x itself left out.

    Cosines are rounded to DECIMALS; among equal ones, of footrule or of cosine, the earlier row of x goes first.
    """
    n = len(x_ids)
    keep = max(rerank * k, math.ceil(share * n))
    # Batches bound the memory: of queries, and of those whose candidates' vectors are taken together.
    many, few = max(1, min(256, 64 * SPLIT // n)), max(1, min(64, 64 * BLOCK // keep))
    out = []
    for i in range(0, len(q_ids), many):
        ids, vec = q_ids[i : i + many], q_vec[i : i + many]
        if n > keep:
            near = _top(nearness(q_perm[i : i + many], x_perm) * n - np.arange(n), keep)
            cos = np.concatenate([np.einsum("qd,qkd->qk", vec[j : j + few], x_vec[near[j : j + few]]) for j in range(0, len(vec), few)])
            cand = x_ids[near]
        else:
            near = np.arange(n)
            cos = vec @ x_vec.T
            cand = np.broadcast_to(x_ids, cos.shape)
        # One integer of the rounded cosine and the row, so that the order is total.
        units = np.rint(np.clip(cos, -1, 1) * 10.0**DECIMALS).astype(np.int64)
        best = _top(np.where(cand == ids[:, None], -(1 << 62), units * n - near), k + 1)
        units, cand = np.take_along_axis(units, best, 1), np.take_along_axis(cand, best, 1)
        own = np.broadcast_to(ids[:, None], cand.shape)
        ok = cand != own
        out.append((own[ok], cand[ok], units[ok] / 10.0**DECIMALS))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dim: int | None = None, sample: int = SAMPLE, posted: int = POSTED, permutation: int = PERMUTATION) -> DataFrame:
    """(key, neighbour, rank, similarity): the k most similar other keys of every key.

    Similarity is the cosine in double precision, rounded to 12 decimals; ties go to the smaller
    key. Every usable vector is indexed and is a query; null, empty, non-finite and zero vectors,
    vectors of another length than `dim` (by default the commonest), and null keys are left out. Repeated
    keys count once, with their smallest vector. Fewer than k others give fewer rows, an empty table none.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    v = F.col(vector)
    usable = df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(F.col(key).alias("key"), v.alias("vec"))
    usable = usable.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    if dim is None:
        common = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = common["n"] if common else 1
    usable = usable.where(F.size("vec") == dim)
    rows = usable.groupBy("key").agg(F.min("vec").alias("vec"))
    # A class is a set of equal vectors, named by a 64-bit hash; its smallest k + 1 keys stand for it.
    rows = cut(rows.withColumn("cls", F.xxhash64("vec")))
    # Pre-aggregated: each task keeps the smallest k + 1 keys of a class, so that a hot class moves few rows.
    heads = _smallest_keys(rows, k + 1)
    classes = cut(rows.groupBy("cls").agg(F.first("vec").alias("vec"), F.min("key").alias("least")))
    n = classes.count()
    out_schema = "q long, x long, cos double"
    if n == 0:
        pairs = spark.createDataFrame([], out_schema)
    else:
        pairs = _search(classes, n, dim, k, sample, posted, permutation, out_schema)
    # The k nearest classes, by similarity and then by smallest key.
    pairs = pairs.withColumn("cos", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos")), DECIMALS)).groupBy("q", "x").agg(F.max("cos").alias("cos"))
    pairs = pairs.join(heads.withColumnRenamed("cls", "x"), "x")
    w = Window.partitionBy("q").orderBy(F.desc("cos"), F.col("keys")[0])
    pairs = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    own = heads.select(F.col("cls").alias("q"), F.lit(1.0).alias("cos"), "keys").where(F.size("keys") > 1)
    near = pairs.select("q", "cos", "keys").unionByName(own).select("q", F.explode(F.transform("keys", lambda x: F.struct((-F.col("cos")).alias("far"), x.alias("key")))).alias("c"))
    # Of each class the best k + 1 keys are enough: a member leaves itself out.
    lists = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("best"))
    out = rows.select("key", F.col("cls").alias("q")).join(lists, "q")
    out = out.select("key", F.slice(F.filter("best", lambda c: c["key"] != F.col("key")), 1, k).alias("best"))
    out = out.select("key", F.posexplode("best").alias("pos", "c"))
    return out.select(F.col("key").alias(key), F.col("c.key").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("c.far")).alias("similarity"))


def _smallest_keys(rows: DataFrame, k: int) -> DataFrame:
    """(cls, keys): the k smallest keys of each class, in order; cut down within each task first."""
    salted = Window.partitionBy("cls", "salt").orderBy("key")
    plain = Window.partitionBy("cls").orderBy("key")
    few = rows.select("cls", "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(plain)).where(F.col("r") <= k)
    return few.groupBy("cls").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def _search(classes: DataFrame, n: int, dim: int, k: int, sample: int, posted: int, permutation: int, schema: str) -> DataFrame:
    spark = classes.sparkSession
    share = min(1.0, sample / n)
    # A bounded sample by hash: the same rows at every run.
    some = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    base = normed(np.array([r[0] for r in some.select("vec").orderBy(F.xxhash64("cls")).limit(sample).collect()], np.float64))
    # One of each direction: of equal pivots a vector would be posted under any.
    base = base[~pd.DataFrame(base.round(6)).duplicated().to_numpy()]
    m = int(min(max(MIN_PIVOTS, PIVOTS_PER_ROOT * math.sqrt(n)), MAX_PIVOTS, len(base)))
    pivots = fit_pivots(base, m)
    size = min(permutation, m)
    store = np.float32 if classes.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
    posted = min(posted, size)
    held = spark.sparkContext.broadcast(pivots.astype(np.float32))  # MAX_PIVOTS vectors at most

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = normed(raw.astype(np.float64))
            score = v.astype(np.float32) @ p.T
            near = np.argpartition(-score, size - 1, axis=1)[:, :size] if size < len(p) else np.tile(np.arange(len(p)), (len(v), 1))
            order = np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable")
            perm = np.take_along_axis(near, order, 1).astype(np.int16 if len(p) < 32768 else np.int32)
            packed = [x.tobytes() for x in perm]
            stored = [x.tobytes() for x in raw.astype(store)]
            first = perm[:, :posted].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary()), pa.array(stored, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(first.ravel()), first.shape[1]).cast(pa.list_(pa.int32()))], ["cls", "least", "perm", "raw", "first"])

    least = classes.schema["least"].dataType.simpleString()
    index = cut(classes.select("cls", "vec", "least").mapInArrow(represent, f"cls long, least {least}, perm binary, raw binary, first array<int>"))
    # The queries of long files are cut into blocks; the whole file goes to each of them, as footrule keeps a share of the whole.
    lengths = {r[0]: r[1] for r in index.select(F.explode("first").alias("f")).groupBy("f").count().collect()}  # a row per pivot
    table = spark.createDataFrame([(i, max(1, math.ceil(lengths.get(i, 0) / BLOCK))) for i in range(m)], "f int, blocks int")
    posts = index.select("cls", "least", "perm", "raw", F.explode("first").alias("f")).join(F.broadcast(table), "f")  # MAX_PIVOTS rows at most
    posts = posts.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    kind = np.int16 if m < 32768 else np.int32

    def in_file(pdf: pd.DataFrame) -> pd.DataFrame:
        # Ties go to the class with the smallest key.
        pdf = pdf.sort_values("least", kind="stable", ignore_index=True)
        ids = pdf["cls"].to_numpy(np.int64)
        perm = np.frombuffer(b"".join(pdf["perm"]), kind).reshape(len(pdf), size)
        unit = normed(np.frombuffer(b"".join(pdf["raw"]), store).reshape(len(pdf), dim).astype(np.float64))
        isq = pdf["q"].to_numpy(bool)
        if not isq.any():
            return pd.DataFrame({"q": ids[:0], "x": ids[:0], "cos": np.zeros(0)})
        num = np.arange(len(pdf))
        # A row in both roles must be told from itself: the number of its id.
        _, code = np.unique(ids, return_inverse=True)
        first = np.zeros(code.max() + 1, np.int64)
        first[code] = num
        a, b, c = search_block(code[isq], perm[isq], unit[isq], code, perm, unit, k)
        return pd.DataFrame({"q": ids[first[a]], "x": ids[first[b]], "cos": c})

    # Every row is a posting in each block of its file, and a query in one.
    feed = posts.where("blocks = 1").select("f", "blk", "cls", "least", "perm", "raw", F.lit(True).alias("q"))
    if max(lengths.values()) > BLOCK:
        asx = posts.where("blocks > 1").select("f", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "blk", "cls", "least", "perm", "raw")
        feed = feed.unionByName(asx.select("f", F.col("to").alias("blk"), "cls", "least", "perm", "raw", (F.col("to") == F.col("blk")).alias("q")))
    return feed.groupBy("f", "blk").applyInPandas(in_file, schema)
