"""Rank fusion and diversification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import dot, normalize

RRF_K = 60
# What a kind of chunk gets on top.
BONUS = {"memory_bank": 0.05, "insight": 0.002}


def rrf(lexical: DataFrame, vectors: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(key, lex_rank, vec_rank, score): reciprocal ranks of two lists, added up by key. Keys of one list only stay."""
    both = lexical.select(key, "lex_rank", F.lit(None).cast("int").alias("vec_rank")).unionByName(vectors.select(key, F.lit(None).cast("int").alias("lex_rank"), "vec_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    ranks = both.groupBy(key).agg(F.min("lex_rank").alias("lex_rank"), F.min("vec_rank").alias("vec_rank"))
    return ranks.withColumn("score", F.round(part("lex_rank") + part("vec_rank"), 6))


def boost(fused: DataFrame, kind: str) -> DataFrame:
    """The score with the bonus of a row's kind."""
    bonus = F.lit(0.0)
    for name, plus in BONUS.items():
        bonus = F.when(F.col(kind) == name, plus).otherwise(bonus)
    return fused.withColumn("score", F.round(F.col("score") + bonus, 6))


def ranked(df: DataFrame, score: str, key: str, name: str, ascending: bool = True) -> DataFrame:
    """A rank by score over a list that was cut to a top k before."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), key)))


def mmr(candidates: DataFrame, key: str, vector: str, relevance: str, k: int, weight: float = 0.7) -> DataFrame:
    """(key, mmr_pos): k of a bounded list of candidates, each the best by weight * relevance - (1 - weight) * likeness to those before.

    A fold over one array: the list has at most a few hundred rows. Ties go to the more relevant, then to the smaller key.
    """
    rows = candidates.select(F.struct((-F.col(relevance)).alias("far"), F.col(key).alias("id"), normalize(F.col(vector)).alias("v"), F.col(relevance).cast("double").alias("rel")).alias("c"))
    pool = rows.agg(F.array_sort(F.collect_list("c")).alias("pool"))
    empty = F.slice("pool", 1, 0)

    def pick(done, i):
        left = F.filter("pool", lambda c: ~F.exists(done, lambda d: d["id"] == c["id"]))
        scored = F.transform(
            left,
            lambda c: F.struct(
                F.round(F.when(F.size(done) == 0, -c["rel"]).otherwise((1 - weight) * F.array_max(F.transform(done, lambda d: dot(d["v"], c["v"]))) - weight * c["rel"]), 9).alias("cost"),
                c["far"].alias("far"),
                c["id"].alias("id"),
                c.alias("c"),
            ),
        )
        return F.concat(done, F.transform(F.slice(F.array_sort(scored), 1, 1), lambda s: s["c"]))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, pick)
    return pool.select(F.posexplode(chosen).alias("mmr_pos", "c")).select(F.col("c.id").alias(key), (F.col("mmr_pos") + 1).alias("mmr_pos"))


def diversified(top: DataFrame, vectors: DataFrame, key: str, vector: str, score: str, chosen: int, limit: int) -> DataFrame:
    """(key, part, pos): of a bounded fused list `chosen` rows by `mmr` (part 0), then the others by score (part 1), up to `limit`.

    Rows without a vector can't be chosen and fill up behind.
    """
    best = mmr(top.join(vectors, key), key, vector, score, chosen)
    rest = top.join(best.select(key), key, "left_anti")
    both = best.select(key, F.lit(0).alias("part"), F.col("mmr_pos").cast("double").alias("pos")).unionByName(rest.select(key, F.lit(1).alias("part"), (-F.col(score)).alias("pos")))
    return both.orderBy("part", "pos", key).limit(limit).select(key, "part", F.round("pos", 6).alias("pos"))
