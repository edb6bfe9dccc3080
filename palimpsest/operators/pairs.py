"""Pairs of items of one record, however many items a record has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a block: a record with more is cut into blocks, and every two blocks meet in a group of their own.
BLOCK = 512


def pairs_within(rows: DataFrame, record: list[str], item: str, also: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(*record, item_a, item_b, *also_a, *also_b): all pairs item_a < item_b of the distinct rows of each record.

    Rows are one per record and item. A record of more than `block` items is dealt into blocks by hash; a row goes to
    as many groups as there are blocks, so that no task holds more than two blocks of a record. Null records and items pair with nothing.
    """
    also = also or []
    sizes = rows.groupBy(*record).agg(F.ceil(F.count("*") / block).cast("int").alias("__n")).where("__n > 1")
    dealt = rows.join(sizes, record, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    dealt = dealt.withColumn("__blk", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = dealt.withColumn("__lo", F.least("__blk", "__other")).withColumn("__hi", F.greatest("__blk", "__other"))
    at = [*record, "__lo", "__hi"]
    a = dealt.select(*at, F.col("__blk").alias("__ba"), F.col(item).alias(f"{item}_a"), *[F.col(c).alias(f"{c}_a") for c in also])
    b = dealt.select(*at, F.col("__blk").alias("__bb"), F.col(item).alias(f"{item}_b"), *[F.col(c).alias(f"{c}_b") for c in also])
    apart: Column = (F.col("__lo") == F.col("__hi")) | (F.col("__ba") != F.col("__bb"))
    return a.join(b, at).where((F.col(f"{item}_a") < F.col(f"{item}_b")) & apart).drop("__lo", "__hi", "__ba", "__bb")
