"""Near-duplicate texts: an exact similarity self-join with pivot distance tables.

Texts with one set of shingles are one class. A class's fingerprint has a bit for
every shingle, so the Hamming distance of two fingerprints is the size of their sets' symmetric
difference. The space of shingles is dealt into buckets by hash, and every union of buckets is a
reference fingerprint. A class's distances to all of them follow from its counts in the buckets, which
are the pivot table: the difference of two classes' distances to a union U and to the rest is the difference of
their counts inside U less that outside. Of all references the one that takes each bucket on the side where the counts differ
has the maximum coordinate difference, the sum over the buckets of |count - count'|. By the triangle inequality a
pair for which it exceeds the distance that its threshold allows is no link, and is discarded without being looked at.

The table alone would have to be held against every pair, so pairs come from an
exact prefix index: with shingles in one global order, rare ones first, two sets
above the threshold share one among the first few of each. The order uses counts
over all texts, in as many buckets as fit a bounded table; it affects cost, never
results. The table discards pairs where the index joins them, survivors are verified on their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .shingles import Shingles, mix, shingles

#: Buckets of the pivot table, in longs of sixteen counts each; a count of more than 15 is one of 15, which only lowers differences.
LONGS, PER_LONG = 2, 16
#: Classes that a task remembers having posted.
POSTED = 1 << 18
#: Buckets of shingle counts, as powers of two: four per row within these.
MIN_BUCKETS, MAX_BUCKETS = 12, 18
#: Postings of a shingle beyond which they are cut into blocks.
HOT = 2_000


def pivot_table(s: Shingles) -> list[np.ndarray]:
    """The counts of each text's shingles in the buckets of the references, four bits each in LONGS longs."""
    m = LONGS * PER_LONG
    bucket = (mix(s.hash ^ np.uint64(0x5BD1E995)) >> np.uint64(40)).astype(np.int64) % m
    n = len(s.docs)
    counts = np.minimum(np.bincount(s.doc * m + bucket, minlength=n * m).reshape(n, m), 15).astype(np.uint64)
    out = []
    for i in range(LONGS):
        packed = np.zeros(n, np.uint64)
        for j in range(PER_LONG):
            packed |= counts[:, i * PER_LONG + j] << np.uint64(4 * j)
        out.append(packed.view(np.int64))
    return out


def apart(a: list[Column], b: list[Column]) -> Column:
    """The maximum coordinate difference of two rows of the pivot table."""
    count = lambda c, j: F.shiftrightunsigned(c, 4 * j).bitwiseAND(15)
    return reduce(lambda x, y: x + y, [F.abs(count(x, j) - count(y, j)) for x, y in zip(a, b) for j in range(PER_LONG)])


def _need(n: np.ndarray, share: Fraction) -> np.ndarray:
    """ceil(n * share) in whole numbers."""
    return -(-n * share.numerator // share.denominator)


class _Fresh:
    """Which classes a task meets for the first time, as far as it remembers."""

    def __init__(self):
        self.met: set[int] = set()

    def __call__(self, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), bool)
        for i, c in enumerate(cls.tolist()):
            if c not in self.met:
                self.met.add(c)
                out[i] = True
        if len(self.met) > POSTED:
            self.met.clear()
        return out


def bucket_counts(texts: DataFrame, width: int, min_tokens: int, bits: int) -> np.ndarray:
    """Texts holding a shingle of each bucket, over all texts, those of a class once in a task; 2**bits numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fresh = np.zeros(1 << bits, np.int64), _Fresh()
        for b in batches:
            s = shingles(b.column(0), width, min_tokens)
            if len(s.docs):
                total += np.bincount((s.hash[fresh(s.cls())[s.doc]] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65536].astype(np.int32)), pa.array(total[at[i : i + 65536]])], ["bucket", "n"])

    found = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def near_classes(df: DataFrame, key: str, text: str, threshold: float | str = "0.8", width: int = 5, min_tokens: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (key, cls, n) for every text with shingles, links (a, b) for every pair of different classes at or above the threshold.

    Null and empty texts, texts below `min_tokens` and null keys are in neither; repeated rows are one; rows that
    share a key are taken with their first text. A text equal to millions of others is one class here.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    far = [f"far{i}" for i in range(LONGS)]
    t = Fraction(str(threshold))
    both = t / (1 + t)  # of both sizes together, the part that two sets must share
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0")
    kind = rows.schema["key"].dataType.simpleString()
    bits = int(min(max(MIN_BUCKETS, math.ceil(math.log2(max(1, df.count()))) + 2), MAX_BUCKETS))
    held = spark.sparkContext.broadcast(bucket_counts(rows.select("text"), width, min_tokens, bits))  # 2**MAX_BUCKETS numbers at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shingles(b.column(1), width, min_tokens)
            if not len(s.docs):
                continue
            ends = np.concatenate([[0], np.cumsum(s.size)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s.docs)), pa.array(s.cls()), pa.array(s.size.astype(np.int32)), sets], ["key", "cls", "n", "items"])

    hot = HOT

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fresh = held.value, _Fresh()
        for b in batches:
            s = shingles(b.column(0), width, min_tokens)
            if not len(s.docs):
                continue
            cls, tables = s.cls(), pivot_table(s)
            bucket = (s.hash >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((s.hash, seen[bucket], s.doc))
            doc = s.doc[order]
            begin = np.concatenate([[0], np.cumsum(s.size)[:-1]])
            pos = np.arange(len(doc)) - begin[doc]
            n = s.size[doc]
            # A class met before in this task has posted already; the rest of its copies go at the distinct.
            at = (pos < n - _need(n, t) + 1) & fresh(cls)[doc]
            doc, pos, n, h = doc[at], pos[at], n[at], s.hash[order][at]
            # Postings of a shingle that may have many are dealt into blocks: each goes to a group (lo, hi) for its own and every other one.
            blocks = np.maximum(1, -(-seen[bucket[order][at]].astype(np.int64) // hot))
            blk = (mix(cls[doc].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(doc)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.minimum(blk[row], other), np.maximum(blk[row], other)
            for i in range(0, len(row), 100_000):
                c, r = slice(i, i + 100_000), row[i : i + 100_000]
                indexed = pos[r] < n[r] - _need(2 * n[r], both) + 1
                ints = [pa.array(x.astype(np.int32)) for x in (lo[c], hi[c], blk[r])]
                yield pa.RecordBatch.from_arrays([pa.array(h[r].view(np.int64)), *ints, pa.array(cls[doc[r]]), pa.array(n[r].astype(np.int32)), pa.array(pos[r].astype(np.int32)), pa.array(indexed), *[pa.array(x[doc[r]]) for x in tables]], ["h", "lo", "hi", "blk", "cls", "n", "pos", "ix", *far])

    signed = cut(rows.mapInArrow(sign, f"key {kind}, cls long, n int, items array<long>"))
    members = signed.select("key", "cls", "n").dropDuplicates(["key"])
    # One shuffle, by shingle and blocks, serves the distinct and both sides of the join.
    kinds = ", ".join(f"{c} long" for c in far)
    posts = rows.select("text").mapInArrow(post, f"h long, lo int, hi int, blk int, cls long, n int, pos int, ix boolean, {kinds}").repartition("h", "lo", "hi").distinct()
    pairs = _meet(posts, both).distinct()
    sets = signed.select("cls", "n", "items").dropDuplicates(["cls"])
    num, den = both.numerator, both.denominator
    pairs = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")), "a")
    pairs = pairs.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    links = pairs.where(shared * den >= (F.col("na") + F.col("nb")) * num).select("a", "b")
    return members, links


def _meet(posts: DataFrame, both: Fraction) -> DataFrame:
    """(a, b): the pairs of postings of a group that neither sizes nor positions nor the pivot table rule out."""
    far = [f"far{i}" for i in range(LONGS)]
    on = ["h", "lo", "hi"]
    names = {"cls": "", "n": "n", "pos": "p", "ix": "ix", "blk": "blk", **{c: c for c in far}}
    small = posts.select(*on, *[F.col(c).alias(x + "b") for c, x in names.items()])
    large = posts.select(*on, *[F.col(c).alias(x + "a") for c, x in names.items() if c != "ix"])
    num, den = both.numerator, both.denominator
    total = F.col("na") + F.col("nb")
    # What is shared lies at or after the positions of the first common shingle, and is `both` of the total at least.
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # Told of both sides, the index flag stays above the shuffle, which else would be done once for each.
    cond = (F.col("ixb") | (F.col("na") < 0)) & (F.struct("nb", "b") < F.struct("na", "a")) & ((F.col("lo") == F.col("hi")) | (F.col("blka") != F.col("blkb"))) & (room * den >= total * num)
    cond = cond & ((total - apart([F.col(f"{c}a") for c in far], [F.col(f"{c}b") for c in far])) * den >= total * num * 2)
    return large.join(small, on).where(cond).select("a", "b")


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): all pairs of different keys in one class or in two linked ones, the smaller key first."""
    links = cut(links)
    left = members.select(F.col("cls").alias("a"), F.col("key").alias("ka"))
    right = members.select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    across = links.join(left, "a").join(right, "b").select("ka", "kb")
    within = left.join(right, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb")
    return across.unionByName(within).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, cls, grp, links): for every member its class, the smallest class its links reach, and the classes linked to its own."""
    links = cut(links)
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = edges.groupBy("a").count().select(F.col("a").alias("cls"), F.col("count").alias("links"))
    state = cut(edges.select(F.col("a").alias("v")).distinct().withColumn("grp", F.col("v")))
    while True:  # each round takes the smallest group of the neighbours, then that group's own group
        near = edges.join(state.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("grp").alias("other"))
        step = state.join(near, "v").select("v", F.col("grp").alias("old"), F.least("grp", "other").alias("grp"))
        roots = step.select(F.col("v").alias("grp"), F.col("grp").alias("root"))
        step = cut(step.join(roots, "grp").select("v", "old", F.least("grp", "root").alias("grp")))
        if step.where("grp <> old").isEmpty():
            break
        state = step.select("v", "grp")
    out = members.join(step.select(F.col("v").alias("cls"), "grp"), "cls", "left").join(degree, "cls", "left")
    return out.select("key", "cls", F.coalesce("grp", "cls").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
