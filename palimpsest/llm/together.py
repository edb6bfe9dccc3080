"""Items that appear together: an external sort of packed pair codes.

Items that can be in a result at all get dense numbers in their order, from the start again in each group, so a pair
is one 64-bit code of its group. Tasks turn records into codes, sort them in bounded runs and
run-length count each run; Spark range-partitions the runs' counts, sorts
them with spill and the merged runs are counted once more. Association measures
follow from the counts; the odds ratio has the Haldane-Anscombe correction.

An item below the support, or in more than 1/lift of its group's records, is in
no result whatever it meets (n_ab <= n_a and n_ab <= n_b), so it is left out
before pairs are made; this drops no case and bounds hot items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import numbered
from ..session import cut, ship

#: Codes of one sorted run in a task's memory: 32 MB of them.
RUN = 4_000_000
#: Items of a block: a record with more is cut into pairs of blocks, spread over tasks.
BLOCK = 256


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, left, right) blocks of item numbers to (gid, code, n) of sorted runs."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush():
        gid = np.repeat(np.array([g for g, _ in held], np.int64), [len(c) for _, c in held])
        codes = np.concatenate([c for _, c in held])
        order = np.lexsort((codes, gid))
        gid, codes = gid[order], codes[order]
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (gid[1:] != gid[:-1])]))
        counts = np.diff(np.append(first, len(codes)))
        for i in range(0, len(first), 100_000):
            at = first[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(gid[at]), pa.array(codes[at]), pa.array(counts[i : i + 100_000])], ["gid", "code", "n"])

    for b in batches:
        gids, left, right = b.column(0).to_numpy(), b.column(1), b.column(2)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(), right.values.to_numpy()
        for i in range(b.num_rows):
            x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
            if x[0] == y[0]:  # a block with itself, in order
                p, q = np.triu_indices(len(x), 1)
                codes = (x[p] << 32) | x[q]
            else:
                codes = ((np.minimum.outer(x, y) << 32) | np.maximum.outer(x, y)).ravel()
            if len(codes):
                held.append((int(gids[i]), codes))
                size += len(codes)
            if size >= RUN:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (gid, code, n) rows to one row per gid and code."""
    last, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g, c, n = (b.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (g[1:] != g[:-1])]))
        gids, codes, sums = g[starts], c[starts], np.add.reduceat(n, starts)
        if last is not None:
            if (gids[0], codes[0]) == last:
                sums[0] += count
            else:
                gids, codes, sums = np.concatenate([[last[0]], gids]), np.concatenate([[last[1]], codes]), np.concatenate([[count], sums])
        last, count = (gids[-1], codes[-1]), sums[-1]
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(gids[:-1]), pa.array(codes[:-1]), pa.array(sums[:-1])], ["gid", "code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([count], pa.int64())], ["gid", "code", "n"])


def together(records: DataFrame, group: list[str], record: str, items: str, min_count: int = 4, min_lift: float = 3.0) -> DataFrame:
    """Pairs of items with their counts and association, by group.

    `records` has rows of a record and an item, or of a record and an array of items; a record may have any number of rows. Columns out:
    group, item_a < item_b (by code points), n, n_a, n_b, n_ab, lift, odds_ratio;
    rows with n_ab >= min_count and n_ab * n >= min_lift * n_a * n_b. Null items
    and repeated ones count once or not at all; records without items count nowhere; null
    groups are a group of their own; rows with a null record are left out. Records are told apart by 128 bits of hash.
    A group of 2**31 items that can be in a result is an error.
    """
    ship(records.sparkSession)
    g = [f"g{i}" for i in range(len(group))]
    many = records.schema[items].dataType.typeName() == "array"
    rows = records.where(F.col(record).isNotNull()).select(*[F.col(c).alias(a) for c, a in zip(group, g)], F.col(record).alias("rec"), (F.explode(items) if many else F.col(items)).alias("item"))
    rows = cut(rows.where("item is not null").distinct())
    totals = rows.select(*g, "rec").distinct().groupBy(*g).agg(F.count("*").alias("n"))
    totals = cut(numbered(totals, g, "gid"))
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in g]
    counts = rows.groupBy(*g, "item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= min_count)
    counts = counts.alias("c").join(totals.alias("t"), same("c", "t")).select("c.*", "t.n", "t.gid").where(F.col("n") >= F.lit(min_lift) * F.col("n_item"))
    known = cut(numbered(counts, ["item"], "num", -1, ["gid"]))
    if (known.agg(F.max("num")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more items in a group than a packed code can hold")
    # From here on a record is two hashes of its id beside its group's number, and an item its number.
    tagged = rows.alias("r").join(known.select(*g, "item", "num", "gid").alias("k"), [*same("r", "k"), F.col("r.item") == F.col("k.item")])
    tagged = cut(tagged.select("gid", F.xxhash64("r.rec").alias("h1"), F.xxhash64(F.lit(1), F.col("r.rec")).alias("h2"), "num"))
    rec = ["gid", "h1", "h2"]
    # A record of more than BLOCK items is dealt into blocks by hash before anything of it is collected: each pair of
    # blocks is a row of its own, so that no task holds a whole record.
    sizes = tagged.groupBy(*rec).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = tagged.join(sizes, rec, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    lists = dealt.groupBy(*rec, "blocks", "blk").agg(F.array_sort(F.collect_list("num")).alias("nums"))
    whole = lists.where((F.col("blocks") > 1) | (F.size("nums") > 1)).select("gid", F.col("nums").alias("x"), F.col("nums").alias("y"))
    long = lists.where("blocks > 1")
    left = long.select(*rec, "blocks", "blk", F.col("nums").alias("x")).where("blk < blocks - 1").select(*rec, "x", F.explode(F.sequence(F.col("blk") + 1, F.col("blocks") - 1)).alias("blk"))
    wide = left.join(long.select(*rec, "blk", F.col("nums").alias("y")), [*rec, "blk"]).select("gid", "x", "y")
    runs = whole.unionByName(wide).mapInArrow(_runs, "gid long, code long, n long")
    pairs = runs.repartitionByRange("gid", "code").sortWithinPartitions("gid", "code").mapInArrow(_merge, "gid long, code long, n long").where(F.col("n") >= min_count)
    pairs = pairs.select("gid", F.shiftright("code", 32).alias("na"), F.col("code").bitwiseAND((1 << 32) - 1).alias("nb"), F.col("n").alias("n_ab"))
    a = known.select(*g, "gid", F.col("num").alias("na"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    b = known.select("gid", F.col("num").alias("nb"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    out = pairs.join(a, ["gid", "na"]).join(b, ["gid", "nb"]).where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    half = lambda e: e.cast("double") + 0.5
    odds = half(F.col("n_ab")) * half(F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")) / (half(F.col("n_a") - F.col("n_ab")) * half(F.col("n_b") - F.col("n_ab")))
    return out.select(*[F.col(a).alias(c) for c, a in zip(group, g)], "item_a", "item_b", "n", "n_a", "n_b", "n_ab", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), odds.alias("odds_ratio"))
