"""Filling fixed-capacity containers by bound-certified repacking.

Items are spread over groups by a hash of their key and each group is packed by
best-fit decreasing. Dual-feasible functions give a lower bound of each group's
containers: a group that meets its bound is certified and final. The others keep
their well-filled containers and hand the rest to fewer, new groups that are
packed again, until every group is certified or the rounds are over; where one group is left
that has a gap, containers of it exchange items among themselves. The bounds are delivered with the
containers, and so is the bound of all items together, from the counts of their sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

CAPACITY = 2048
#: Items a group has on average; the number of groups grows with the items.
GROUP_ITEMS = 20_000
ROUNDS = 3
#: Turns in which containers of the last group exchange items.
EXCHANGES = 40


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of the area bound and two families of dual-feasible functions."""
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def histogram_bound(counts: np.ndarray, capacity: int) -> int:
    """`lower_bound` of as many items of each size from 0 to the capacity; in whole numbers, so that it never rounds up."""
    hist = counts.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    up = lambda total, unit: -(-int(total) // unit)
    best = up(hist @ x, capacity)
    for k in range(1, 21):  # u_k(x): x where (k+1)x/C is whole, else floor((k+1)x/C) * C/k; all times k
        steps, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, up(hist @ np.where(rest == 0, k * x, steps * capacity), k * capacity))
    for cutoff in np.flatnonzero(hist[: capacity // 2 + 1]):  # f_e(x): C above C-e, 0 below e, x between
        best = max(best, up(hist @ np.where(x > capacity - cutoff, capacity, np.where(x < cutoff, 0, x)), capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes are between 1 and the capacity. Equal sizes go by position."""
    out = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set where a container with r free exists
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = open_rooms >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r > s:
            rooms[r - s].append(b)
            open_rooms |= 1 << (r - s)
    return out


def _fill_exactly(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: the largest item left opens one, and the others that fill it best, by all their sums, go with it."""
    out = np.empty(len(sizes), np.int64)
    left = np.argsort(-sizes, kind="stable").tolist()
    n = 0
    while left:
        room = capacity - int(sizes[left[0]])
        mask, reach = (1 << (room + 1)) - 1, [1]
        for i in left[1:]:
            reach.append((reach[-1] | reach[-1] << int(sizes[i])) & mask)
            if reach[-1] >> room & 1:
                break
        want, taken = reach[-1].bit_length() - 1, [left[0]]
        for j in range(len(reach) - 1, 0, -1):
            if not reach[j - 1] >> want & 1:
                taken.append(left[j])
                want -= int(sizes[left[j]])
        out[taken] = n
        gone = set(taken)
        left = [i for i in left if i not in gone]
        n += 1
    return out


def exchange(sizes: np.ndarray, bins: np.ndarray, capacity: int, bound: int, tries: int = EXCHANGES) -> np.ndarray:
    """Containers with fewer or, if there are as many, less evenly filled: in turns, the emptiest ones and a few others exchange their items."""
    rng = np.random.default_rng(1)
    bins = bins.copy()
    for _ in range(tries):
        fill = np.bincount(bins, weights=sizes)
        n = len(fill)
        if n <= bound:
            break
        worst = np.argsort(fill, kind="stable")[: min(n, 3 + 2 * (n - bound))]
        some = np.union1d(worst, rng.choice(n, min(n, 24), replace=False))
        at = np.flatnonzero(np.isin(bins, some))
        new = _fill_exactly(sizes[at], capacity)
        if new.max() + 1 > len(some) or new.max() + 1 == len(some) and np.bincount(new, weights=sizes[at]).min() >= fill[some].min():
            continue
        names = np.concatenate([some, np.arange(n, n + max(0, new.max() + 1 - len(some)))])
        bins[at] = names[new]
        _, bins = np.unique(bins, return_inverse=True)
    return bins


def _packer(round_no: int, last: bool, capacity: int):
    return lambda pdf: _pack_group(pdf, round_no, last, capacity)


def _pack_group(pdf: pd.DataFrame, round_no: int, last: bool, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "piece_no"], kind="stable", ignore_index=True)
    sizes = pdf["size"].to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if last:
        bins = exchange(sizes, bins, capacity, bound)
    fill = np.bincount(bins, weights=sizes)
    gap = len(fill) - bound
    done = np.ones(len(fill), bool)
    if not last and (gap > 0 or fill.min() < 0.98 * capacity):
        # With a gap the worst containers are given away, at least one and at most half of all.
        order = np.argsort(fill, kind="stable")
        give = min(max(1, 4 * gap), max(1, len(fill) // 2))
        done[order[:give]] = False
    group = int(pdf["grp"].iloc[0])
    pdf["container_id"] = [f"{round_no}-{group}-{b}" for b in bins.tolist()]
    pdf["final"] = done[bins]
    pdf["bound"] = bound
    return pdf[["key", "piece_no", "size", "container_id", "final", "bound", "grp"]]


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece_no, n_tokens, container_id) for every item of a size of one or more.

    An item above the capacity is cut into full pieces, each alone in its
    container, and a rest that is packed like any item; all others stay whole
    (piece_no 0). Rows with a null key, or a null or non-positive size, are left
    out; repeated rows are one item; an empty table gives no rows. Groups take
    rows by hash, so no key or source can make one of them large.
    """
    return pack_certified(items, key, size, capacity, group_items, rounds)[0]


def pack_certified(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """What `pack` gives, and its certificates: (round, partition, items, containers, kept, bound, certified).

    A row for every group of every round: the containers its items took, those of them that were kept, and the fewest
    that any packing of them takes. In round -1, partition -1, the containers of all pieces and the bound of all
    of them together. Certified are those that meet their bound. An empty table has no certificates.
    """
    ship(items.sparkSession)
    spark = items.sparkSession
    clean = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("key is not null and size > 0").dropDuplicates(["key"])
    clean = cut(clean)
    full = F.floor((F.col("size") - 1) / capacity)
    over = clean.where(F.col("size") > capacity).select("key", F.posexplode(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int"))).alias("piece_no", "size"))
    over = over.select("key", "piece_no", "size", F.concat(F.lit("full-"), F.col("key").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"))
    rest = clean.select("key", F.when(F.col("size") > capacity, full).otherwise(0).cast("int").alias("piece_no"), (F.col("size") - full * capacity).cast("long").alias("size"))
    kind = clean.schema["key"].dataType.simpleString()
    parts, proofs = [over], []
    todo = rest
    for r in range(rounds):
        n = todo.count()
        if not n:
            break
        groups = max(1, math.ceil(n / group_items))
        last = groups == 1 or r == rounds - 1
        placed = todo.withColumn("grp", F.pmod(F.xxhash64("key", "piece_no", F.lit(r)), F.lit(groups)).cast("int"))
        done = cut(
            placed.groupBy("grp").applyInPandas(
                _packer(r, last, capacity),
                f"key {kind}, piece_no int, size long, container_id string, final boolean, bound long, grp int",
            )
        )
        parts.append(done.where("final").select("key", "piece_no", "size", "container_id"))
        kept = F.countDistinct(F.when(F.col("final"), F.col("container_id")))
        proofs.append(done.groupBy("grp").agg(F.count("*").alias("items"), F.countDistinct("container_id").alias("containers"), kept.alias("kept"), F.max("bound").alias("bound")).select(F.lit(r).alias("round"), F.col("grp").alias("partition"), "items", "containers", "kept", "bound"))
        todo = done.where("not final").select("key", "piece_no", "size")
        if last:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out)
    # The sizes of all pieces are at most `capacity` different numbers.
    hist = np.zeros(capacity + 1, np.int64)
    for s, n in out.groupBy("size").count().collect():
        hist[s] = n
    total = out.agg(F.count("*").alias("items"), F.countDistinct("container_id").alias("containers"))
    proof = total.where("items > 0").select(F.lit(-1).alias("round"), F.lit(-1).alias("partition"), "items", "containers", F.col("containers").alias("kept"), F.lit(histogram_bound(hist, capacity)).cast("long").alias("bound"))
    for p in proofs:
        proof = proof.unionByName(p)
    placed = out.select(F.col("key").alias(key), "piece_no", F.col("size").alias("n_tokens"), "container_id")
    return placed, proof.withColumn("certified", F.col("containers") == F.col("bound"))
