"""Tables as sets of records: newest versions, merges, deletes, ids and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`; keys compare null-safe. Spark cuts each task's groups to one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """`new` over `old` by key; columns in `keep` keep their old value where the key was there before.

    Of several rows of `new` with a key the last by `order` counts (without it, one of them); keys of `old` are unique.
    Rows of `new` with a null in the key are left out.
    """
    keep = keep or []
    rest = [c for c in old.columns if c not in keys]
    new = new.dropna(subset=keys)
    new = newest(new, keys, order) if order else new.dropDuplicates(keys)
    o, n = old.alias("o").withColumn("__o", F.lit(True)), new.alias("n").withColumn("__n", F.lit(True))
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    there, fresh = F.col("__o").isNotNull(), F.col("__n").isNotNull()
    pick = lambda c: F.when(fresh & ~(there if c in keep else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[pick(c) for c in rest]).select(*old.columns)


def keep_newest(df: DataFrame, at: str, key: str, rows: int | None = None, since: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """What a pruning leaves: rows not older than `since`, of these the newest `rows` of each group or of all, ties by key.

    Rows without a time are the oldest: they go with `since`. Without a group a top-k, no single-task window.
    """
    out = df if since is None else df.where(F.col(at) >= since)
    if rows is None:
        return out
    rows = max(0, rows)
    if not group:
        return out.orderBy(F.desc_nulls_last(at), key).limit(rows)
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(at), key)
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows).drop("__r")


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of `order`, each with its partition and place in it, written down."""
    mask = (1 << 33) - 1
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(mask)))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0, group: list[str] | None = None) -> DataFrame:
    """Dense numbers start + 1, start + 2, ... in the order of `order`, from the start again in each group; no task holds a group."""
    g = group or []
    ranged = _ranged(rows, [*g, *order])
    sizes = ranged.groupBy("__part", *g).agg(F.count("*").alias("__n"), F.min("__nth").alias("__first"))
    w = Window.partitionBy(*(g or [F.lit(0)])).orderBy("__part")
    base = sizes.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], (F.sum("__n").over(w) - F.col("__n") - F.col("__first")).alias("__base"))
    cond = (F.col("__part") == F.col("__p"))
    for i, c in enumerate(g):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = ranged.join(base, cond).withColumn(name, (F.lit(start) + F.col("__base") + F.col("__nth") + 1).cast("long"))
    return out.drop("__part", "__nth", "__p", "__base", *[f"__g{i}" for i in range(len(g))])


def running(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The sum of `value` over a group's rows up to each row, in the order of `order`; no task holds a group."""
    ranged = _ranged(rows, [*group, *order])
    w = Window.partitionBy(*group).orderBy("__part")
    base = ranged.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    base = base.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], (F.sum("__sum").over(w) - F.col("__sum")).alias("__base"))
    cond = (F.col("__part") == F.col("__p"))
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy("__part", *group).orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("__own", F.sum(value).over(inside)).join(base, cond).withColumn(name, F.col("__base") + F.col("__own"))
    return out.drop("__part", "__nth", "__p", "__base", "__own", *[f"__g{i}" for i in range(len(group))])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` whose key it lacks; of repeated new keys one row."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in `gone`."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def repair_ids(rows: DataFrame, taken: DataFrame, group: str, key: str, number: str) -> DataFrame:
    """Rows whose number another key of the group holds in `taken` get the next free ones, in order of key.

    A number that stands twice in a group of `rows` is an error of the batch: see `duplicate_numbers`.
    """
    t = taken.select(F.col(group).alias("__g"), F.col(number).alias("__held"), F.col(key).alias("__holder"))
    clash = rows.select(group, key, number).join(t, (F.col(group) == F.col("__g")) & (F.col(number) == F.col("__held")) & (F.col(key) != F.col("__holder")), "left")
    clash = cut(clash.groupBy(group, key, number).agg(F.max(F.col("__holder").isNotNull()).alias("__hit")))
    top = taken.groupBy(F.col(group).alias("__g2")).agg(F.max(number).alias("__top"))
    moved = numbered(clash.where("__hit"), [key], "__n", 0, [group])
    moved = moved.join(top, F.col(group) == F.col("__g2"), "left").select(group, key, (F.coalesce("__top", F.lit(0)) + F.col("__n")).alias(number))
    return clash.where("not __hit").select(group, key, number).unionByName(moved)


def duplicate_numbers(rows: DataFrame, group: str, key: str, number: str) -> DataFrame:
    """(group, number, n): numbers that more than one key of a group has."""
    return rows.groupBy(group, number).agg(F.countDistinct(key).alias("n")).where("n > 1")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, deleted, modified or unchanged between two file snapshots.

    Columns mtime_ns, size_bytes and content_hash: equal time and size mean unchanged, whatever the hash; else
    the hashes decide, and an unknown one counts as modified.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    same = lambda c: F.col(f"o.{c}") == F.col(f"n.{c}")
    change = (
        F.when(F.col(f"o.{keys[0]}").isNull(), "added")
        .when(F.col(f"n.{keys[0]}").isNull(), "deleted")
        .when(F.coalesce(same("mtime_ns") & same("size_bytes"), F.lit(False)) | F.coalesce(same("content_hash"), F.lit(False)), "unchanged")
        .otherwise("modified")
    )
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], change.alias("change"))


def incremental_update(old: DataFrame, new: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, content_hash, chunks_out): what an update from one file snapshot to the next does to each file.

    content_hash is the file's afterwards, null for a deleted one; an unchanged file that was not read keeps the one it had.
    chunks_out counts the links (keys, chunk) that go, those of modified and deleted files.
    """
    change = snapshot_changes(old, new, keys)
    held = old.select(*keys, F.col("content_hash").alias("__was")).join(new.select(*keys, F.col("content_hash").alias("__now")), keys, "full_outer")
    n = links.groupBy(*keys).agg(F.count("*").alias("__k"))
    rows = change.join(held, keys).join(n, keys, "left")
    after = F.when(F.col("change") == "deleted", F.lit(None)).when(F.col("change") == "unchanged", F.coalesce("__now", "__was")).otherwise(F.col("__now"))
    out = F.when(F.col("change").isin("deleted", "modified"), F.coalesce("__k", F.lit(0))).otherwise(F.lit(0))
    return rows.select(*keys, "change", after.alias("content_hash"), out.cast("long").alias("chunks_out"))


def byte_pages(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """(group, order, bytes, page): pages of at most `budget` bytes by running sum, each with one row at least."""
    rows = running(df.select(group, order, size.alias("bytes")), [group], [order], "bytes", "__upto")
    return rows.select(group, order, "bytes", F.floor((F.col("__upto") - F.col("bytes")) / budget).cast("long").alias("page"))
