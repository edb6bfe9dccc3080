"""Processing only new or changed records.

A state is a set of (key, content hash) rows kept in versions. A run hashes its
current rows, joins them with the newest version, hands out what is new or
changed, and only after its own work has succeeded publishes the next version by
one atomic rename. A version adds the changed rows to those before it; the newest row of a key counts.

What a run hands out is written down first, under the number of the version it is to make. A run that
dies leaves the pointer where it was and that table behind: the next run finds it and
hands out the same rows under the same number again, so that a sink that knows the number can tell a repetition.
Changes since then come with the run after; none is skipped.

`step` drives a state through a history of runs, one version for each step. `replay`
is the same comparison over all of them at once: what each run saw against what
the run before it had seen, for late, repeated and failed runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.store import Conflict, VersionedTable

#: Rows of the run history up to which it is sent to every executor.
BROADCAST_RUNS = 20_000
#: Folders of a state beyond which it is written anew.
COMPACT = 24


def content_hash(*columns: str):
    """sha256 over the columns' text, nulls told from empty strings."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def changes(current: DataFrame, state: DataFrame, keys: list[str], hashed: str, complete: bool = False, at: str | None = None) -> DataFrame:
    """Rows of `current` whose hash is not null and new or different from the one in `state`.

    Adds `change` (new or changed). Null-safe on keys; repeated rows of `current` are one,
    by the greatest hash; an empty state makes every row new. Of several state rows of a key the one of the greatest
    `at` counts, without it that of the greatest hash; a null hash in the state is a removed key. With `complete`, keys
    that `current` lacks altogether come out as removed, with a null hash. One shuffle join on the keys.
    """
    cur = current.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(hashed)))).where("__r = 1").drop("__r")
    cur = cur if complete else cur.where(F.col(hashed).isNotNull())
    order = [F.col(at).alias("__at")] if at else []
    old = state.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct(*order, F.col(hashed).alias("__h"))).alias("__old"))
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = cur.withColumn("__here", F.lit(True)).join(old, cond, "full" if complete else "left")
    seen, here = F.col("__old.__h"), F.col("__here")
    fresh = F.col(hashed).isNotNull() & (seen.isNull() | (seen != F.col(hashed)))
    gone = here.isNull() & seen.isNotNull()
    out = both.where(F.coalesce(fresh, F.lit(False)) | gone if complete else fresh)
    out = out.withColumn("change", F.when(here.isNull(), "removed").when(seen.isNull(), "new").otherwise("changed"))
    if complete:
        out = out.withColumns({k: F.when(here.isNull(), F.col(f"__{k}")).otherwise(F.col(k)) for k in keys})
    return out.drop("__old", "__here", *[f"__{k}" for k in keys])


class IncrementalState:
    """Versions of (keys, hash) in a folder, swapped atomically.

    With `keep` a version holds the rows that were handed out as they were, so that they are written once; without it, only keys and hash.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], hashed: str = "content_hash", keep: bool = False):
        self.table, self.keys, self.hashed, self.keep = VersionedTable(spark, path), keys, hashed, keep
        self._spark, self._schema = spark, None

    def _load(self, version: int) -> DataFrame | None:
        """All rows (keys, hash, __v) of a version, the older ones of a key too."""
        paths = [f"{self.table.path}/{name}" for _, name in self.table.entries(version)]
        if not paths:
            return None
        if self._schema is None:
            self._schema = self._spark.read.parquet(paths[-1]).select(*self.keys, self.hashed, "__v").schema
        return self._spark.read.schema(self._schema).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*self.keys).agg(F.max(F.struct("__v", self.hashed)).alias("n"))
        return out.select(*self.keys, f"n.{self.hashed}", "n.__v").where(F.col(self.hashed).isNotNull())

    def rows(self) -> DataFrame | None:
        """(keys, hash) as the newest version has them; None before the first."""
        found = self._load(self.table.version())
        return None if found is None else self._newest(found).drop("__v")

    def begin(self, rows: DataFrame) -> int:
        """A first version that holds `rows` as processed; an error if there is one."""
        return self.table.publish(rows.select(*self.keys, self.hashed, F.lit(0).cast("long").alias("__v")), 0)

    def run(self, current: DataFrame, work: Callable[[DataFrame, int], None], complete: bool = False) -> int:
        """Hands new and changed rows of `current` and the number of the version to come to `work`, then publishes that version.

        `current` is read once: what `work` gets is what enters the state, whatever happens to the source meanwhile.
        Keys that `current` lacks, or has without a hash, keep their last state; with `complete`, those it lacks are
        handed out as removed and leave the state. If `work` raises, nothing is published, and the next run hands
        out the same rows under the same number before it looks at its own.
        """
        before = self.table.version()
        name = f"todo-{before + 1}"
        path = f"{self.table.path}/{name}"
        again = self.table._fs.exists(self.table._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
        if again:
            todo = self._spark.read.parquet(path)
        else:
            found = self._todo(current, before, complete).withColumn("__v", F.lit(before + 1).cast("long"))
            found.write.mode("overwrite").parquet(path)
            todo = self._spark.read.schema(found.schema).parquet(path)
        work(todo.drop("__v"), before + 1)
        fresh = todo.select(*self.keys, self.hashed, "__v")
        entries = self.table.entries(before)
        if len(entries) >= COMPACT:
            entries = [("", self.table._stage(self._newest(self._load(before).unionByName(fresh))))]
        else:
            entries.append(("", name if self.keep else self.table._stage(fresh)))
        if not self.table._point(entries, before + 1):
            raise Conflict(f"version {before + 1} was published by another run")
        if ("", name) not in entries:
            self.table._fs.delete(self.table._file(name), True)
        return self.run(current, work, complete) if again else before + 1

    def _todo(self, current: DataFrame, version: int, complete: bool) -> DataFrame:
        old = self._load(version) if version else current.select(*self.keys, self.hashed, F.lit(0).cast("long").alias("__v")).limit(0)
        return changes(current, old, self.keys, self.hashed, complete, "__v")


def replay(runs: DataFrame, scans: DataFrame, base: DataFrame, scope: str, run: str, at: str, keys: list[str], arrived: str, observed: str, tie: str, hashed: str) -> DataFrame:
    """(run, scope, keys) of everything each run had to process.

    A run sees, of a key, the hash of its newest observation (by `observed`, then
    `tie`) among those that arrived by the run's time `at`, or else the hash in `base`. A row comes out where
    that hash is not null and differs from what the scope's run before saw; before the
    first run stands `base`.

    Only runs that an observation reached can differ from the run before, so each
    observation goes to the first run that sees it, and a running maximum over
    a key's own observations replaces a join of runs with keys. Observations without a hash or key are
    not seen; runs without a time or scope never run; repeated rows are one; runs at one time go by id.
    """
    k = [f"k{i}" for i in range(len(keys))]
    newest = _placed(runs, scans, scope, run, at, keys, arrived, observed, tie, hashed)
    w = Window.partitionBy("s", *k).orderBy("nth")
    state = newest.withColumn("now", F.max("obs").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.max("obs").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = base.groupBy(F.col(scope).alias("s"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).agg(F.max(hashed).alias("start"))
    both = state.join(start, ["s", *k], "left").withColumn("prior", F.coalesce("before.h", "start"))
    out = both.where(F.col("prior").isNull() | (F.col("prior") != F.col("now.h")))
    return out.select(F.col("run").alias(run), F.col("s").alias(scope), *[F.col(a).alias(c) for a, c in zip(k, keys)])


def step(path: str, runs: DataFrame, scans: DataFrame, base: DataFrame, scope: str, run: str, at: str, keys: list[str], arrived: str, observed: str, tie: str, hashed: str) -> DataFrame:
    """The rows of `replay` from an IncrementalState at `path`, which must be free.

    Its first version is `base`; the n-th runs of all scopes make one step, which hands out their changes and
    publishes what they saw. Runs that no observation reached change nothing and make no version.
    """
    spark = base.sparkSession
    k = [f"k{i}" for i in range(len(keys))]
    w = Window.partitionBy("s", *k).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = _placed(runs, scans, scope, run, at, keys, arrived, observed, tie, hashed)
    seen = cut(placed.withColumn("h", F.max("obs").over(w)["h"]).select("s", *k, "nth", "run", "h"))
    state = IncrementalState(spark, path, ["s", *k], "h", keep=True)
    state.begin(base.where(F.col(hashed).isNotNull()).groupBy(F.col(scope).alias("s"), *[F.col(c).alias(a) for a, c in zip(k, keys)]).agg(F.max(hashed).alias("h")))
    held: dict[int, DataFrame] = {}  # what each version handed out; a repeated one takes its own place
    done: list[DataFrame] = []

    def take(todo: DataFrame, version: int) -> None:
        held[version] = todo.select(seen.columns)
        if len(held) >= COMPACT // 2:  # before the state is written anew and those rows go
            done.append(cut(reduce(DataFrame.unionByName, held.values())))
            held.clear()

    for n in sorted(r[0] for r in seen.select("nth").distinct().collect()):  # a row per run of the longest history
        state.run(seen.where(F.col("nth") == n), take)
        state.table.prune()
    out = cut(reduce(DataFrame.unionByName, [*done, *held.values()])) if done or held else seen.limit(0)
    state.table.drop()
    return out.select(F.col("run").alias(run), F.col("s").alias(scope), *[F.col(a).alias(c) for a, c in zip(k, keys)])


def _before(history: Column, at: Column) -> Column:
    """How many of a sorted array of structs have a `t` less than `at`: a binary search, since histories may be long."""
    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(F.element_at(history, mid + 1)["t"] < at, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    # One step more than the binary digits of the length.
    turns = F.sequence(F.lit(1), F.length(F.bin(F.size(history))) + 1)
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(history).alias("hi")), half)["lo"]


def _placed(runs: DataFrame, scans: DataFrame, scope: str, run: str, at: str, keys: list[str], arrived: str, observed: str, tie: str, hashed: str) -> DataFrame:
    """(s, k0.., nth, run, obs): the newest observation of each key among those that a scope's nth run is the first to see."""
    done = runs.where(F.col(at).isNotNull() & F.col(run).isNotNull() & F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.col(at).alias("t"), F.col(run).alias("run")).distinct()
    history = done.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "run"))).alias("history"))
    if done.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        history = F.broadcast(history)
    seen = scans.where(F.col(hashed).isNotNull() & F.col(arrived).isNotNull()).select(F.col(scope).alias("s"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(arrived).alias("arrived"), F.struct(F.col(observed).alias("o"), F.col(tie).alias("tie"), F.col(hashed).alias("h")).alias("obs"))
    k = [f"k{i}" for i in range(len(keys))]
    placed = seen.join(history, "s").withColumn("nth", _before(F.col("history"), F.col("arrived"))).where(F.col("nth") < F.size("history"))
    placed = placed.select("s", *k, "nth", F.element_at("history", F.col("nth") + 1)["run"].alias("run"), "obs")
    return placed.groupBy("s", *k, "nth", "run").agg(F.max("obs").alias("obs"))
