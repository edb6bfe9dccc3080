"""Co-retrieval mining over the search log, and the trigger that starts it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .pairs import pairs_within


def co_retrieved(sessions: DataFrame, files: DataFrame, known: DataFrame | None = None, last: int = 500, min_count: int = 1) -> DataFrame:
    """(project_id, chunk_a, chunk_b, pair_count): chunks of different files returned by the same of a project's last searches.

    `files` maps chunk_id to its first file, `known` holds pairs (chunk_a, chunk_b) an insight already covers.
    Sessions with fewer than two different chunks make no pair; null ids don't count.
    """
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "session_id")
    rows = sessions.where("project_id is not null").select("project_id", "session_id", "created_at", F.array_compact(F.array_distinct(F.coalesce("result_chunk_ids", F.array().cast("array<string>")))).alias("ids"))
    rows = rows.withColumn("r", F.row_number().over(w)).where((F.col("r") <= last) & (F.size("ids") > 1))
    items = rows.select("project_id", "session_id", F.explode("ids").alias("chunk_id")).join(files, ["project_id", "chunk_id"])
    pairs = pairs_within(items, ["project_id", "session_id"], "chunk_id", ["file_path"]).where("file_path_a <> file_path_b")
    pairs = pairs.select("project_id", F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"))
    out = pairs.groupBy("project_id", "chunk_a", "chunk_b").agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= min_count)
    if known is None:
        return out
    # An insight may name its chunks in either order.
    pair = known.select(F.least("chunk_a", "chunk_b").alias("chunk_a"), F.greatest("chunk_a", "chunk_b").alias("chunk_b")).distinct()
    return out.join(pair, ["chunk_a", "chunk_b"], "left_anti")


def says_something(text):
    """Whether a generated answer is an insight: not null, not blank and not a refusal."""
    return F.coalesce((F.trim(text) != "") & ~F.upper(text).contains("NO_INSIGHT"), F.lit(False))


class TriggerState:
    """Counts a project's searches and says when a cycle starts: enough searches, enough time since the last, not too often a day."""

    def __init__(self, every: int = 25, gap_s: int = 300, per_day: int = 1, count: int = 0, last: float = 0.0, day: str = "", runs: int = 0):
        self.every, self.gap_s, self.per_day = every, gap_s, per_day
        self.count, self.last, self.day, self.runs = count, last, day, runs

    def see(self, at: float) -> bool:
        """One search at epoch seconds `at`; the count goes on while the trigger is held back."""
        self.count += 1
        today = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%d")
        if today != self.day:
            self.day, self.runs = today, 0
        if self.count < self.every or at - self.last < self.gap_s or self.runs >= self.per_day:
            return False
        self.count, self.last, self.runs = 0, at, self.runs + 1
        return True

    def pack(self) -> tuple:
        return self.count, self.last, self.day, self.runs


def auto_trigger(sessions: DataFrame, every: int = 25, gap_s: int = 300, per_day: int = 1) -> DataFrame:
    """(project_id, fired_at, nth): the trigger replayed over the log, each project in order of time.

    A fold needs a project's whole order; its rows are two narrow columns, read as a stream of Arrow batches
    of one sorted partition and never held at once.
    """
    ship(sessions.sparkSession)
    import pandas as pd

    rows = sessions.where("project_id is not null and created_at is not null").select("project_id", F.col("created_at").cast("double").alias("at"), "session_id")
    rows = rows.repartition("project_id").sortWithinPartitions("project_id", "at", "session_id")

    def run(batches):
        state: dict[str, list] = {}
        for pdf in batches:
            out = []
            for p, at in zip(pdf["project_id"], pdf["at"]):
                if p not in state:
                    state.clear()  # sorted by project: the one before is done
                    state[p] = [TriggerState(every, gap_s, per_day), 0]
                s = state[p]
                if s[0].see(at):
                    s[1] += 1
                    out.append((p, at, s[1]))
            yield pd.DataFrame(out, columns=["project_id", "fired_at", "nth"])

    return rows.mapInPandas(run, "project_id string, fired_at double, nth int")
