"""The search log as a stream: pair counts by window of event time, and the stateful trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mining import TriggerState
from ..session import ship


def windowed_pairs(stream: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, project_id, chunk_a, chunk_b, pair_count): chunks of the same search, by window.

    By default every row counts, however late, and the state holds all windows: for the output modes update and
    complete. With `late` there is a watermark, which bounds the state and allows append, but update and append
    then drop what comes behind it; Spark refuses append without one.
    """
    if late is not None:
        stream = stream.withWatermark("created_at", late)
    rows = stream.select("project_id", "created_at", F.array_sort(F.array_compact(F.array_distinct("result_chunk_ids"))).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: a < b), lambda b: F.struct(a.alias("chunk_a"), b.alias("chunk_b")))))
    out = rows.select("project_id", "created_at", F.explode(pairs).alias("p"))
    return out.groupBy(F.window("created_at", window), "project_id", "p.chunk_a", "p.chunk_b").agg(F.count("*").alias("pair_count")).select(F.col("window.start").alias("window_start"), "project_id", "chunk_a", "chunk_b", "pair_count")


def trigger_stream(stream: DataFrame, every: int = 25, gap_s: int = 300, per_day: int = 1) -> DataFrame:
    """(project_id, fired_at): the trigger as a stateful operator; time is the rows' own, so a replay gives the same."""
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0, "", 0)
        t = TriggerState(every, gap_s, per_day, *held)
        times = sorted(x for b in batches for x in b["at"])
        fired = [x for x in times if t.see(x)]
        state.update(t.pack())
        yield pd.DataFrame({"project_id": [key[0]] * len(fired), "fired_at": fired})

    rows = stream.where("project_id is not null and created_at is not null").select("project_id", F.col("created_at").cast("double").alias("at"))
    return rows.groupBy("project_id").applyInPandasWithState(step, "project_id string, fired_at double", "count int, last double, day string, runs int", "append", GroupStateTimeout.NoTimeout)
