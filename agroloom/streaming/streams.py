"""Structured Streaming: dialogue state, the review queue, and event windows.

Windows over event time, sessions and watermarks are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agroloom.operators import dialog

def dialogue(turns: DataFrame, forget_after_ms: int | None = None, chapters: bool = False) -> DataFrame:
    """Streamed turns (classified and ``dialog.marked``), resolved by the same steps as the batch operator. With
    ``forget_after_ms`` a conversation is forgotten so long after its last turn; such a stream never runs out of
    batches, so it suits continuous triggers only."""

    def carried(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(dialog.CARRIED_NAMES, state.get, strict=True)) if state.exists else None
        done = []
        for t in dialog.turns_of(pd.concat(list(batches))):
            r, held = dialog.step(t, held, chapters)
            done.append({"conv_id": key[0], "turn": t["turn"], **r})
        state.update(tuple(held[c] for c in dialog.CARRIED_NAMES))
        if forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in dialog.STATE_SCHEMA.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(carried, dialog.STATE_SCHEMA, dialog.CARRIED, "append", timeout)


def event_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by type; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_reviews(stream: DataFrame, path: str, checkpoint: str):
    """Writes answers with reasons to the review log, one folder for each batch: a replayed batch replaces itself."""
    from agroloom.operators.review import submit

    def write(batch: DataFrame, number: int) -> None:
        submit(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_circuit(calls: DataFrame, seconds: int = 600) -> DataFrame:
    """Calls of each source with whether it is skipped: it failed less than ``seconds`` before."""
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.last(F.when(~F.col("ok"), F.col("ts")), ignorenulls=True).over(before)
    return calls.withColumn("skipped", F.coalesce(F.col("ts") < failed + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)), F.lit(False)))
