"""Progress of trials as a stream: the latest snapshot of each trial, whether a model is at work, whether it ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed values, in the order of a trial.
KINDS = ("trial-start", "stage-start", "request-sent", "attempt", "trial-end")


def latest(events: DataFrame, key: str = "trial_id", seq: str = "seq", kind: str = "kind", payload: str = "snapshot") -> DataFrame:
    """One row a key: its last event's number, kind and snapshot, events so far, working (since a request, until what ends it), ended.

    The same plan runs on a batch and on a stream (update or complete mode); state is one row a key.
    """
    last = F.max(F.struct(F.col(seq), F.col(kind), F.col(payload)))
    at = lambda *kinds: F.coalesce(F.max(F.when(F.col(kind).isin(*kinds), F.col(seq))), F.lit(-1))
    d = events.groupBy(key).agg(last.alias("x"), F.count("*").alias("events"), F.max(F.when(F.col(kind) == "trial-end", 1).otherwise(0)).alias("e"), (at("request-sent") > at("attempt", "trial-start", "trial-end")).alias("w"))
    return d.select(key, F.col(f"x.{seq}").alias("last_seq"), F.col(f"x.{kind}").alias("last_kind"), F.col(f"x.{payload}").alias("last_snapshot"), "events", F.col("w").alias("working"), (F.col("e") == 1).alias("ended"))


def windowed(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window with a watermark (an extension: event time has no counterpart in run records)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def watch(events: DataFrame, draw: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", final_only: bool = False) -> StreamingQuery:
    """Hand each batch of changed rows to an observer; an observer that raises is let go, and the stream goes on."""
    live = {"on": True}

    def batch(df: DataFrame, n: int) -> None:
        if live["on"]:
            try:
                draw(df.where("ended") if final_only else df, n)
            except Exception:  # noqa: BLE001  an observer must not end the run
                live["on"] = False

    return latest(events).writeStream.outputMode("update").trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def state_of(kind: Column) -> Column:
    return F.when(kind == "request-sent", "working").when(kind == "trial-end", "ended").otherwise("idle")
