"""The document state machine on a stream of stage events, with its state and timers kept by Spark.

A document's state is its stage, when it was entered, how many stages have ended and how long they took. Every event gives
a row: what it was after, the verdict on the step, progress and the time that is left. A stage that doesn't end within
``limit`` has failed: that is a row too, when the next event comes late, or when the watermark has passed and none came.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.observe import DEFAULT_STAGE_SECONDS, STAGES

OUT = StructType([
    StructField("doc_id", LongType()), StructField("event_id", LongType()), StructField("at_us", LongType()), StructField("stage", StringType()), StructField("previous", StringType()),
    StructField("verdict", StringType()), StructField("progress", LongType()), StructField("eta_seconds", LongType()),
])
STATE = "stage string, since_us long, stages long, total_us long, expired boolean"
PLACE = {s: k for k, s in enumerate(STAGES)}


def eta_seconds(place: int, stages: int, total_us: int) -> int:
    """Whole seconds for this stage and each further one at the mean duration of those that have ended, the default without any. Exact: sums are whole microseconds."""
    left = len(STAGES) - place
    return left * total_us // (stages * 1_000_000) if stages else int(left * DEFAULT_STAGE_SECONDS)


class DocumentStages(StatefulProcessor):
    """State machine of one document. Unknown stages are refused: they give a row and leave the state as it is."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _row(self, doc, event, at, stage, previous, verdict, stages, total):
        place = PLACE.get(stage)
        known = place is not None and verdict != "failed"
        left = {"progress": place * 100 // len(STAGES) if known else None, "eta_seconds": eta_seconds(place, stages, total) if known else None}
        return Row(doc_id=doc, event_id=event, at_us=at, stage=stage, previous=previous, verdict=verdict, **left)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802 (Spark's name)
        doc, held = key[0], self.state.get() if self.state.exists() else None
        stage, since, stages, total, expired = tuple(held) if held else (None, None, 0, 0, False)
        changed = False
        for event, at, new in sorted(((r["event_id"], r["at_us"], r["stage"]) for r in rows), key=lambda x: (x[1], x[0])):
            if new not in PLACE:
                yield self._row(doc, event, at, new, stage, "unknown", stages, total)
                continue
            if stage is not None and not expired and PLACE[stage] < len(STAGES) - 1 and at - since > self.limit_us:
                yield self._row(doc, None, since + self.limit_us, stage, stage, "failed", stages, total)
            if stage is not None:
                stages, total = stages + 1, total + at - since
            verdict = "first" if stage is None else "forward" if PLACE[new] > PLACE[stage] else "same" if new == stage else "back"
            yield self._row(doc, event, at, new, stage, verdict, stages, total)
            stage, since, expired, changed = new, at, False, True
        if changed:
            self.state.update((stage, since, stages, total, expired))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # the last stage has no end
            if PLACE[stage] < len(STAGES) - 1:
                self.handle.registerTimer((since + self.limit_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        stage, since, stages, total, expired = tuple(self.state.get())
        if not expired:
            self.state.update((stage, since, stages, total, True))
            yield self._row(key[0], None, since + self.limit_us, stage, stage, "failed", stages, total)

    def close(self) -> None:
        pass


def stage_rows(events: DataFrame, limit_seconds: int, late: str = "1 minute") -> DataFrame:
    """(doc_id, event_id, at_us, stage, previous, verdict, progress, eta_seconds) of a stream of (event_id, doc_id, ts, stage).

    Events of a micro-batch are taken by time and id; batches must come in the order of time, as an append-only log does.
    verdict: first, forward, same, back, unknown, or failed (a stage but the last that took over ``limit_seconds``; no event_id). The
    query needs the RocksDB state store, see state_store().
    """
    timed = events.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "stage").withWatermark("ts", late)
    timed = timed.withColumn("at_us", F.unix_micros("ts"))
    return timed.groupBy("doc_id").transformWithState(DocumentStages(limit_seconds * 1_000_000), OUT, "Append", "EventTime")


def state_store(spark) -> None:
    """State with timers needs the RocksDB store: sets it for the session's queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append to Parquet at ``out`` what has come, and end; the next call goes on from the checkpoint."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
