"""Calls of an external service from many tasks that keep one rate together.

The tasks run as a barrier stage. Before each round they tell one another how many calls each has, and from that follows
the same timetable in all of them: calls take numbers in turn, and number n isn't made before n / rate seconds. A task that
falls behind keeps the gaps of its timetable, so what it does late is never added to what others do then.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def numbers(counts: list[int], task: int) -> list[int]:
    """Numbers of a task's calls in a round: all first calls by task, then all second ones, and so on."""
    order = sorted((n, t) for t, n in enumerate(counts))
    out, done, k = [], 0, 0
    # tasks with more than j calls are those behind place k in the order of counts
    for j in range(counts[task]):
        while k < len(order) and order[k][0] <= j:
            k += 1
        rank = sum(counts[t] > j for t in range(task))
        out.append(done + rank)
        done += len(counts) - k
    return out


def wall_clock() -> tuple[Callable[[], float], Callable[[float], None]]:
    return time.monotonic, time.sleep


def paced_calls(rows: DataFrame, call: Callable[[str], str], rate: float, tasks: int, clock: Callable[[], tuple] = wall_clock, column: str = "content") -> DataFrame:
    """rows with response, error, number and at (seconds after the start at which the call began).

    All ``tasks`` must run at once: no more than the cluster has free cores. At most ``rate`` calls begin in a second over
    all of them. clock: makes (now, sleep) in each task. A call that fails is a row with its error. A stage that is run
    again makes its calls again.
    """
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("response", StringType()), StructField("error", StringType()), StructField("number", LongType()), StructField("at", DoubleType())])
    place = names.index(column)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import BarrierTaskContext

        context, (now, sleep) = BarrierTaskContext.get(), clock()
        me, begun, made, began_last, slot_last = context.partitionId(), None, 0, None, 0.0
        batches = iter(batches)
        while True:
            batch = next((b for b in batches if b.num_rows), None)
            elapsed = 0.0 if begun is None else now() - begun
            told = [x.split(",") for x in context.allGather(f"{batch.num_rows if batch else 0},{elapsed!r}")]
            if begun is None:
                begun = now()
            counts = [int(n) for n, _ in told]
            if not any(counts):
                return
            base = max(made / rate, *(float(e) for _, e in told))
            answers = []
            for text, k in zip(batch.column(place).to_pylist() if batch else [], numbers(counts, me), strict=True):
                slot = base + k / rate
                start = slot if began_last is None else max(slot, began_last + slot - slot_last)
                if (wait := begun + start - now()) > 0:
                    sleep(wait)
                began_last, slot_last, response, error = now() - begun, slot, None, None
                try:
                    response = call(text or "")
                except Exception as e:  # a hook may fail in any way; the row tells
                    error = f"{type(e).__name__}: {e}"
                answers.append((response, error, made + k, began_last))
            made += sum(counts)
            if batch:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([a[i] for a in answers], t) for i, t in enumerate(kinds))], names=schema.names)

    return rows.repartition(tasks).mapInArrow(work, schema, barrier=True)
