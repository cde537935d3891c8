"""The token ledger and uploads as streams: windows, sessions, de-duplication, and totals that are added to batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usage_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, step, events, tokens) of a stream or table with ts, step, input_tokens."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width), "step").agg(F.count("*").alias("events"), F.sum("input_tokens").alias("tokens")).select(F.col("window.start").alias("window_start"), "step", "events", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, session_start, session_end, events): activity of a user with pauses under ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    s = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def deduplicated_uploads(uploads: DataFrame, key: str = "upload_id", late: str = "1 hour") -> DataFrame:
    """Uploads without repeats: within the watermark on a stream, by key on a table."""
    if not uploads.isStreaming:
        return uploads.dropDuplicates([key])
    return uploads.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Delta folders that a ledger may have before they are folded into its base.
MOST_DELTAS = 100
MEASURES = ["events", "input_tokens", "output_tokens", "cost_usd"]


class LedgerTotals:
    """Totals of a token ledger by model and step that are added to batch by batch, never summed again from its events.

    A batch's sums go to a folder named by its id, which a repeated batch overwrites, so no event counts twice. Once there
    are MOST_DELTAS folders they are folded into a base, whose name has the last batch it holds: a batch up to that one is
    known and does nothing. Reading takes the newest base and the deltas after it. One stream writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str) -> list[int]:
        """Batch ids of the whole folders of a kind: those that Spark has marked as done."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-*/_SUCCESS")
        there = found.getFileSystem(conf).globStatus(found) or []
        return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in there)

    def _parts(self) -> tuple[int, list[int]]:
        """(last batch of the newest base or -1, batches after it)."""
        base = max(self._folders("base"), default=-1)
        return base, [b for b in self._folders("delta") if b > base]

    def add(self, costed: DataFrame, batch: int) -> None:
        """foreachBatch: the sums of a batch (model, step, input_tokens, output_tokens, cost_usd, ts)."""
        base, deltas = self._parts()
        if batch <= base:
            return
        sums = [F.count("*").alias("events"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES[1:]), F.max(F.col("ts").cast("timestamp")).alias("last_ts")]
        costed.groupBy("model", "step").agg(*sums).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/delta-{batch}")
        if len(deltas) + 1 >= MOST_DELTAS:
            self.fold()

    def fold(self) -> None:
        """All deltas into a new base. The old ones go once the new base is whole."""
        base, deltas = self._parts()
        if not deltas:
            return
        self.read().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{deltas[-1]}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for old in [f"base-{base}"] * (base >= 0) + [f"delta-{b}" for b in deltas]:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
            where.getFileSystem(conf).delete(where, True)

    def read(self) -> DataFrame:
        """(model, step, events, input_tokens, output_tokens, cost_usd, last_ts) so far."""
        base, deltas = self._parts()
        paths = [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/delta-{b}" for b in deltas]
        kind = "model string, step string, events long, input_tokens long, output_tokens long, cost_usd double, last_ts timestamp"
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.groupBy("model", "step").agg(*(F.sum(c).alias(c) for c in MEASURES), F.max("last_ts").alias("last_ts"))

    def usage(self) -> DataFrame:
        """As observe.usage(): by model, by step and in total."""
        sets = self.read().groupingSets([["model"], ["step"], []], "model", "step")
        return sets.agg(F.grouping_id().alias("level"), *(F.sum(c).alias(c) for c in MEASURES[:3]), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def follow_ledger(costed: DataFrame, totals: LedgerTotals, checkpoint: str) -> None:
    """Add what has come to the totals, and end; the next call goes on from the checkpoint. A batch that is repeated after a failure is added once."""
    costed.writeStream.foreachBatch(totals.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
