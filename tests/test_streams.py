"""State machine and ledger as streams: order, restart, timers, repeated batches."""

from pyspark.sql import functions as F

from folioforge.operators import observe
from folioforge.streaming import ledger as L
from folioforge.streaming import stages as S

KIND = "event_id long, doc_id long, ts timestamp, stage string"


def rows_of(spark, tmp_path, batches, limit=100):
    S.state_store(spark)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in batches:
        frame = spark.createDataFrame([(e, d, s, g) for e, d, s, g in batch], "event_id long, doc_id long, s long, stage string")
        frame.select("event_id", "doc_id", F.timestamp_seconds("s").alias("ts"), "stage").coalesce(1).write.mode("append").parquet(source)
        S.run_available(S.stage_rows(spark.readStream.schema(KIND).parquet(source), limit), out, checkpoint)
    got = spark.read.schema(S.OUT).parquet(out).collect()
    return sorted(((r["doc_id"], r["at_us"] // 1_000_000, r["event_id"], r["stage"], r["verdict"], r["progress"], r["eta_seconds"]) for r in got), key=str)


def test_stages_by_time_and_over_a_restart(spark, tmp_path):
    first = [(2, 1, 1040, "ocr_completed"), (1, 1, 1000, "uploaded"), (3, 1, 1050, "nonsense"), (4, 2, 1000, "ready")]
    second = [(5, 1, 1060, "uploaded"), (6, 1, 1070, "uploaded"), (7, 2, 5000, "uploaded"), (8, 3, 9000, "ready")]
    got = rows_of(spark, tmp_path, [first, second])
    want = [
        (1, 1000, 1, "uploaded", "first", 0, 660), (1, 1040, 2, "ocr_completed", "forward", 18, 9 * 40), (1, 1050, 3, "nonsense", "unknown", None, None),
        (1, 1060, 5, "uploaded", "back", 0, 11 * 30), (1, 1070, 6, "uploaded", "same", 0, 11 * 70 // 3), (1, 1170, None, "uploaded", "failed", None, None),
        (2, 1000, 4, "ready", "first", 90, 60), (2, 5000, 7, "uploaded", "back", 0, 11 * 4000), (2, 5100, None, "uploaded", "failed", None, None), (3, 9000, 8, "ready", "first", 90, 60),
    ]
    assert got == sorted(want, key=str)


def test_a_failed_stage_is_told_once(spark, tmp_path):
    """By the watermark first; the late event that follows doesn't repeat it."""
    got = rows_of(spark, tmp_path, [[(1, 1, 1000, "uploaded"), (2, 2, 3000, "ready")], [(3, 1, 4000, "ready")]])
    assert [r for r in got if r[4] == "failed"] == [(1, 1100, None, "uploaded", "failed", None, None)]
    assert (1, 4000, 3, "ready", "forward", 90, 3000) in got


def events(spark, rows):
    frame = spark.createDataFrame(rows, "event_id long, ts long, model string, step string, input_tokens long, output_tokens long")
    return frame.withColumn("ts", F.timestamp_seconds("ts"))


def test_ledger_totals_count_every_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MOST_DELTAS", 3)
    cost = lambda e: observe.with_cost(e, observe.price_table(spark))
    totals, all_rows = L.LedgerTotals(spark, str(tmp_path / "t")), []
    assert totals.read().count() == 0
    for n in range(7):
        rows = [(10 * n + k, 1000 + n, ["gpt-4.1", "other", None][k % 3], "chat", 5 * k, n) for k in range(4)]
        all_rows += rows
        totals.add(cost(events(spark, rows)), n)
        if n % 2:
            totals.add(cost(events(spark, rows)), n)
        if n == 5:
            totals.add(cost(events(spark, all_rows[:4])), 0)  # a batch that is in the base already
    want = observe.usage(cost(events(spark, all_rows)))
    as_set = lambda df: {(r["model"], r["step"], r["level"], r["events"], r["input_tokens"], r["output_tokens"], r["cost_usd"]) for r in df.collect()}
    assert as_set(totals.usage()) == as_set(want)
    assert totals._folders("base") == [5] and totals._folders("delta") == [6]
    assert totals.read().agg(F.max(F.unix_seconds("last_ts"))).first()[0] == 1006


def test_ledger_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    totals, source, checkpoint = L.LedgerTotals(spark, str(tmp_path / "t")), str(tmp_path / "in"), str(tmp_path / "c")
    rows = events(spark, [(k, k, "gpt-4o", "chat", k, 1) for k in range(10)])
    for cond in ("event_id < 4", "event_id >= 4"):
        rows.filter(cond).write.mode("append").parquet(source)
        L.follow_ledger(observe.with_cost(spark.readStream.schema(rows.schema).parquet(source), observe.price_table(spark)), totals, checkpoint)
    assert [tuple(r) for r in totals.read().select("model", "events", "input_tokens", "output_tokens").collect()] == [("gpt-4o", 10, 45, 10)]
