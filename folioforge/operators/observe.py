"""Observability and control: token ledger, stage events, progress, batches, namespaces, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# US dollars for a million tokens, and the stages of a document in order.
PRICES = {
    "gpt-4.1_input": 3.00,
    "gpt-4.1_output": 12.00,
    "gpt-4o_input": 2.50,
    "gpt-4o_output": 10.00,
    "gpt-4o-mini_input": 0.15,
    "gpt-4o-mini_output": 0.60,
    "text-embedding-3-large_input": 0.13,
    "text-embedding-3-small_input": 0.02,
    "text-embedding-ada-002_input": 0.10,
}
STAGES = [
    "uploaded",
    "ocr_in_progress",
    "ocr_completed",
    "enhancement_in_progress",
    "enhancement_completed",
    "auto_approval_completed",
    "synthesis_in_progress",
    "synthesis_completed",
    "vectorization_in_progress",
    "vectorization_completed",
    "ready",
]
DEFAULT_STAGE_SECONDS = 60.0


def price_table(spark: SparkSession, prices: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((prices or PRICES).items()), "key string, usd double")


def with_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events (model, input_tokens, output_tokens) with cost_usd; unknown models cost nothing. prices: a handful of rows."""
    p = prices.select(F.regexp_extract("key", "^(.*)_(input|output)$", 1).alias("model"), F.regexp_extract("key", "^(.*)_(input|output)$", 2).alias("side"), "usd")
    wide = p.groupBy("model").agg(F.max(F.when(F.col("side") == "input", F.col("usd"))).alias("_in"), F.max(F.when(F.col("side") == "output", F.col("usd"))).alias("_out"))
    cost = (F.col("input_tokens") * F.coalesce("_in", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("_out", F.lit(0.0))) / 1_000_000
    return events.join(wide, "model", "left").withColumn("cost_usd", cost).drop("_in", "_out")


def totals(costed: DataFrame) -> DataFrame:
    """One row, zeros for an empty ledger."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return costed.agg(F.count("*").alias("events"), zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), F.round(zero("cost_usd"), 4).alias("cost_usd"), F.max("ts").alias("last_ts"))


def usage(costed: DataFrame) -> DataFrame:
    """By model, by step and in total in one pass of grouping sets."""
    sets = costed.groupingSets([["model"], ["step"], []], "model", "step")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def recent(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("ts"), "event_id").limit(n)


def render_summary(costed: DataFrame, last: int = 10) -> DataFrame:
    """One row of Markdown: totals, a table by model, one by step, and the last events by time."""

    def rows(level: int, key: str, line: Column) -> Column:
        kept = F.collect_list(F.when(F.col("level") == level, F.struct(F.col(key).alias("k"), line.alias("line"))))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "\n")

    model = F.format_string("| `%s` | %d | %d | $%.4f |", F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cost_usd"))
    step = F.format_string("| `%s` | %d | %d | %d |", F.col("step"), F.col("events"), F.col("input_tokens"), F.col("output_tokens"))
    whole = F.format_string("Events: %d\nTotal tokens: %d, cost: $%.4f\nInput: %d\nOutput: %d", F.col("events"), F.col("input_tokens") + F.col("output_tokens"), F.col("cost_usd"), F.col("input_tokens"), F.col("output_tokens"))
    parts = usage(costed).agg(F.max(F.when(F.col("level") == 3, whole)).alias("total"), rows(1, "model", model).alias("models"), rows(2, "step", step).alias("steps"))
    when = F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss")
    event = F.format_string("| %s | `%s` | `%s` | %d/%d |", when, F.col("step"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    newest = recent(costed, last).select(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("o"), "event_id", event.alias("line")).alias("x"))
    newest = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("newest"))
    return parts.crossJoin(F.broadcast(newest)).select(
        F.concat(
            F.lit("# Token usage\n\n"), "total", F.lit("\n\n## By model\n\n| Model | Input | Output | Cost |\n|---|---|---|---|\n"), "models",
            F.lit("\n\n## By step\n\n| Step | Events | Input | Output |\n|---|---|---|---|\n"), "steps", F.lit("\n\n## Last events\n\n| Time | Step | Model | In/Out |\n|---|---|---|---|\n"), "newest",
        ).alias("markdown")
    )


def render_report(costed: DataFrame, generated: Column, last: int = 10) -> DataFrame:
    """render_summary() with a head, the times of the report and of the latest event (the report's where there is none), and thousands separated by commas."""
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss 'UTC'")

    def listed(level: int, key: str, line: Column) -> Column:
        kept = F.collect_list(F.when(F.col("level") == level, F.struct(F.col(key).alias("k"), line.alias("line"))))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "\n")

    number = lambda c: F.format_string("%,d", F.coalesce(F.col(c), F.lit(0)).cast("long"))
    cell = lambda *parts: F.concat(F.lit("| "), *(p for part in parts for p in (part, F.lit(" | "))))
    money = lambda: F.format_string("$%.4f", F.coalesce(F.col("cost_usd"), F.lit(0.0)))
    name = lambda c: F.concat(F.lit("`"), F.coalesce(F.col(c), F.lit("unknown")), F.lit("`"))
    all_tokens = F.format_string("%,d", F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0)).cast("long"))
    whole = F.concat(F.lit("**Total events:** "), number("events"), F.lit("\n\n- Tokens: "), all_tokens, F.lit("\n  - Input: "), number("input_tokens"), F.lit("\n  - Output: "), number("output_tokens"), F.lit("\n- Estimated cost: "), money())
    parts = usage(costed).agg(
        F.max(F.when(F.col("level") == 3, whole)).alias("total"), listed(1, "model", cell(name("model"), number("input_tokens"), number("output_tokens"), money())).alias("models"),
        listed(2, "step", cell(name("step"), number("events"), number("input_tokens"), number("output_tokens"))).alias("steps"),
    )
    at = F.col("ts").cast("timestamp")
    event = cell(F.date_format(at, "HH:mm:ss"), name("step"), name("model"), F.concat(number("input_tokens"), F.lit("/"), number("output_tokens")))
    newest = recent(costed, last).select(F.struct((-F.unix_micros(at)).alias("o"), "event_id", event.alias("line")).alias("x"), at.alias("t"))
    newest = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("newest"), F.max("t").alias("latest"))
    row = parts.crossJoin(F.broadcast(newest))  # a row each
    return row.select(
        F.concat(
            F.lit("# Token usage\n\n**Generated:** "), stamp(generated), F.lit("\n**Latest event:** "), stamp(F.coalesce("latest", generated)), F.lit("\n"), F.coalesce("total", F.lit("**Total events:** 0\n\n- Tokens: 0\n  - Input: 0\n  - Output: 0\n- Estimated cost: $0.0000")),
            F.lit("\n\n## By model\n\n| Model | Input | Output | Cost |\n|---|---|---|---|\n"), "models", F.lit("\n\n## By step\n\n| Step | Events | Input | Output |\n|---|---|---|---|\n"), "steps",
            F.lit("\n\n## Last events\n\n| Time | Step | Model | In/Out |\n|---|---|---|---|\n"), "newest",
        ).alias("markdown")
    )


def stage_durations(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events with the seconds since the entity's previous one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("seconds", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1e6)


def latest_state(events: DataFrame, key: str = "doc_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"), F.count("*").alias("transitions"))


def stage_index(stage: Column) -> Column:
    """Place of a stage, null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1, F.lit(-1))


def progress(stage: Column, corrected: bool = False) -> Column:
    """Whole percent; the legacy rule never reaches 100, the corrected one does."""
    last = len(STAGES) - 1 if corrected else len(STAGES)
    return F.coalesce(F.floor(stage_index(stage) * 100 / last), F.lit(0)).cast("int")


def eta(states: DataFrame) -> DataFrame:
    """Seconds left from (stage, avg_seconds, elapsed, percentage): the rest of this stage and an average one for each further."""
    average = F.coalesce("avg_seconds", F.lit(DEFAULT_STAGE_SECONDS))
    here = F.when(F.col("percentage") > 0, F.col("elapsed") / F.col("percentage") * 100 - F.col("elapsed")).otherwise(average)
    return states.withColumn("eta_seconds", F.floor(here + (len(STAGES) - 1 - stage_index(F.col("stage"))) * average).cast("long"))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events whose stage isn't one, for the caller to refuse."""
    return events.filter(stage_index(F.col("stage")).isNull())


def transitions(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """Events with ``previous`` and ``verdict``: unknown (refused), first, forward, same or back, by the stages' order."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    here, before = stage_index(F.col("stage")), stage_index(F.col("previous"))
    verdict = F.when(here.isNull(), "unknown").when(before.isNull(), "first").when(here > before, "forward").when(here == before, "same").otherwise("back")
    known = F.when(here.isNotNull(), F.col("stage"))
    return events.withColumn("previous", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("verdict", verdict)


def total_durations(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total_seconds, stages, avg_seconds): the sum of an entity's stage durations, and their mean or the default."""
    timed = stage_durations(events, key)
    return timed.groupBy(key).agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"), F.count("seconds").alias("stages"), F.coalesce(F.avg("seconds"), F.lit(DEFAULT_STAGE_SECONDS)).alias("avg_seconds"))


def eta_from_events(events: DataFrame, now: Column, key: str = "doc_id", percentage: str | None = None) -> DataFrame:
    """(key, stage, avg_seconds, eta_seconds): eta() with the mean of the entity's own finished stages, from its events alone."""
    last = F.max_by(F.struct("stage", F.col("ts").alias("since"), *([percentage] if percentage else [])), F.struct("ts", "event_id"))
    state = events.groupBy(key).agg(last.alias("s")).select(key, "s.*").join(total_durations(events, key), key)
    elapsed = (F.unix_micros(now) - F.unix_micros(F.col("since").cast("timestamp"))) / 1e6
    state = state.withColumn("elapsed", elapsed).withColumn("percentage", F.coalesce(F.col(percentage).cast("double"), F.lit(0.0)) if percentage else F.lit(0.0))
    return eta(state).select(key, "stage", "avg_seconds", "eta_seconds")


def attach_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """(batch, doc_id, status, seconds, error): files with their results by doc_id. No result, or one that isn't completed, is a failure."""
    done = results.select("doc_id", F.col("status").alias("_status"), "seconds", "error")
    status = F.when(F.col("_status") == "completed", "completed").otherwise("failed")
    error = F.when(F.col("_status").isNull(), F.coalesce(F.col("error"), F.lit("no result"))).otherwise(F.col("error"))
    return files.select("batch", "doc_id").join(done, "doc_id", "left").select("batch", "doc_id", status.alias("status"), "seconds", error.alias("error"))


def add_counts(counters: DataFrame, additions: DataFrame, key: str = "namespace") -> DataFrame:
    """(key, document_count, total_chunks, total_tokens, created_at, last_updated): counters with additions (documents, chunks, tokens, ts); new keys start at 0."""
    added = additions.select(key, F.col("documents").alias("document_count"), F.col("chunks").alias("total_chunks"), F.col("tokens").alias("total_tokens"), F.col("ts").alias("created_at"), F.col("ts").alias("last_updated"))
    both = counters.select(*added.columns).unionByName(added)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("document_count", "total_chunks", "total_tokens")]
    return both.groupBy(key).agg(*sums, F.min("created_at").alias("created_at"), F.max("last_updated").alias("last_updated"))


def batch_summary(files: DataFrame) -> DataFrame:
    """(batch, total, completed, failed, processing, pending, avg_seconds): failures count as such whatever way they came."""
    n = lambda s: F.count_if(F.col("status") == s)
    return files.groupBy("batch").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("processing").alias("processing"), n("pending").alias("pending"), F.coalesce(F.avg(F.when(F.col("status") == "completed", F.col("seconds"))), F.lit(0.0)).alias("avg_seconds"))


def enabled(switches: DataFrame) -> DataFrame:
    """(owner, ordinal, key) of switches that are on; keys with an underscore are comments."""
    return switches.filter((F.col("value") == 1) & ~F.col("key").startswith("_")).select("owner", "ordinal", "key")


def primary_domain(switches: DataFrame) -> DataFrame:
    """First domain that is on in the profile's order, else 'other'."""
    on = enabled(switches).groupBy("owner").agg(F.min_by("key", "ordinal").alias("domain"))
    return switches.select("owner").distinct().join(on, "owner", "left").select("owner", F.coalesce("domain", F.lit("other")).alias("domain"))


def applicable(types: DataFrame, domain: str) -> DataFrame:
    return types.filter(F.array_contains("applicable_domains", "all") | F.array_contains("applicable_domains", domain))


def recommend(types: DataFrame, sets: DataFrame, domain: str) -> DataFrame:
    """Types recommended for a domain, or the default set's. sets: domain, type_id, rank."""
    mine = sets.filter(F.col("domain") == domain)
    default = sets.filter(F.col("domain") == "default").join(mine.select(F.lit("default").alias("domain")).distinct(), "domain", "left_anti")
    return mine.unionByName(default).join(types, "type_id").orderBy("rank")


def namespace_overview(namespaces: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: namespaces, active and final ones, documents; missing counters are 0."""
    joined = namespaces.join(metadata, "id", "left")
    docs = F.coalesce("document_count", F.lit(0))
    return joined.agg(F.count("*").alias("total"), F.count_if(docs > 0).alias("active"), F.count_if(F.col("type") == "final").alias("final"), F.count_if(F.col("type") == "testing").alias("testing"), F.sum(docs).alias("documents"))


def kv_put(store: DataFrame, entries: DataFrame) -> DataFrame:
    """Key-value cache: keys are sha256 of their text, the newest entry of a key wins."""
    hashed = entries.select(F.sha2("key", 256).alias("k"), "v", "ts")
    both = store.select("k", "v", "ts").unionByName(hashed)
    return both.groupBy("k").agg(F.max_by("v", F.struct("ts", "v")).alias("v"), F.max("ts").alias("ts"))


def sanitise(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata as scalars or lists of strings; whatever else becomes JSON."""
    out = metadata
    for c in columns:
        kind = out.schema[c].dataType.simpleString()
        if kind.startswith("array<"):
            out = out.withColumn(c, F.transform(c, lambda x: x.cast("string")))
        elif kind.startswith(("struct", "map", "variant")):
            out = out.withColumn(c, F.to_json(c))
    return out
