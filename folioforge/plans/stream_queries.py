"""Queries of the state machine and the ledger as streams, with their DuckDB equivalents. A stream reads what Spark has written of the given tables, in parts, and goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe
from ..session import scratch
from ..streaming import ledger as L
from ..streaming import stages as S
from .relational_queries import _LEDGER, _STAGES, _STATES, ledger, states

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Seconds that a stage may take in stage_stream.
STAGE_LIMIT = 86_400


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def halves(rows: DataFrame) -> list[DataFrame]:
    """Rows before the middle of their time span, and from there on."""
    middle = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(((F.min("us") + F.max("us")) / 2).cast("long").alias("m")).first()["m"]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(middle or 0)
    return [rows.filter(~late), rows.filter(late)]


@query(f"""WITH e AS (SELECT event_id, doc_id, epoch_us(ts) AS us, CASE WHEN event_id % 7 = 0 THEN 'nowhere' ELSE stage END AS stage FROM ({_STATES})),
k AS (SELECT *, list_position({_STAGES}, stage) - 1 AS place, lag(stage) OVER w AS previous, row_number() OVER w - 1 AS n, us - first_value(us) OVER w AS total, lead(us) OVER w AS next FROM e WHERE stage <> 'nowhere' WINDOW w AS (PARTITION BY doc_id ORDER BY us, event_id)),
u AS (SELECT *, last_value(CASE WHEN stage <> 'nowhere' THEN stage END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e)
SELECT doc_id, event_id, us AS at_us, stage, previous, CASE WHEN previous IS NULL THEN 'first' WHEN place > list_position({_STAGES}, previous) - 1 THEN 'forward' WHEN stage = previous THEN 'same' ELSE 'back' END AS verdict, place * 100 // 11 AS progress, CASE WHEN n = 0 THEN (11 - place) * 60 ELSE (11 - place) * total // (n * 1000000) END AS eta_seconds FROM k
UNION ALL SELECT doc_id, event_id, us, stage, previous, 'unknown', NULL, NULL FROM u WHERE stage = 'nowhere'
UNION ALL SELECT doc_id, NULL, us + {STAGE_LIMIT * 1_000_000}, stage, stage, 'failed', NULL, NULL FROM k WHERE stage <> 'ready' AND CASE WHEN next IS NULL THEN us + {STAGE_LIMIT * 1_000_000} < (SELECT max(us) FROM e) - 60000000 ELSE next - us > {STAGE_LIMIT * 1_000_000} END""")
def stage_stream(spark, d):
    """The state machine over two halves of the events, the second run begun from the checkpoint of the first."""
    S.state_store(spark)
    rows = states(spark, d).withColumn("stage", F.when(F.col("event_id") % 7 == 0, "nowhere").otherwise(F.col("stage")))
    source, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for part in halves(rows):
        part.write.mode("append").parquet(source)
        S.run_available(S.stage_rows(spark.readStream.schema(rows.schema).parquet(source), STAGE_LIMIT), out, checkpoint)
    return spark.read.schema(S.OUT).parquet(out)


@query(f"SELECT model, step, grouping(model) * 2 + grouping(step) AS level, count(*) AS events, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ({_LEDGER}) GROUP BY GROUPING SETS ((model), (step), ())")
def ledger_stream(spark, d):
    """The ledger's totals, added to batch by batch; one batch is given twice and changes nothing."""
    rows = table_of_events(spark, d)
    source, checkpoint, totals = scratch(spark), scratch(spark), L.LedgerTotals(spark, scratch(spark))
    cost = lambda e: observe.with_cost(e, observe.price_table(spark))
    for n, part in enumerate(halves(rows)):
        part.write.mode("append").parquet(source)
        L.follow_ledger(cost(spark.readStream.schema(rows.schema).parquet(source)), totals, checkpoint)
        totals.add(cost(part), n)
    totals.fold()
    return totals.usage()


def table_of_events(spark, d) -> DataFrame:
    """Token events without their costs."""
    return ledger(spark, d).drop("cost_usd")


@query(f"""WITH e AS ({_LEDGER}), t AS (SELECT count(*) AS n, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, round(sum(cost_usd), 4) AS c, strftime(max(ts), '%Y-%m-%d %H:%M:%S UTC') AS last FROM e),
m AS (SELECT string_agg(format('| `{{}}` | {{:,}} | {{:,}} | ${{:.4f}} | ', model, i, o, c), chr(10) ORDER BY model) AS x FROM (SELECT model, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o, round(sum(cost_usd), 4) AS c FROM e GROUP BY model)),
p AS (SELECT string_agg(format('| `{{}}` | {{:,}} | {{:,}} | {{:,}} | ', step, n, i, o), chr(10) ORDER BY step) AS x FROM (SELECT step, count(*) AS n, sum(input_tokens)::BIGINT AS i, sum(output_tokens)::BIGINT AS o FROM e GROUP BY step)),
l AS (SELECT string_agg(format('| {{}} | `{{}}` | `{{}}` | {{:,}}/{{:,}} | ', strftime(ts, '%H:%M:%S'), step, model, input_tokens, output_tokens), chr(10) ORDER BY ts DESC, event_id) AS x FROM (SELECT * FROM e ORDER BY ts DESC, event_id LIMIT 10))
SELECT '# Token usage' || chr(10) || chr(10) || '**Generated:** 2024-07-01 12:00:00 UTC' || chr(10) || '**Latest event:** ' || t.last || chr(10) || format('**Total events:** {{:,}}', t.n) || chr(10) || chr(10) || format('- Tokens: {{:,}}', t.i + t.o) || chr(10) || format('  - Input: {{:,}}', t.i) || chr(10) || format('  - Output: {{:,}}', t.o) || chr(10) || format('- Estimated cost: ${{:.4f}}', t.c)
|| chr(10) || chr(10) || '## By model' || chr(10) || chr(10) || '| Model | Input | Output | Cost |' || chr(10) || '|---|---|---|---|' || chr(10) || m.x || chr(10) || chr(10) || '## By step' || chr(10) || chr(10) || '| Step | Events | Input | Output |' || chr(10) || '|---|---|---|---|' || chr(10) || p.x
|| chr(10) || chr(10) || '## Last events' || chr(10) || chr(10) || '| Time | Step | Model | In/Out |' || chr(10) || '|---|---|---|---|' || chr(10) || l.x AS markdown FROM t, m, p, l""")
def ledger_report(spark, d):
    """The ledger's summary with its head, as of a given time."""
    return observe.render_report(ledger(spark, d), F.lit("2024-07-01 12:00:00").cast("timestamp"))
