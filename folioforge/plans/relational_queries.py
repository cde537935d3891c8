"""Queries of layout, ledger, state, tenancy, configuration and the relational baseline, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout, observe
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Boxes derived from line items: an order is a document, its lines are blocks, returned lines are tables.
_BLOCKS = """SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS block_idx, l_returnflag, x0, y0, x0 + 50 + l_quantity * 4 AS x1, y0 + 10 + (l_partkey % 3) * 6 AS y1, text, l_suppkey, l_partkey FROM (
SELECT *, (l_partkey % 40) * 10.0::DOUBLE AS x0, (l_suppkey % 70) * 10.0::DOUBLE AS y0, CASE l_partkey % 5 WHEN 0 THEN 'Table 1: parts' WHEN 1 THEN 'Source: list' ELSE 'line ' || l_partkey || ' of part' END AS text FROM lineitem)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    text = F.when(k % 5 == 0, "Table 1: parts").when(k % 5 == 1, "Source: list").otherwise(F.concat(F.lit("line "), k.cast("string"), F.lit(" of part")))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("block_idx"), "l_returnflag", "l_quantity", "l_suppkey", "l_partkey",
        ((k % 40) * 10.0).alias("x0"), ((F.col("l_suppkey") % 70) * 10.0).alias("y0"), text.alias("text"), F.lit("text").alias("type"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )
    return rows.withColumn("x1", F.col("x0") + 50 + F.col("l_quantity") * 4).withColumn("y1", F.col("y0") + 10 + (F.col("l_partkey") % 3) * 6).drop("l_quantity")


def _int(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


_ZONES = f"SELECT doc_id, page, greatest(0, x0 - 5) AS zx0, greatest(0, y0 - 5) AS zy0, least(612, x1 + 5) AS zx1, least(792, y1 + 5) AS zy1 FROM ({_BLOCKS}) WHERE l_returnflag = 'R'"
_MARKED = f"""SELECT b.doc_id, b.page, b.block_idx, b.x0, b.y0, b.x1, b.y1, b.text, b.l_suppkey, b.l_partkey, b.l_returnflag, bool_or(coalesce(zx0 IS NOT NULL AND
greatest(0, least(x1, zx1) - greatest(x0, zx0)) * greatest(0, least(y1, zy1) - greatest(y0, zy0)) / ((x1 - x0) * (y1 - y0)) > CASE WHEN (y1 <= zy0 + 5 AND contains(text, ':')) OR y0 >= zy1 - 5 THEN 0.5 ELSE 0.15 END AND NOT ((x1 - x0) * (y1 - y0) > 5000 OR length(text) > 100), false)) AS dropped,
bool_or(coalesce(x0 >= zx0 AND y0 >= zy0 AND x1 <= zx1 AND y1 <= zy1, false)) AS inside
FROM (SELECT * FROM ({_BLOCKS}) WHERE l_returnflag <> 'R') b LEFT JOIN ({_ZONES}) z ON b.doc_id = z.doc_id AND b.page = z.page GROUP BY ALL"""


@query(f"SELECT doc_id, page, block_idx FROM (SELECT *, bool_and(dropped) OVER (PARTITION BY doc_id, page) AS alone FROM ({_MARKED})) WHERE CASE WHEN alone THEN NOT inside ELSE NOT dropped END")
def zone_exclusion(spark, d):
    b = blocks(spark, d)
    kept = layout.outside_zones(b.filter("l_returnflag <> 'R'"), layout.zones(b.filter("l_returnflag = 'R'")))
    return _int(kept.select("doc_id", "page", "block_idx"), "page", "block_idx")


@query(f"SELECT doc_id, page, count(*) AS rescued FROM (SELECT *, bool_and(dropped) OVER (PARTITION BY doc_id, page) AS alone FROM ({_MARKED})) WHERE alone AND NOT inside GROUP BY doc_id, page")
def containment_fallback(spark, d):
    b = blocks(spark, d)
    text, areas = b.filter("l_returnflag <> 'R'"), layout.zones(b.filter("l_returnflag = 'R'"))
    verdicts = layout.zone_verdicts(text, areas).filter("_alone and not _inside")
    got = verdicts.groupBy(*layout.PAGE).agg(F.count("*").alias("rescued"))
    return _int(got, "page")


@query(f"SELECT doc_id, page, block_idx, round(least(612.0, greatest(0, CASE l_suppkey % 4 WHEN 1 THEN y0 WHEN 2 THEN 612 - x1 WHEN 3 THEN 792 - y1 ELSE x0 END)), 6) AS a, round(least(612.0, greatest(0, CASE l_suppkey % 4 WHEN 1 THEN y1 WHEN 2 THEN 612 - x0 WHEN 3 THEN 792 - y0 ELSE x1 END)), 6) AS b FROM ({_BLOCKS})")
def bbox_normalize(spark, d):
    b = blocks(spark, d)
    n = G.normalise(G.box(), F.col("page_width"), F.col("page_height"), (F.col("l_suppkey") % 4) * 90, F.lit(False))
    return _int(b.select("doc_id", "page", "block_idx", F.round(n[0], 6).alias("a"), F.round(n[2], 6).alias("b")), "page", "block_idx")


_I = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"""SELECT a.doc_id, a.page, a.block_idx AS i, b.block_idx AS j, round({_I} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_I}), 6) AS iou, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0), 6) AS x_overlap
FROM ({_BLOCKS}) a JOIN ({_BLOCKS}) b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_idx < b.block_idx""")
def bbox_overlap(spark, d):
    b = blocks(spark, d).select("doc_id", "page", "block_idx", "x0", "y0", "x1", "y1")
    o = b.select("doc_id", "page", *(F.col(c).alias(f"o_{c}") for c in ("block_idx", "x0", "y0", "x1", "y1")))
    pairs = b.join(o, layout.PAGE).filter("block_idx < o_block_idx")
    got = pairs.select("doc_id", "page", F.col("block_idx").alias("i"), F.col("o_block_idx").alias("j"), F.round(G.iou(G.box(), G.box("o_")), 6).alias("iou"), F.round(G.x_overlap(G.box(), G.box("o_")), 6).alias("x_overlap"))
    return _int(got, "page", "i", "j")


_PAGES = """SELECT l_suppkey % 50 AS doc_id, l_linenumber AS page, (l_partkey % 40) * 10.0::DOUBLE + (50 + l_quantity * 4) / 2 AS x FROM lineitem"""


@query(f"""SELECT doc_id, page, CASE WHEN n >= 5 AND l > 3 AND r > 3 AND coalesce(rmin - lmax > 0.05 * 612, false) THEN 'two_column' ELSE 'single' END AS layout FROM (
SELECT doc_id, page, count(*) AS n, count(*) FILTER (x < 306) AS l, count(*) FILTER (x >= 306) AS r, max(x) FILTER (x < 306) AS lmax, min(x) FILTER (x >= 306) AS rmin FROM ({_PAGES}) GROUP BY doc_id, page)""")
def column_detect(spark, d):
    b = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("doc_id"), F.col("l_linenumber").alias("page"), ((F.col("l_partkey") % 40) * 10.0).alias("x0"), F.col("l_quantity"), F.lit("text").alias("type"), F.lit(612.0).alias("page_width"))
    b = b.withColumn("x1", F.col("x0") + 50 + F.col("l_quantity") * 4)
    return _int(layout.detect_columns(b).select("doc_id", "page", "layout"), "page")


@query("""SELECT doc_id, page, CASE WHEN n >= 5 AND l > 3 AND r > 3 AND coalesce(rmin - lmax > 0.05 * 612, false) THEN 'two_column' ELSE 'single' END AS layout FROM (
SELECT doc_id, page, count(*) AS n, count(*) FILTER (x < 306) AS l, count(*) FILTER (x >= 306) AS r, max(x) FILTER (x < 306) AS lmax, min(x) FILTER (x >= 306) AS rmin FROM (
SELECT l_orderkey // 4 AS doc_id, l_linenumber % 2 AS page, (l_partkey % 40) * 10.0::DOUBLE + (50 + l_quantity * 4) / 2 AS x FROM lineitem) GROUP BY doc_id, page)""")
def column_detect_all(spark, d):
    """Every block, on pages small enough that some have two columns by themselves."""
    x0 = (F.col("l_partkey") % 40) * 10.0
    b = table(spark, d, "lineitem").select(F.expr("l_orderkey div 4").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), x0.alias("x0"), (x0 + 50 + F.col("l_quantity") * 4).alias("x1"), F.lit("text").alias("type"), F.lit(612.0).alias("page_width"))
    return _int(layout.detect_columns(b).select("doc_id", "page", "layout"), "page")


@query(f"""SELECT doc_id, page, block_idx, CASE WHEN (x0 + x1) / 2 < 306 THEN 'left' ELSE 'right' END || '_' || (row_number() OVER (PARTITION BY doc_id, page, (x0 + x1) / 2 < 306 ORDER BY y0, x0, block_idx) - 1) AS place FROM ({_BLOCKS})""")
def unit_numbering(spark, d):
    b = blocks(spark, d)
    two = b.select(*layout.PAGE).distinct().withColumn("layout", F.lit("two_column")).withColumn("boundary", F.lit(306.0))
    u = layout.number_units(layout.assign_columns(b, two))
    return _int(u.select("doc_id", "page", "block_idx", F.concat_ws("_", "column", F.col("ordinal").cast("string")).alias("place")), "page", "block_idx")


@query()
def paragraph_merge(spark, d):
    return layout.merge_paragraphs(blocks(spark, d).withColumn("column", F.lit("single")))


@query(f"SELECT doc_id, page, block_idx FROM ({_BLOCKS}) WHERE NOT (y0 < 50 OR y1 > 742) OR y1 - y0 > 15 OR (x1 - x0) / 612 > 0.5 OR text = 'Source: list' OR text = 'Table 1: parts' OR regexp_matches(text, '^line \\d+ of part$')")
def edge_filter(spark, d):
    return _int(layout.edge_filter(blocks(spark, d)).select("doc_id", "page", "block_idx"), "page", "block_idx")


@query(f"SELECT doc_id, page, sum(CASE WHEN l_returnflag = 'R' THEN (x1 - x0) * (y1 - y0) ELSE 0 END) / (612.0 * 792) > 0.7 OR (sum((l_returnflag <> 'R')::INT) < 3 AND sum((l_returnflag = 'R')::INT) >= 2) AS scanned FROM ({_BLOCKS}) GROUP BY doc_id, page")
def scanned_pages(spark, d):
    b = blocks(spark, d).withColumn("type", F.when(F.col("l_returnflag") == "R", "figure").otherwise("text"))
    return _int(layout.scanned_pages(b), "page")


# Ledger: events as token events; the user stands for the model, the whole part of the value for tokens.
_MODELS = "CASE user_id % 4 WHEN 0 THEN 'gpt-4.1' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'text-embedding-3-small' ELSE 'unknown' END"
_PRICE_IN = "CASE model WHEN 'gpt-4.1' THEN 3.0 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'text-embedding-3-small' THEN 0.02 ELSE 0 END::DOUBLE"
_PRICE_OUT = "CASE model WHEN 'gpt-4.1' THEN 12.0 WHEN 'gpt-4o-mini' THEN 0.60 ELSE 0 END::DOUBLE"
_LEDGER = f"SELECT *, (input_tokens * {_PRICE_IN} + output_tokens * {_PRICE_OUT}) / 1000000 AS cost_usd FROM (SELECT event_id, ts, event_type AS step, {_MODELS} AS model, trunc(value)::BIGINT AS input_tokens, event_id % 97 AS output_tokens FROM events)"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 4
    model = F.when(k == 0, "gpt-4.1").when(k == 1, "gpt-4o-mini").when(k == 2, "text-embedding-3-small").otherwise("unknown")
    e = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("step"), model.alias("model"), F.col("value").cast("long").alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"))
    return observe.with_cost(e, observe.price_table(spark))


@query(f"SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ({_LEDGER}) GROUP BY model")
def cost_by_model(spark, d):
    return ledger(spark, d).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


@query(f"SELECT step, count(*) AS events, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM ({_LEDGER}) GROUP BY step")
def usage_by_step(spark, d):
    return ledger(spark, d).groupBy("step").agg(F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(f"SELECT model, step, grouping(model) * 2 + grouping(step) AS level, count(*) AS events, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ({_LEDGER}) GROUP BY GROUPING SETS ((model), (step), ())")
def usage_grouping_sets(spark, d):
    return observe.usage(ledger(spark, d))


@query(f"SELECT count(*) AS events, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, epoch_us(max(ts)) AS last_us FROM ({_LEDGER})")
def ledger_totals(spark, d):
    return observe.totals(ledger(spark, d)).select("events", "input_tokens", "output_tokens", "cost_usd", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"))


@query(f"SELECT event_id, model, step, input_tokens FROM ({_LEDGER}) ORDER BY ts DESC, event_id LIMIT 10")
def recent_events(spark, d):
    return observe.recent(ledger(spark, d)).select("event_id", "model", "step", "input_tokens")


@query()
def usage_report(spark, d):
    return observe.render_summary(ledger(spark, d))


_STAGES = "[" + ", ".join(f"'{s}'" for s in observe.STAGES) + "]"
_STATES = f"SELECT event_id, ts, user_id AS doc_id, ({_STAGES})[1 + event_id % 11] AS stage FROM events"


def states(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, observe.STAGES)), (1 + F.col("event_id") % 11).cast("int"))
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("doc_id"), stage.alias("stage"))


@query(f"SELECT event_id, doc_id, stage, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id))) / 1e6, 6) AS seconds FROM ({_STATES})")
def stage_durations(spark, d):
    return observe.stage_durations(states(spark, d)).select("event_id", "doc_id", "stage", F.round("seconds", 6).alias("seconds"))


@query(f"SELECT doc_id, arg_max(stage, (ts, event_id)) AS stage, count(*) AS transitions FROM ({_STATES}) GROUP BY doc_id")
def latest_state(spark, d):
    return observe.latest_state(states(spark, d)).select("doc_id", "stage", "transitions")


@query(f"SELECT event_id, (list_position({_STAGES}, stage) - 1) * 100 // 11 AS legacy, (list_position({_STAGES}, stage) - 1) * 100 // 10 AS corrected FROM ({_STATES})")
def progress_pct(spark, d):
    return _int(states(spark, d).select("event_id", observe.progress(F.col("stage")).alias("legacy"), observe.progress(F.col("stage"), corrected=True).alias("corrected")), "legacy", "corrected")


@query(f"""SELECT event_id, floor(CASE WHEN p > 0 THEN e / p * 100 - e ELSE a END + (11 - list_position({_STAGES}, stage)) * a)::BIGINT AS eta_seconds FROM (SELECT event_id, stage, (event_id % 4) * 25.0::DOUBLE AS p, (event_id % 50) * 1.0::DOUBLE AS e, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 90) * 1.0::DOUBLE END, 60.0) AS a FROM ({_STATES}))""")
def eta(spark, d):
    k = F.col("event_id")
    s = states(spark, d).select("event_id", "stage", ((k % 4) * 25.0).alias("percentage"), ((k % 50) * 1.0).alias("elapsed"), F.when(k % 3 == 0, None).otherwise((k % 90) * 1.0).alias("avg_seconds"))
    return observe.eta(s).select("event_id", "eta_seconds")


@query("""SELECT user_id % 20 AS batch, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS processing, count(*) FILTER (event_type NOT IN ('purchase', 'error', 'click')) AS pending, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS avg_seconds FROM events GROUP BY 1""")
def batch_summary(spark, d):
    t = F.col("event_type")
    status = F.when(t == "purchase", "completed").when(t == "error", "failed").when(t == "click", "processing").otherwise("pending")
    got = observe.batch_summary(table(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), status.alias("status"), F.col("value").alias("seconds")))
    return got.withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("SELECT c_custkey AS owner, 'k' || (1 + c_custkey % 3) AS domain FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT c_custkey, 'other' FROM customer WHERE c_custkey % 4 = 3")
def enabled_types(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"))
    switch = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("key")) for i, n in enumerate(["_note", "k1", "k2", "k3"])]))
    on = F.when(F.col("x.key") == "_note", 1).when((F.col("owner") % 4 != 3) & (F.col("x.ordinal") > F.col("owner") % 3), 1).otherwise(0)
    return observe.primary_domain(c.select("owner", switch.alias("x")).select("owner", "x.ordinal", "x.key", on.alias("value")))


_RECOMMENDED = "SELECT '{asked}' AS asked, p_size AS rank, p_partkey AS type_id FROM part WHERE p_brand = '{brand}' AND p_type IN ('ECONOMY', '{kind}')"


@query(" UNION ALL ".join(_RECOMMENDED.format(asked=a, brand=b, kind="SMALL") for a, b in (("Brand#2", "Brand#2"), ("nowhere", "Brand#1"))))
def recommended_types(spark, d):
    """Sets of a registry of parts, a domain a brand, Brand#1's the default one: for a domain that has a set, and for one that has none. Types of other kinds aren't in the registry."""
    parts = table(spark, d, "part")
    types = parts.filter("p_type in ('ECONOMY', 'SMALL')").select(F.col("p_partkey").alias("type_id"))
    sets = parts.select(F.when(F.col("p_brand") == "Brand#1", "default").otherwise(F.col("p_brand")).alias("domain"), F.col("p_partkey").alias("type_id"), F.col("p_size").alias("rank"))
    asked = [observe.recommend(types, sets, name).select(F.lit(name).alias("asked"), "rank", "type_id") for name in ("Brand#2", "nowhere")]
    return asked[0].unionByName(asked[1])


@query("SELECT sha256(c_name) AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name")
def kv_cache(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("key"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("ts"))
    empty = o.select(F.col("key").alias("k"), "v", "ts").limit(0)
    return observe.kv_put(empty, o).select("k", "v")


@query("SELECT count(*) AS total, count(*) FILTER (n > 0) AS active, count(*) FILTER (c_mktsegment = 'BUILDING') AS final, count(*) FILTER (c_mktsegment = 'MACHINERY') AS testing, sum(n)::BIGINT AS documents FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def namespace_overview(spark, d):
    seg = F.col("c_mktsegment")
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(seg == "BUILDING", "final").when(seg == "MACHINERY", "testing").otherwise("other").alias("type"))
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("document_count"))
    return observe.namespace_overview(n, m)


# Relational baseline: not operators of the domain, but what every other query stands on.
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def z_pricing_summary(spark, d):
    f = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return f.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def z_join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def z_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def z_semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_nationkey, s_nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey")
def z_full_join(spark, d):
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("a"))
    b = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("b"))
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full").select("c_nationkey", "s_nationkey", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query("SELECT event_id, prev AS previous_error FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events) WHERE event_type = 'purchase'")
def z_as_of(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").withColumn("previous_error", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w)).filter("event_type = 'purchase'").select("event_id", "previous_error")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def z_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def z_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def z_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 25").select("l_partkey").distinct())


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def z_topk_per_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def z_tumbling_window(spark, d):
    day = F.unix_micros(F.window(F.col("ts").cast("timestamp"), "1 day")["start"])
    return table(spark, d, "events").groupBy(day.alias("day_us"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
