"""Queries of front matter, prompts, configuration and sources, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, config, enrichment, layout, observe, retrieval
from ..sources.tables import accept_uploads, first_non_empty, ingest_markdown, table, words_to_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def s(c: str):
    return F.col(c).cast("string")


@query("""SELECT o_orderkey, '---' || chr(10) || 'title: "Order ' || o_orderkey || '"' || chr(10) || 'document_type: report' || chr(10) || 'language: english' || chr(10) || 'total_pages: ' || (o_orderkey % 9) || chr(10) || 'has_tables: ' || (o_orderkey % 2 = 0) || chr(10) || 'has_images: false' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || 'dates:' || chr(10) || '- ' || strftime(o_orderdate, '%Y-%m-%d') END || chr(10) || '---' || chr(10) AS head FROM orders""")
def front_matter(spark, d):
    k = F.col("o_orderkey")
    dates = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.date_format("o_orderdate", "yyyy-MM-dd")))
    head = assembly.front_matter(F.concat(F.lit("Order "), s("o_orderkey")), F.lit("report"), F.lit("english"), k % 9, k % 2 == 0, F.lit(False), dates)
    return table(spark, d, "orders").select("o_orderkey", head.alias("head"))


@query("""SELECT l_orderkey, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*End of document: ' || count(DISTINCT l_linenumber % 2) || ' pages, ' || count(*) || ' units, ' || count(*) FILTER (l_returnflag = 'R') || ' tables*' || chr(10) AS foot FROM lineitem GROUP BY l_orderkey""")
def document_footer(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("u"), F.count_if(F.col("l_returnflag") == "R").alias("t"), F.countDistinct(F.col("l_linenumber") % 2).alias("p"))
    return per.select("l_orderkey", assembly.footer(F.col("u"), F.col("t"), F.col("p")).alias("foot"))


@query("""SELECT conv_id, count(*) AS total_units, count(*) FILTER (role = 'user') AS text_units, count(*) FILTER (role = 'system') AS table_units, count(*) FILTER (turn % 3 = 0) AS ocr_units, bool_or(role = 'system') AS has_tables, bool_or(turn % 3 = 0) AS has_images FROM conversations GROUP BY conv_id""")
def unit_metrics(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "system", "table").otherwise("other")
    return assembly.unit_metrics(c.select(F.col("conv_id").alias("doc_id"), kind.alias("unit_type"), F.when(F.col("turn") % 3 == 0, "ocr_image").otherwise("text").alias("source"))).withColumnRenamed("doc_id", "conv_id")


@query("""SELECT doc_id, md5('CONTENT:' || chr(10) || substr(text, 1, 12000) || chr(10) || chr(10) || 'TABLES: 0' || chr(10) || 'NUMERIC PATTERNS: {"n":' || n_chars || '}' || chr(10) || 'HINT: ' || lang) AS prompt_md5 FROM documents""")
def window_prompt(spark, d):
    p = enrichment.user_prompt(F.col("text"), F.lit(0), F.struct(F.col("n_chars").alias("n")), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.md5(p).alias("prompt_md5"))


@query("SELECT p_brand, string_agg('- ' || p_type || '_' || p_partkey || ': ' || p_name || CASE WHEN p_size > 25 THEN ' (e.g. ' || p_brand || ')' ELSE '' END, chr(10) ORDER BY p_size, p_type || '_' || p_partkey) AS instructions, count(*) AS n_types FROM part GROUP BY p_brand")
def system_prompt(spark, d):
    """A registry for each brand, of all its parts."""
    return enrichment.system_prompt(part_types(table(spark, d, "part")), "finance", "p_brand")


def part_types(parts):
    examples = F.when(F.col("p_size") > 25, F.create_map(F.lit("finance"), F.col("p_brand"))).otherwise(F.create_map(F.lit("legal"), F.lit("x")))
    return parts.select("p_brand", "p_type", F.concat("p_type", F.lit("_"), s("p_partkey")).alias("type_id"), F.col("p_name").alias("prompt_instructions"), F.col("p_size").alias("display_order"), examples.alias("examples"))


@query("SELECT p_brand, p_type, string_agg('- ' || p_type || '_' || p_partkey || ': ' || p_name || CASE WHEN p_size > 25 THEN ' (e.g. ' || p_brand || ')' ELSE '' END, chr(10) ORDER BY p_size, p_type || '_' || p_partkey) AS instructions, count(*) AS n_types FROM part GROUP BY p_brand, p_type")
def system_prompt_registries(spark, d):
    """Every part, with brand and type as the registry it belongs to."""
    return enrichment.system_prompt(part_types(table(spark, d, "part")), "finance", "p_brand", "p_type")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def namespace_filters(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "final").otherwise("testing")
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), kind.alias("type"), s("c_nationkey").alias("client"))
    return config.by_client(config.production(n), "3").select("id")


@query("SELECT o_custkey + 1000 AS id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey + 1000 NOT IN (SELECT c_custkey FROM customer)")
def unknown_namespaces(spark, d):
    names = table(spark, d, "orders").select((F.col("o_custkey") + 1000).alias("id")).distinct()
    return config.unknown(names, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT event_id, 1 + (event_id % 4 = 0)::INT AS n_units, 'c' || event_id AS first_content FROM events")
def unit_shapes(spark, d):
    """A list, two wrappers and a keyed object."""
    unit = F.concat(F.lit('{"unit_id": "u", "unit_type": "paragraph", "page": 1, "content": "c'), s("event_id"), F.lit('"}'))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("["), unit, F.lit(","), unit, F.lit("]"))).when(k == 1, F.concat(F.lit('{"units": ['), unit, F.lit("]}"))).when(k == 2, F.concat(F.lit('{"content_units": ['), unit, F.lit("]}"))).otherwise(F.concat(F.lit('{"u1": '), unit, F.lit("}")))
    u = table(spark, d, "events").select("event_id", config.unit_list(raw).alias("u"))
    return u.select("event_id", F.size("u").cast("long").alias("n_units"), F.get("u", F.lit(0))["content"].alias("first_content"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN w THEN CASE WHEN l_returnflag = 'R' THEN 612 - c - 50 ELSE 50 END ELSE 10.0 END, 4) AS x0, round(CASE WHEN w THEN CASE WHEN l_returnflag = 'R' THEN 612 - c - 50 ELSE 50 END + c ELSE 10.0 + l_quantity * 12 END, 4) AS x1 FROM (SELECT *, l_quantity * 12 >= 612 * 0.8 AS w, least(l_linenumber * 80.0, 612 * 0.45)::DOUBLE AS c FROM lineitem)""")
def table_narrowing(spark, d):
    x0, x1 = config.narrow_table(F.lit(10.0), 10.0 + F.col("l_quantity") * 12, F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "Price").otherwise("name"), F.lit(612.0))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("l_linenumber"), F.round(x0, 4).alias("x0"), F.round(x1, 4).alias("x1"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN 50 ELSE 612 * 0.55 END, 4)::DOUBLE AS x0, (100 + p_size * 120)::DOUBLE AS y0, round(CASE WHEN p_size % 2 = 0 THEN 50 ELSE 612 * 0.55 END + least((p_partkey % 9) * 70.0, 612 * 0.4, 300.0), 4)::DOUBLE AS x1, (100 + p_size * 120 + p_size * 20 + 40)::DOUBLE AS y1 FROM part")
def table_estimate(spark, d):
    b = config.estimated_table(F.col("p_size"), F.col("p_partkey") % 9, F.col("p_size"), F.lit(612.0))
    return table(spark, d, "part").select("p_partkey", *(F.round(c, 4).alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)))


@query("SELECT user_id % 500 AS batch_id, bool_and(event_type <> 'error') AS accepted, count(*) AS n_files FROM events GROUP BY 1")
def upload_gate(spark, d):
    kind = F.when(F.col("event_type") == "error", "text/html").otherwise("application/pdf")
    return accept_uploads(table(spark, d, "events").select((F.col("user_id") % 500).alias("batch_id"), kind.alias("content_type")))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'demo' AS namespace, 'v2' AS version, length(text) AS n FROM documents WHERE trim(text) <> ''")
def markdown_ingest(spark, d):
    return ingest_markdown(table(spark, d, "documents"), "demo").select("doc_id", "namespace", "version", F.length("text").cast("long").alias("n"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, 'a' AS src FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, 'b' AS src FROM lineitem WHERE l_returnflag = 'A')
SELECT doc_id, page, src, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.page = b.page)) GROUP BY ALL""")
def table_source_choice(spark, d):
    pick = lambda flag, name: table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(name).alias("src"))
    return first_non_empty(pick("R", "a"), pick("A", "b")).groupBy("doc_id", "page", "src").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS doc_id, (l_suppkey % 70) // 10 AS band, string_agg('word' || l_partkey, ' ' ORDER BY (l_partkey % 40) * 10.0, 'word' || l_partkey) AS text FROM lineitem GROUP BY ALL HAVING length(string_agg('word' || l_partkey, ' ')) > 15""")
def words_to_text_lines(spark, d):
    x = (F.col("l_partkey") % 40) * 10.0
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), x.alias("x0"), F.floor((F.col("l_suppkey") % 70) / 10).cast("double").alias("y0"), (x + 5).alias("x1"), F.lit(9.0).alias("y1"), F.concat(F.lit("word"), s("l_partkey")).alias("text"))
    return words_to_lines(w).select("doc_id", F.col("row").alias("band"), "text")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'full_scan' WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 > 0 AND o_totalprice > 50000 THEN 'backup' WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'page' ELSE 'none' END AS ocr_plan FROM orders""")
def ocr_plan(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(k.alias("doc_id"), F.lit(1).alias("page"), (k % 3).alias("n_text"), (k % 5).alias("n_tables"), (F.col("o_totalprice") / 100).alias("simple_chars"), (k % 7 == 0).alias("scanned"))
    return layout.ocr_plan(p).select("doc_id", "ocr_plan")


@query("SELECT l_orderkey AS doc_id, l_linenumber, y < 0.2 OR (y > 0.1 AND y < 0.9 AND l_discount < 0.3) AS eligible FROM (SELECT *, l_tax * 10 / 1.0 AS y FROM lineitem)")
def ocr_eligible(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", layout.ocr_eligible(F.col("l_tax") * 10, F.lit(1.0), F.col("l_discount")).alias("eligible"))


@query("SELECT conv_id, turn, arg_max(t, (length(t), m)) AS best FROM (SELECT conv_id, turn, substr(text, 1, 20 + unnest([1, 2, 3]) * 7) AS t, unnest([1, 2, 3]) AS m FROM conversations) GROUP BY conv_id, turn")
def best_reading(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(1).alias("figure"), "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("mode"))
    r = layout.best_reading(c.withColumn("text", F.substr("text", F.lit(1), 20 + F.col("mode") * 7)))
    return r.select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), F.col("text").alias("best"))


@query("SELECT event_id, to_json({v: [CAST(user_id AS VARCHAR), event_type]}) AS meta FROM events")
def metadata_sanitise(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct(F.array(s("user_id"), F.col("event_type")).alias("v")).alias("meta"))
    return observe.sanitise(e, ["meta"])


@query("SELECT vec_id AS id, 0.5::DOUBLE AS score, 'text ' || vec_id AS snippet, '{\"version\":\"v2\",\"namespace\":\"' || label || '\"}' AS metadata FROM embeddings")
def source_projection(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0.5).alias("score"), F.concat(F.lit("text "), s("vec_id")).alias("text"), F.lit("v2").alias("version"), s("label").alias("namespace"))
    return retrieval.sources(v).withColumn("id", F.col("id").cast("long"))


@query()
def pattern_samples(spark, d):
    return config.pattern_samples(enrichment.pattern_spans(table(spark, d, "documents")))
