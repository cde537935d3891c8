"""Queries of filters, control, sinks and sources that need files, windows, prompts and synthesis, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, config, enrichment, layout, observe, retrieval, tabular
from ..session import scratch
from ..sources import sinks
from ..sources import tables as T
from ..sources.pages import BLANKS
from ..sources.tables import table
from .document_queries import _DOT, _NORM, vectors
from .relational_queries import _BLOCKS, _LEDGER, _STAGES, _STATES, blocks, ledger, states

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


def long(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


# --- layout filters


@query(f"SELECT doc_id, page, block_idx FROM ({_BLOCKS}) WHERE (y0 + y1) / 2 > 79.2 AND (y0 + y1) / 2 < 712.8")
def margin_filter(spark, d):
    return long(layout.margin_filter(blocks(spark, d), 792 * 0.1, 792 * 0.9).select("doc_id", "page", "block_idx"), "page", "block_idx")


_EDGE_TEXT = ["42", "Annual report, of parts", "Page Header", "page 7", "header", "averyveryverylongsingleword", "2024", "12345"]


@query(f"""SELECT doc_id, page, block_idx FROM (SELECT * REPLACE ((['{"', '".join(_EDGE_TEXT)}'])[1 + l_partkey % 8] AS text) FROM ({_BLOCKS})) WHERE (y0 >= 50 AND y0 <= 742)
OR CASE text WHEN '42' THEN false WHEN '2024' THEN false WHEN 'Annual report, of parts' THEN true WHEN 'Page Header' THEN true WHEN 'page 7' THEN true WHEN 'averyveryverylongsingleword' THEN true ELSE y1 - y0 > 15 END""")
def edge_filter_rules(spark, d):
    """Eight kinds of text at the pages' edges, so that every rule keeps some and drops some."""
    texts = F.element_at(F.array(*map(F.lit, _EDGE_TEXT)), (1 + F.col("l_partkey") % 8).cast("int"))
    return long(layout.edge_filter(blocks(spark, d).withColumn("text", texts)).select("doc_id", "page", "block_idx"), "page", "block_idx")


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || ' '), chr(10)), lambda x: trim(x)), lambda t: length(t) > 20 AND NOT (length(t) < 10 OR (length(t) - length(regexp_replace(t, '[^\p{L}]', '', 'g'))) / greatest(length(t), 1) > 0.7 OR contains(t, '%') OR contains(t, '$') OR contains(t, '|') OR contains(t, 'USD') OR contains(t, 'IDR') OR contains(t, 'Feb') OR contains(t, 'Jan'))), chr(10))) AS kept FROM documents""")
def ocr_line_filter(spark, d):
    """Every sentence of every document as a line of an OCR reading."""
    lines = F.replace("text", F.lit(". "), F.lit(".\n "))
    return table(spark, d, "documents").select("doc_id", F.md5(layout.filter_ocr_lines(lines)).alias("kept"))


@query(f"SELECT doc_id, page, block_idx, crop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_idx, l_partkey) AS crop FROM (SELECT * REPLACE (doc_id // 8 AS doc_id, 0 AS page, doc_id * 10 + block_idx AS block_idx) FROM ({_BLOCKS}))) WHERE crop <= 12")
def figure_crops(spark, d):
    """Eight orders a page, so that pages have more figures than are cropped."""
    b = blocks(spark, d).withColumn("block_idx", F.struct((F.col("doc_id") * 10 + F.col("block_idx")).alias("i"), "l_partkey")).withColumn("doc_id", F.expr("doc_id div 8")).withColumn("page", F.lit(0))
    return long(layout.figure_crops(b).select("doc_id", "page", F.col("block_idx.i").alias("block_idx"), "crop"), "page", "crop")


@query(f"""SELECT doc_id, page, block_idx FROM (SELECT *, lag(y0) OVER w AS py, lag(page) OVER w AS pp FROM ({_BLOCKS}) WINDOW w AS (PARTITION BY doc_id ORDER BY page, x0 // 200, x0, block_idx, l_partkey, l_suppkey)) WHERE pp = page AND py > y0 + 10""")
def order_warnings(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page", F.floor(F.col("x0") / 200), "x0", "block_idx", "l_partkey", "l_suppkey")
    placed = blocks(spark, d).withColumn("place", F.row_number().over(w))
    return long(assembly.order_warnings(placed).select("doc_id", "page", "block_idx"), "page", "block_idx")


@query(f"""WITH RECURSIVE b AS (SELECT doc_id, page, y0, x0, block_idx, x1, y1, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_idx, x1, y1, text) AS k FROM ({_BLOCKS})),
w AS (SELECT doc_id, page, k, 0 AS paragraph, x0, y0, x1, y1, text FROM b WHERE k = 1 UNION ALL
SELECT b.doc_id, b.page, b.k, CASE WHEN m THEN w.paragraph ELSE w.paragraph + 1 END, CASE WHEN m THEN least(w.x0, b.x0) ELSE b.x0 END, CASE WHEN m THEN least(w.y0, b.y0) ELSE b.y0 END, CASE WHEN m THEN greatest(w.x1, b.x1) ELSE b.x1 END, CASE WHEN m THEN greatest(w.y1, b.y1) ELSE b.y1 END, CASE WHEN m THEN w.text || ' ' || b.text ELSE b.text END
FROM w JOIN b ON b.doc_id = w.doc_id AND b.page = w.page AND b.k = w.k + 1, LATERAL (SELECT b.y0 - w.y1 < 20 AND coalesce((least(w.x1, b.x1) - greatest(w.x0, b.x0)) / nullif(greatest(w.x1, b.x1) - least(w.x0, b.x0), 0), 0) > 0.7 AND abs((b.y1 - b.y0) - (w.y1 - w.y0)) < ((w.y1 - w.y0) + (b.y1 - b.y0)) / 2 * 0.5 AND NOT (regexp_matches(trim(w.text), '[.!?]$') AND b.y0 - w.y1 > ((w.y1 - w.y0) + (b.y1 - b.y0)) / 2 * 0.3) AS m))
SELECT doc_id, page, paragraph, arg_max(text, k) AS text, round(arg_max(x0, k), 4) AS x0, round(arg_max(y0, k), 4) AS y0, round(arg_max(x1, k), 4) AS x1, round(arg_max(y1, k), 4) AS y1 FROM w GROUP BY doc_id, page, paragraph""")
def paragraph_boxes(spark, d):
    """paragraph_merge as its SQL can say it: the same blocks, boxes rounded."""
    got = layout.merge_paragraphs(blocks(spark, d).withColumn("column", F.lit("single")))
    return long(got.select("doc_id", "page", "paragraph", "text", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1"))), "page", "paragraph")


@query(f"""SELECT doc_id, page, CASE WHEN count(*) >= 10 AND stddev_pop((x0 + x1) / 2) >= 50 THEN 'two_column' ELSE 'single' END AS layout FROM (SELECT * REPLACE (doc_id // 8 AS doc_id) FROM ({_BLOCKS})) GROUP BY doc_id, page HAVING count(*) > 1""")
def column_clusters(spark, d):
    """Pages of eight orders: two columns where there are enough blocks and they lie far enough apart."""
    b = blocks(spark, d).withColumn("doc_id", F.expr("doc_id div 8"))
    return long(layout.detect_columns_kmeans(b).select("doc_id", "page", "layout"), "page")


@query("""WITH raw AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, (l_partkey % 40) * 10.0 AS x0, (l_suppkey % 70) * 10.0::DOUBLE AS y0, l_quantity AS w, (l_partkey % 3) * 6.0 + 2 AS h, 'text ' || l_partkey AS text FROM lineitem),
poor AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page FROM lineitem GROUP BY ALL HAVING sum((l_returnflag = 'A')::INT) < 3),
a AS (SELECT doc_id, page, 'raw_blocks' AS source, text, y0 FROM raw JOIN poor USING (doc_id, page) WHERE h > 10 AND w > 30 AND length(text) > 10),
b AS (SELECT doc_id, page, 'word_lines' AS source, string_agg('word' || substr(text, 6), ' ' ORDER BY x0, 'word' || substr(text, 6)) AS text, min(y0) AS y0 FROM raw JOIN poor USING (doc_id, page) GROUP BY doc_id, page, floor(y0) HAVING length(string_agg('word' || substr(text, 6), ' ')) > 15)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.page = b.page)""")
def alternative_blocks(spark, d):
    """Pages with under three text blocks: large raw blocks, else lines made of words. Part numbers are lengthened so that some texts are long enough."""
    item = table(spark, d, "lineitem")
    key = [F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page")]
    kind = F.when(F.col("l_returnflag") == "A", "text")
    x0, y0 = (F.col("l_partkey") % 40) * 10.0, (F.col("l_suppkey") % 70) * 10.0
    box = [x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + (F.col("l_partkey") % 3) * 6.0 + 2).alias("y1")]
    raw = item.select(*key, F.concat(F.lit("text "), s("l_partkey")).alias("text"), *box)
    words = item.select(*key, F.concat(F.lit("word"), s("l_partkey")).alias("text"), *box)
    return long(T.alternative_blocks(item.select(*key, kind.alias("type")), raw, words).select("doc_id", "page", "source", "text", "y0"), "page")


# --- tables


_CELLS = "SELECT l_orderkey AS doc_id, list({'n': l_linenumber, 'p': l_partkey, 'q': l_suppkey, 'f': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS l FROM lineitem GROUP BY l_orderkey"


@query(f"""SELECT doc_id, 'Item|Rate %|Col3' AS headers, array_to_string(list_transform(l, lambda x: CASE WHEN x.n % 2 = 0 THEN x.p || ' | ' || x.q ELSE 'line ' || x.n END || ';' || CASE WHEN x.n % 3 = 0 THEN '-' || x.p WHEN x.n % 3 = 1 THEN '1.5% | 2%' ELSE 'none' END || ';' || x.f), '/') AS rows,
list_sum(list_transform(l, lambda x: (x.n % 2 = 0)::INT + (x.n % 3 <> 2)::INT))::BIGINT AS n_fixed,
round(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 50 ELSE 612 * 0.55 END WHEN doc_id % 3 = 1 THEN 612 - 240 - 50 ELSE 100.0 END::DOUBLE, 4) AS x0, round(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 50 ELSE 612 * 0.55 END + 210 WHEN doc_id % 3 = 1 THEN 612 - 50.0 ELSE 300.0 END::DOUBLE, 4) AS x1,
round(CASE WHEN doc_id % 3 = 0 THEN 100 + (doc_id % 4) * 120 ELSE 10.0 END::DOUBLE, 4) AS y0, round(CASE WHEN doc_id % 3 = 0 THEN 100 + (doc_id % 4) * 120 + len(l) * 20 + 40 ELSE 200.0 END::DOUBLE, 4) AS y1 FROM ({_CELLS})""")
def table_cleaning(spark, d):
    """Orders as raw tables: values that ran together, an empty column, an empty header, boxes unknown, too wide or right."""
    n, k = F.col("l_linenumber"), F.col("doc_id")
    first = F.when(n % 2 == 0, F.concat(s("l_partkey"), F.lit("  "), s("l_suppkey"))).otherwise(F.concat(F.lit(" line "), n.cast("string")))
    second = F.when(n % 3 == 0, F.concat(F.lit("("), s("l_partkey"), F.lit(")"))).when(n % 3 == 1, "1.5%2%").otherwise("none")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.array(first, F.lit(None).cast("string"), second, F.col("l_returnflag")).alias("cells"))
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("body"))
    head = F.array(F.array(F.lit("Item"), F.lit("gone"), F.lit("Rate\n%"), F.lit(" ")))
    side = lambda a, b: F.when(k % 3 == 0, None).when(k % 3 == 1, a).otherwise(b)
    raw = per.select(
        "doc_id", F.lit(1).alias("page"), (k % 4).alias("ordinal"), F.concat(head, "body").alias("cells"), side(10.0, 100.0).alias("x0"), side(10.0, 10.0).alias("y0"), side(600.0, 300.0).alias("x1"), side(200.0, 200.0).alias("y1"),
        F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit(0).alias("rotation"),
    )
    t = tabular.clean_tables(raw)
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "/")
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), joined.alias("rows"), F.col("n_fixed").cast("long").alias("n_fixed"), *(F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'a|b' END AS headers, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderkey % 3 END AS n_rows FROM orders")
def table_guard(spark, d):
    """Tables of one, two and three rows."""
    k = F.col("o_orderkey")
    cells = F.concat(F.array(F.array(F.lit("a"), F.lit("b"))), F.array_repeat(F.array(s("o_orderkey"), F.col("o_orderstatus")), (k % 3).cast("int")))
    t = tabular.C.table_or_none(cells)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(t["headers"], "|").alias("headers"), F.size(t["rows"]).cast("long").alias("n_rows")).withColumn("n_rows", F.when(F.col("headers").isNotNull(), F.col("n_rows")))


@query("""SELECT 'o' || o_orderkey AS unit_id, 'key|status' AS headers, 1 + o_orderkey % 2 AS n_rows, o_orderkey || ';' || o_orderstatus AS first_row, substr('| key | status |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' || CASE WHEN o_orderkey % 2 = 1 THEN chr(10) || '| more | ' || repeat('x', 1200) || ' |' ELSE '' END, 1, 1000) AS raw_content FROM orders WHERE o_orderkey % 3 > 0""")
def unit_tables(spark, d):
    k = F.col("o_orderkey")
    row = F.concat(F.lit("| key | status |\n|---|---|\n| "), s("o_orderkey"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    content = F.when(k % 2 == 1, F.concat(row, F.lit("\n| more | "), F.repeat(F.lit("x"), F.lit(1200)), F.lit(" |"))).otherwise(row)
    units = table(spark, d, "orders").select(F.lit("d").alias("doc_id"), F.concat(F.lit("o"), s("o_orderkey")).alias("unit_id"), F.when(k % 3 == 0, "paragraph").otherwise("table").alias("unit_type"), content.alias("content"))
    t = enrichment.tables_of_units(units)
    return t.select("unit_id", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), F.array_join(F.get("rows", F.lit(0)), ";").alias("first_row"), "raw_content")


@query("""WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_returnflag = 'R' THEN 'stream' ELSE 'lattice' END AS flavour, l_partkey, coalesce(CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount END, 0) AS acc FROM lineitem), m AS (SELECT doc_id, page, flavour, avg(acc) AS mean FROM t GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY mean DESC, flavour) AS n FROM m) SELECT t.doc_id, t.page, t.flavour, t.l_partkey FROM t JOIN b USING (doc_id, page, flavour) WHERE n = 1""")
def table_flavour(spark, d):
    """Accuracies are added in the order of the file's rows."""
    accuracy = F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount"))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.when(F.col("l_returnflag") == "R", "stream").otherwise("lattice").alias("flavour"), "l_partkey", accuracy.alias("accuracy"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return tabular.more_accurate(t, order=("file", "row")).drop("accuracy", "file", "row")


# --- configuration and registry


@query("SELECT doc_id, 'approved' AS status FROM labels")
def approved_automatically(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").alias("status"))
    return enrichment.approved(rows, automatic=True)


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Parts as enhancement types."""
    domains = F.when(F.col("p_size") % 10 == 0, F.array(F.lit("all"))).otherwise(F.array("p_brand", F.lit("other")))
    return table(spark, d, "part").select(
        F.concat(F.lit("t"), s("p_partkey")).alias("type_id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.concat("p_name", F.lit(" of "), "p_brand").alias("description"), domains.alias("applicable_domains"),
        (F.col("p_size") % 2 == 0).alias("default_enabled"), (F.col("p_size") % 10 + 1).alias("default_priority"), F.concat(F.lit("Look for "), "p_name").alias("prompt_instructions"), F.col("p_size").alias("display_order"),
        F.when(F.col("p_size") > 25, F.create_map(F.lit("finance"), F.col("p_brand"))).otherwise(F.create_map(F.lit("legal"), F.lit("x"))).alias("examples"), "p_brand",
    )


@query("SELECT 't' || p_partkey AS type_id FROM part WHERE p_size % 10 = 0 OR p_brand = 'Brand#12'")
def applicable_types(spark, d):
    return observe.applicable(registry(spark, d), "Brand#12").select("type_id")


@query("SELECT c_custkey AS id, 'by id' AS how FROM customer WHERE c_custkey = 7 UNION ALL SELECT p_partkey, 'by category' FROM part WHERE p_type = 'ECONOMY'")
def registry_lookup(spark, d):
    one = config.by_id(table(spark, d, "customer").withColumn("id", s("c_custkey")), "7").select(F.col("c_custkey").alias("id"), F.lit("by id").alias("how"))
    many = config.types_of_category(registry(spark, d), "ECONOMY").select(F.substring("type_id", 2, 20).cast("long").alias("id"), F.lit("by category").alias("how"))
    return one.unionByName(many)


@query("SELECT c_custkey AS id, 'n' || c_nationkey AS client_profile, n_name AS client_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def namespace_profiles(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), s("c_nationkey")).alias("client_profile"))
    profiles = table(spark, d, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("client_profile"), F.col("n_name").alias("client_name"))
    return config.with_profile(names, profiles)


@query("SELECT 't' || p_partkey AS type_id, p_size AS display_order FROM part WHERE p_partkey IN (SELECT s_suppkey * 30 FROM supplier)")
def selected_types(spark, d):
    """Every thirtieth type by the suppliers' keys, repeats and unknown ids among them."""
    wanted = table(spark, d, "supplier").select(F.explode(F.array(F.col("s_suppkey") * 30, F.col("s_suppkey") * 30)).alias("k")).select(F.concat(F.lit("t"), s("k")).alias("type_id"))
    return config.selected_types(registry(spark, d), wanted).select("type_id", F.col("display_order").cast("long").alias("display_order"))


@query("""SELECT to_json(list({'category': category, 'types': types} ORDER BY o, category)) AS config FROM (SELECT p_type AS category, min(p_size) AS o, list({'type_id': 't' || p_partkey, 'name': p_name, 'description': p_name || ' of ' || p_brand, 'default_enabled': p_size % 2 = 0, 'default_priority': p_size % 10 + 1} ORDER BY 't' || p_partkey) AS types FROM part GROUP BY p_type)""")
def frontend_config(spark, d):
    return config.frontend_config(registry(spark, d))


def switches(spark: SparkSession, d: str) -> DataFrame:
    """Events as switches of the active namespace; odd users are no namespaces."""
    return table(spark, d, "events").select("ts", F.concat(F.lit("ns"), (F.col("user_id") * 2 + F.col("event_id") % 2).cast("string")).alias("namespace"), F.col("event_type").alias("switched_by"))


def namespaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("ns"), (F.col("c_custkey") * 2).cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "final").otherwise("testing").alias("type"), F.concat(F.lit("n"), s("c_nationkey")).alias("client_profile"))


_SWITCHES = "SELECT ts, user_id * 2 + event_id % 2 AS n, event_type, event_id FROM events"
_VALID = f"SELECT * FROM ({_SWITCHES}) WHERE n IN (SELECT c_custkey * 2 FROM customer)"


@query(f"SELECT 'ns' || n AS namespace, event_type AS switched_by, epoch_us(ts) AS ts_us FROM ({_VALID}) ORDER BY ts DESC, 'ns' || n LIMIT 1")
def active_switch(spark, d):
    got = config.active_namespace(switches(spark, d), namespaces(spark, d))
    return got.select("namespace", "switched_by", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query(f"SELECT n % 2 = 0 AND n // 2 IN (SELECT c_custkey FROM customer) AS valid, count(*) AS n FROM ({_SWITCHES}) GROUP BY 1")
def switch_validation(spark, d):
    return config.valid_switches(switches(spark, d), namespaces(spark, d)).groupBy("valid").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT 'ns' || n AS active_namespace, n // 2 AS k FROM ({_VALID}) ORDER BY ts DESC, 'ns' || n LIMIT 1)
SELECT '2.0' AS version, 'm' AS llm_model, 'e' AS embedding_model, active_namespace, CASE WHEN c_nationkey % 4 = 0 THEN 'Unknown' ELSE n_name END AS active_client, CASE WHEN c_nationkey % 4 = 0 THEN 0 ELSE 1 + n_regionkey % 2 END AS active_enabled_types, (SELECT array_to_string(list_sort(list('n' || n_nationkey)), ',') FROM nation WHERE n_nationkey % 4 > 0) AS available_profiles, (SELECT count(*) FROM nation WHERE n_nationkey % 4 > 0) AS total_profiles
FROM a JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey""")
def config_summary(spark, d):
    """Nations as profiles; every fourth is a template and counts as missing."""
    name = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("template"), s("n_nationkey"))).otherwise(F.concat(F.lit("n"), s("n_nationkey")))
    types = F.create_map(F.lit("_note"), F.lit(1), F.lit("a"), F.lit(1), F.lit("b"), (F.col("n_regionkey") % 2).cast("int"), F.lit("c"), F.lit(0))
    profiles = table(spark, d, "nation").select(name.alias("client_profile"), F.col("n_name").alias("client_name"), types.alias("enhancement_types"))
    settings = spark.createDataFrame([("2.0", "m", "e")], "version string, llm_model string, embedding_model string")
    return config.summary(switches(spark, d), namespaces(spark, d), profiles, settings).withColumn("available_profiles", F.array_join("available_profiles", ","))


# --- control


@query(f"""WITH e AS (SELECT event_id, ts, doc_id, CASE WHEN event_id % 7 = 0 THEN 'nowhere' ELSE stage END AS stage FROM ({_STATES})), i AS (SELECT *, CASE WHEN stage <> 'nowhere' THEN list_position({_STAGES}, stage) END AS here FROM e),
p AS (SELECT *, last_value(here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT event_id, CASE WHEN here IS NULL THEN 'unknown' WHEN before IS NULL THEN 'first' WHEN here > before THEN 'forward' WHEN here = before THEN 'same' ELSE 'back' END AS verdict FROM p""")
def stage_transitions(spark, d):
    e = states(spark, d).withColumn("stage", F.when(F.col("event_id") % 7 == 0, "nowhere").otherwise(F.col("stage")))
    return observe.transitions(e).select("event_id", "verdict")


@query(f"SELECT event_id FROM ({_STATES}) WHERE event_id % 7 = 0")
def invalid_stages(spark, d):
    e = states(spark, d).withColumn("stage", F.when(F.col("event_id") % 7 == 0, "nowhere").otherwise(F.col("stage")))
    return observe.invalid_transitions(e).select("event_id")


_TIMED = f"SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id))) / 1e6 AS seconds FROM ({_STATES})"


@query(f"SELECT doc_id, round(coalesce(sum(seconds), 0), 3) AS total_seconds, count(seconds) AS stages, round(coalesce(avg(seconds), 60), 3) AS avg_seconds FROM ({_TIMED}) GROUP BY doc_id")
def total_durations(spark, d):
    t = observe.total_durations(states(spark, d))
    return t.select("doc_id", F.round("total_seconds", 3).alias("total_seconds"), "stages", F.round("avg_seconds", 3).alias("avg_seconds"))


@query(f"""SELECT doc_id, arg_max(stage, (ts, event_id)) AS stage, floor(coalesce(avg(seconds), 60) * (1 + 11 - list_position({_STAGES}, arg_max(stage, (ts, event_id)))))::BIGINT AS eta_seconds FROM ({_TIMED}) GROUP BY doc_id""")
def eta_of_documents(spark, d):
    return observe.eta_from_events(states(spark, d), F.lit("2024-06-01 00:00:00").cast("timestamp")).select("doc_id", "stage", "eta_seconds")


@query("""SELECT batch, count(*) AS total, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed, round(coalesce(avg(sec) FILTER (ok), 0), 6) AS avg_seconds, count(*) FILTER (err = 'no result') AS missing FROM (
SELECT o_custkey % 20 AS batch, coalesce(o_orderstatus = 'F', false) AS ok, o_totalprice / 1000 AS sec, CASE WHEN o_orderstatus = 'P' THEN 'no result' END AS err FROM orders) GROUP BY batch""")
def batch_results(spark, d):
    """Orders as files; open ones fail and those in process never came back."""
    o = table(spark, d, "orders")
    files = o.select((F.col("o_custkey") % 20).alias("batch"), F.col("o_orderkey").alias("doc_id"))
    results = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), (F.col("o_totalprice") / 1000).alias("seconds"), F.lit(None).cast("string").alias("error"))
    rows = observe.attach_results(files, results)
    got = observe.batch_summary(rows).join(rows.groupBy("batch").agg(F.count_if(F.col("error") == "no result").alias("missing")), "batch")
    return got.select("batch", "total", "completed", "failed", F.round("avg_seconds", 6).alias("avg_seconds"), "missing")


@query("""SELECT n AS namespace, sum(d)::BIGINT AS document_count, sum(c)::BIGINT AS total_chunks, sum(t)::BIGINT AS total_tokens, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us FROM (
SELECT s_suppkey AS n, 10 AS d, 100 AS c, 1000 AS t, TIMESTAMP '2020-01-01' AS ts FROM supplier UNION ALL SELECT user_id % 80, 1, event_id % 5, event_id, ts FROM events) GROUP BY n""")
def namespace_counters(spark, d):
    then = F.lit("2020-01-01 00:00:00").cast("timestamp")
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("namespace"), F.lit(10).alias("document_count"), F.lit(100).alias("total_chunks"), F.lit(1000).alias("total_tokens"), then.alias("created_at"), then.alias("last_updated"))
    new = table(spark, d, "events").select((F.col("user_id") % 80).alias("namespace"), F.lit(1).alias("documents"), (F.col("event_id") % 5).alias("chunks"), F.col("event_id").alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))
    got = observe.add_counts(old, new)
    return got.select("namespace", "document_count", "total_chunks", "total_tokens", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_updated").alias("updated_us"))


@query(f"""WITH e AS ({_LEDGER}), t AS (SELECT count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o, round(sum(cost_usd), 4) AS c FROM e),
m AS (SELECT string_agg(format('| `{{}}` | {{}} | {{}} | ${{:.4f}} |', model, i, o, c), chr(10) ORDER BY model) AS x FROM (SELECT model, sum(input_tokens) AS i, sum(output_tokens) AS o, round(sum(cost_usd), 4) AS c FROM e GROUP BY model)),
p AS (SELECT string_agg(format('| `{{}}` | {{}} | {{}} | {{}} |', step, n, i, o), chr(10) ORDER BY step) AS x FROM (SELECT step, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o FROM e GROUP BY step)),
l AS (SELECT string_agg(format('| {{}} | `{{}}` | `{{}}` | {{}}/{{}} |', strftime(ts, '%H:%M:%S'), step, model, input_tokens, output_tokens), chr(10) ORDER BY ts DESC, event_id) AS x FROM (SELECT * FROM e ORDER BY ts DESC, event_id LIMIT 10))
SELECT '# Token usage' || chr(10) || chr(10) || format('Events: {{}}', t.n) || chr(10) || format('Total tokens: {{}}, cost: ${{:.4f}}', t.i + t.o, t.c) || chr(10) || format('Input: {{}}', t.i) || chr(10) || format('Output: {{}}', t.o)
|| chr(10) || chr(10) || '## By model' || chr(10) || chr(10) || '| Model | Input | Output | Cost |' || chr(10) || '|---|---|---|---|' || chr(10) || m.x || chr(10) || chr(10) || '## By step' || chr(10) || chr(10) || '| Step | Events | Input | Output |' || chr(10) || '|---|---|---|---|' || chr(10) || p.x
|| chr(10) || chr(10) || '## Last events' || chr(10) || chr(10) || '| Time | Step | Model | In/Out |' || chr(10) || '|---|---|---|---|' || chr(10) || l.x AS markdown FROM t, m, p, l""")
def usage_summary(spark, d):
    """usage_report with its SQL."""
    return observe.render_summary(ledger(spark, d))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_of_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return sinks.latest(e, "user_id", "at").select("user_id", "event_id")


# --- units, windows, prompts, generation


def conversation_units(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "table").when(F.col("role") == "user", "paragraph").otherwise("note")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), F.col("turn").cast("string").alias("unit_id"), kind.alias("unit_type"), F.col("text").alias("content"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def paragraph_text(spark, d):
    return assembly.paragraph_text(conversation_units(spark, d)).select(F.col("doc_id").alias("conv_id"), "text")


@query(f"SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, block_idx, l_partkey) - 1 AS ordinal FROM ({_BLOCKS})")
def window_order(spark, d):
    units = blocks(spark, d).withColumn("place", F.struct("block_idx", "l_partkey"))
    return long(enrichment.order_for_windows(units).select("doc_id", "block_idx", "ordinal"), "block_idx", "ordinal")


_PACKED = """WITH RECURSIVE u AS (SELECT conv_id, turn, text, role, greatest(1, length(text) // 4) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT conv_id, k, 0 AS win, [{'t': turn, 'n': n}] AS cur FROM u WHERE k = 1 UNION ALL
SELECT u.conv_id, u.k, CASE WHEN o THEN w.win + 1 ELSE w.win END, CASE WHEN o THEN list_append(list_filter(w.cur, lambda x, i: list_sum(list_transform(w.cur[i:], lambda y: y.n)) <= 60), {'t': u.turn, 'n': u.n}) ELSE list_append(w.cur, {'t': u.turn, 'n': u.n}) END
FROM w JOIN u ON u.conv_id = w.conv_id AND u.k = w.k + 1, LATERAL (SELECT list_sum(list_transform(w.cur, lambda x: x.n)) + u.n > 200 AS o)),
p AS (SELECT conv_id, win AS window_no, arg_max(cur, k) AS cur FROM w GROUP BY conv_id, win)"""


@query(_PACKED + " SELECT conv_id, window_no, array_to_string(list_transform(cur, lambda x: x.t), ',') AS members, list_sum(list_transform(cur, lambda x: x.n))::BIGINT AS tokens FROM p")
def window_pack_suffix(spark, d):
    """window_pack_overlap with its SQL."""
    from .document_queries import _packed

    return _packed(spark, d, 60)


@query(_PACKED + """ SELECT p.conv_id, window_no, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn)) AS content_md5, count(*) FILTER (c.role = 'system') AS tables FROM (SELECT conv_id, window_no, unnest(list_transform(cur, lambda x: x.t)) AS turn FROM p) p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY ALL""")
def window_contents(spark, d):
    units = conversation_units(spark, d).withColumn("ordinal", F.col("place")).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("content") / 4)))
    got = enrichment.window_content(enrichment.pack_windows(units, 200, 60), units)
    return got.select(F.col("doc_id").alias("conv_id"), F.col("window").cast("long").alias("window_no"), F.md5("content").alias("content_md5"), F.col("tables").cast("long").alias("tables"))


@query("""WITH c AS (SELECT doc_id, text, doc_id % 5 AS n_tables, doc_id % 8 AS n_rows, doc_id % 9 AS n_patterns, (['financial', 'legal', 'procedural', 'general'])[1 + doc_id % 4] AS kind FROM documents)
SELECT doc_id, md5('WINDOW ' || (1 + doc_id % 3) || ' OF 3' || chr(10) || chr(10) || 'CONTENT:' || chr(10) || substr(text, 1, 12000) || chr(10)
|| CASE WHEN n_tables = 0 THEN '' ELSE chr(10) || '=== TABLES ===' || chr(10) || array_to_string(list_transform(range(1, least(n_tables, 3) + 1), lambda i: 'TABLE ' || i || ':' || chr(10) || 'Headers: t' || i || ' | value' || chr(10) || 'Rows (' || n_rows || ' in all, the first ' || least(n_rows, 5) || '):' || chr(10) || array_to_string(list_transform(range(1, least(n_rows, 5) + 1), lambda j: '  r' || j || ' | ' || doc_id), chr(10)) || chr(10) || '---'), chr(10)) || chr(10) END
|| CASE WHEN n_patterns = 0 THEN '' ELSE chr(10) || '=== NUMERIC PATTERNS ===' || chr(10) || CASE WHEN n_patterns > 1 THEN '- number: ' || ((n_patterns + 1) // 2) || ' instances' || chr(10) || '- period: ' || (n_patterns // 2) || ' instances' ELSE '- number: 1 instances' END || chr(10) || chr(10) || 'Sample values:' || chr(10) || array_to_string(list_transform(range(1, least(n_patterns, 5) + 1), lambda j: '  - v' || j || CASE WHEN j % 2 = 1 THEN ' (number)' ELSE ' (period)' END), chr(10)) || chr(10) END
|| CASE kind WHEN 'financial' THEN chr(10) || 'HINT: This document holds financial data. Look for formulas, calculations and projections.' || chr(10) WHEN 'legal' THEN chr(10) || 'HINT: This document is legal or regulatory. Look for implications, consequences and requirements.' || chr(10) WHEN 'procedural' THEN chr(10) || 'HINT: This document describes procedures. Look for complete workflows and dependencies.' || chr(10) ELSE '' END
|| chr(10) || 'Answer with one JSON object as the system prompt says.') AS prompt_md5 FROM c""")
def window_prompts(spark, d):
    """Whole prompts with none to four tables, none to seven rows and none to eight patterns, so that each cap is met and passed."""
    k = F.col("doc_id")
    count = lambda n: F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), n.cast("int"))
    rows = F.transform(count(k % 8), lambda j: F.array(F.concat(F.lit("r"), j.cast("string")), k.cast("string")))
    tabs = F.transform(count(k % 5), lambda i: F.struct(F.array(F.concat(F.lit("t"), i.cast("string")), F.lit("value")).alias("headers"), rows.alias("rows")))
    patterns = F.transform(count(k % 9), lambda j: F.struct(F.when(j % 2 == 1, "number").otherwise("period").alias("kind"), F.concat(F.lit("v"), j.cast("string")).alias("value")))
    kind = F.element_at(F.array(*map(F.lit, ("financial", "legal", "procedural", "general"))), (1 + k % 4).cast("int"))
    p = enrichment.window_user_prompt(1 + k % 3, F.lit(3), F.col("text"), tabs, patterns, kind)
    return table(spark, d, "documents").select("doc_id", F.md5(p).alias("prompt_md5"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""SELECT p_brand, count(*) AS n_types, md5({_sql_text(enrichment.SYSTEM_HEAD)} || chr(10) || chr(10) || '## Selected types: ' || count(*) || chr(10) || string_agg('- `t' || p_partkey || '` (' || p_name || ')', chr(10) ORDER BY p_size, 't' || p_partkey) || chr(10) || chr(10)
|| string_agg('### ' || rn || '. ' || upper(p_name) || ' (ID: `t' || p_partkey || '`)' || chr(10) || 'Description: ' || p_name || ' of ' || p_brand || chr(10) || 'Instructions: Look for ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || 'Example for finance: ' || p_brand ELSE '' END || chr(10) || '---', chr(10) ORDER BY p_size, 't' || p_partkey)
|| {_sql_text(enrichment.SYSTEM_TAIL)} || chr(10) || 'Items for each window: ' || 2 * count(*) || ' to ' || 3 * count(*) || ', two or three of every type.') AS prompt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, 't' || p_partkey) AS rn FROM part) GROUP BY p_brand""")
def full_system_prompts(spark, d):
    got = enrichment.full_system_prompt(registry(spark, d), "finance", "p_brand")
    return got.select("p_brand", "n_types", F.md5("prompt").alias("prompt_md5"))


@query("SELECT doc_id, substr(text, 1, 500) AS original_context, substr(text, 1, 200) AS source_preview, 'enh_' || substr(md5(doc_id || '|0|' || (doc_id % 3) || '|' || text), 1, 8) AS enhancement_id FROM documents")
def item_records(spark, d):
    context, preview = enrichment.previews(F.col("text"))
    ident = enrichment.enhancement_id(F.col("doc_id"), F.lit(0), F.col("doc_id") % 3, F.col("text"))
    return table(spark, d, "documents").select("doc_id", context.alias("original_context"), preview.alias("source_preview"), ident.alias("enhancement_id"))


def flaky(doc: str, content: str) -> str:
    """A hook that fails as its documents say: every third always, every other third once."""
    kind, seen = int(doc) % 3, flaky.__dict__.setdefault("seen", {})
    seen[doc] = seen.get(doc, 0) + 1
    if kind == 0 or kind == 1 and seen.pop(doc) % 2 == 1 and not seen.setdefault(f"{doc} again", 0):
        seen[f"{doc} again"] = 1
        raise RuntimeError("try again")
    seen.pop(f"{doc} again", None)
    return content[:40]


def flaky_calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    windows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("content")).select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(0).alias("window"), "content")
    return windows, enrichment.attempts(windows, flaky, 3, back_off=0.0)


_CALLS = """SELECT conv_id, t, attempt, CASE WHEN conv_id % 3 = 0 OR (conv_id % 3 = 1 AND attempt = 1) THEN 'RuntimeError: try again' END AS error, CASE WHEN conv_id % 3 = 0 THEN attempt = 3 WHEN conv_id % 3 = 1 THEN attempt = 2 ELSE true END AS final FROM (SELECT conv_id, arg_max(text, (turn, text)) AS t FROM conversations GROUP BY conv_id), (SELECT unnest([1, 2, 3]) AS attempt) WHERE attempt <= CASE conv_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END"""


@query(f"SELECT conv_id::VARCHAR AS doc_id, 0 AS \"window\", attempt, CASE WHEN error IS NULL THEN substr(t, 1, 40) END AS response, error, final FROM ({_CALLS})")
def generation_attempts(spark, d):
    """Every call of a failing hook, written to the log of raw responses and read back."""
    path = scratch(spark)
    sinks.append(flaky_calls(spark, d)[1], path)
    return long(spark.read.parquet(path), "window", "attempt")


@query(f"SELECT 'enhancement' AS step, 'm' AS model, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS input_tokens, CASE WHEN error IS NOT NULL OR length(t) = 0 THEN 0 ELSE greatest(1, least(40, length(t)) // 4) END AS output_tokens, conv_id || '/0/' || attempt AS call FROM ({_CALLS})")
def generation_ledger(spark, d):
    windows, calls = flaky_calls(spark, d)
    e = enrichment.generation_events(calls, windows, "m", F.lit(0.0))
    return e.select("step", "model", "input_tokens", "output_tokens", F.concat_ws("/", F.col("meta.doc_id"), F.col("meta.window"), F.col("meta.attempt")).alias("call"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(coalesce(text, ''))) >= 100")
def content_minimum(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return enrichment.long_enough(rows).select("doc_id", F.length("content").cast("long").alias("n"))


@query("""SELECT event_id::VARCHAR AS doc_id, event_id % 3 AS "window", k AS ordinal, CASE WHEN event_id % 4 = 0 THEN 'risk' WHEN event_id % 4 = 1 THEN event_type ELSE 'general' END AS type, CASE WHEN k = 0 THEN 'Untitled' ELSE 'T' || event_id END AS title, CASE WHEN k = 0 THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence, CASE WHEN k = 0 THEN NULL ELSE event_id % 10 END AS priority FROM events, (SELECT unnest([0, 1]) AS k) WHERE event_id % 5 <> 4""")
def item_defaults(spark, d):
    """Generated items with the type under either name or missing, and with defaults for title and confidence."""
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, '"type": "risk", "enhancement_type": "other"').when(k % 4 == 1, F.concat(F.lit('"enhancement_type": "'), "event_type", F.lit('"'))).otherwise('"content": "c"')
    full = F.concat(F.lit('", "confidence": 0.25, "priority": '), (k % 10).cast("string"))
    raw = F.concat(F.lit('{"enhancements": [{'), kind, F.lit("}, {"), kind, F.lit(', "title": "T'), k.cast("string"), full, F.lit("}]}"))
    rows = table(spark, d, "events").select(k.cast("string").alias("doc_id"), (k % 3).alias("window"), F.when(k % 5 == 4, "no json").otherwise(raw).alias("response"))
    return long(enrichment.items_of(rows).select("doc_id", "window", "ordinal", "type", "title", "confidence", "priority"), "window", "ordinal", "priority")


# --- synthesis


# ASCII capitals only: what becomes of other letters differs from engine to engine.
_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ANCHOR = f"CASE doc_id % 5 WHEN 0 THEN substr(text, 11, 40) WHEN 1 THEN '  ' || trim(substr(text, 11, 40)) || '  ' WHEN 2 THEN translate(substr(text, 11, 40), '{_SMALL}', '{_CAPITAL}') WHEN 3 THEN substr(text, 11, 30) || '~' ELSE '~' || substr(text, 11, 30) END"

@query(f"""WITH a AS (SELECT doc_id, text AS t, {_ANCHOR} AS a FROM documents WHERE text IS NOT NULL), b AS (SELECT *, trim(a) AS b FROM a)
SELECT doc_id, CASE WHEN a <> '' AND instr(t, a) > 0 THEN instr(t, a) WHEN b = '' THEN 0 WHEN instr(t, b) > 0 THEN instr(t, b) WHEN instr(lower(t), lower(b)) > 0 THEN instr(lower(t), lower(b)) WHEN length(b) <= 30 THEN 0 WHEN instr(lower(t), lower(substr(b, 1, 30))) > 0 THEN instr(lower(t), lower(substr(b, 1, 30))) ELSE instr(lower(t), lower(right(b, 30))) END AS position FROM b""")
def anchor_rules(spark, d):
    """A passage of each document's beginning as its anchor, altered so that each step is needed: exact, trimmed, any case, beginning, end."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", enrichment.anchor_position(F.col("text"), altered_anchor()).cast("long").alias("position"))


def altered_anchor():
    cut = lambda n: F.substring("text", 11, n)
    k = F.col("doc_id") % 5
    return F.when(k == 0, cut(40)).when(k == 1, F.concat(F.lit("  "), F.trim(cut(40)), F.lit("  "))).when(k == 2, F.translate(cut(40), _SMALL, _CAPITAL)).when(k == 3, F.concat(cut(30), F.lit("~"))).otherwise(F.concat(F.lit("~"), cut(30)))


@query(rf"""WITH a AS (SELECT doc_id, text AS t, {_ANCHOR} AS a FROM documents WHERE text IS NOT NULL), b AS (SELECT *, trim(a) AS b FROM a),
p AS (SELECT *, CASE WHEN a <> '' AND instr(t, a) > 0 THEN [instr(t, a), length(a)] WHEN b = '' THEN [0, 0] WHEN instr(t, b) > 0 THEN [instr(t, b), length(b)] WHEN instr(lower(t), lower(b)) > 0 THEN [instr(lower(t), lower(b)), length(b)] WHEN length(b) <= 30 THEN [0, 0] WHEN instr(lower(t), lower(substr(b, 1, 30))) > 0 THEN [instr(lower(t), lower(substr(b, 1, 30))), 30] WHEN instr(lower(t), lower(right(b, 30))) > 0 THEN [instr(lower(t), lower(right(b, 30))), 30] ELSE [0, 0] END AS sp FROM b),
e AS (SELECT *, sp[1] - 1 + sp[2] + length(regexp_extract(substr(t, sp[1] + sp[2]), '^[^\s|]*')) AS e0 FROM p),
f AS (SELECT *, CASE WHEN starts_with(ltrim(substr(t, e0 - instr(reverse(substr(t, 1, e0)), chr(10)) + 2 - CASE WHEN instr(reverse(substr(t, 1, e0)), chr(10)) = 0 THEN e0 + 1 ELSE 0 END), ' '), '|') THEN CASE WHEN instr(substr(t, e0 + 1), chr(10)) = 0 THEN length(t) ELSE e0 + instr(substr(t, e0 + 1), chr(10)) - 1 END ELSE e0 END AS e1 FROM e)
SELECT doc_id, CASE WHEN sp[1] = 0 THEN t || chr(10) || chr(10) || '## Appendix' || chr(10) || chr(10) || '- **Formula: T' || doc_id || '** found' || chr(10) || '- **Note: U** lost'
ELSE substr(t, 1, e1) || '[^1]' || substr(t, e1 + 1) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[^1]: **Formula: T' || doc_id || '** found' || chr(10) || chr(10) || '## Appendix' || chr(10) || chr(10) || '- **Note: U** lost' END AS markdown, (sp[1] > 0)::INT::BIGINT AS anchored, 2 - (sp[1] > 0)::INT::BIGINT AS appendixed FROM f""")
def synthesis_text(spark, d):
    """The woven text itself: one note by every kind of anchor, one that has no place."""
    docs = table(spark, d, "documents").filter("text is not null")
    one = docs.select("doc_id", F.lit(0).alias("ordinal"), altered_anchor().alias("anchor"), F.concat(F.lit("T"), s("doc_id")).alias("title"), F.lit("found").alias("content"), F.lit("formula_discovery").alias("type"))
    two = docs.select("doc_id", F.lit(1).alias("ordinal"), F.lit("§§ nowhere").alias("anchor"), F.lit("U").alias("title"), F.lit("lost").alias("content"), F.lit("other").alias("type"))
    return long(enrichment.synthesise(docs, one.unionByName(two)), "doc_id", "anchored", "appendixed")


# --- retrieval


_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_SLOT = "('0x' || substr(md5(w), 1, 8))::BIGINT % 64"
_SIGN = "CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END"
_EMBEDDED = f"""SELECT id, list(CASE WHEN n = 0 THEN 0 ELSE coalesce(v, 0) / n END::FLOAT ORDER BY slot) AS e FROM (SELECT i.id, i.slot, v, sqrt(sum(coalesce(v, 0) * coalesce(v, 0)) OVER (PARTITION BY i.id)) AS n FROM (SELECT id, unnest(range(64)) AS slot FROM T) i LEFT JOIN (SELECT id, {_SLOT} AS slot, sum({_SIGN})::DOUBLE AS v FROM (SELECT id, unnest({_WORDS}) AS w FROM T) GROUP BY ALL) g ON g.id = i.id AND g.slot = i.slot) GROUP BY id"""


@query(f"WITH T AS (SELECT doc_id AS id, text FROM documents) SELECT id AS doc_id, array_to_string(list_transform(e, lambda x: round(x::DOUBLE * 10000)::BIGINT), ',') AS digits FROM ({_EMBEDDED})")
def hashed_embedding_digits(spark, d):
    """hashed_embeddings, its numbers to four digits."""
    e = retrieval.hash_embedding(table(spark, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",").alias("digits"))


_QUESTION = "the and of in to die der la de le"


@query(f"""WITH T AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, {_sql_text(_QUESTION)}), v AS ({_EMBEDDED}), q AS (SELECT e AS q FROM v WHERE id = -1)
SELECT id AS vec_id, round(coalesce({_DOT.format(a='e', b='q')} / nullif({_NORM.format(v='e')} * {_NORM.format(v='q')}, 0), 0), 6) AS score FROM v, q WHERE id >= 0 ORDER BY score DESC, id LIMIT 10""")
def question_topk(spark, d):
    """A question as text, embedded like the documents, against all of them."""
    e = retrieval.hash_embedding(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"))
    q = retrieval.embed_query(e.sparkSession, {1: _QUESTION})
    return retrieval.cosine_topk(e.select("vec_id", "embedding"), q.select("q"), 10).select("vec_id", "score")


@query(f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 1 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(coalesce({_DOT.format(a='e.v', b='q.v')} / nullif({_NORM.format(v='e.v')} * {_NORM.format(v='q.v')}, 0), 0), 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0 OR q.vec_id % 50 = 1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def zero_vectors(spark, d):
    """Every fiftieth vector is all zeros, among the queries too."""
    v = vectors(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 50 == 1, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    q = v.filter("vec_id % 20 = 0 or vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return long(retrieval.multi_query_topk(v, q, 5), "rank")


@query("SELECT doc_id AS id, round(least(1, n_chars / 5000.0), 4) AS score, row_number() OVER (ORDER BY round(least(1, n_chars / 5000.0), 4) DESC, doc_id::VARCHAR) AS rank FROM documents")
def source_ranking(spark, d):
    """Sources with scores of their own, and the place their order gives them."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), "text", F.lit("v2").alias("version"))
    ranked = retrieval.sources(rows).select("id", "score").withColumn("_at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    return ranked.select(F.col("id").cast("long").alias("id"), "score", F.row_number().over(Window.orderBy("_at")).cast("long").alias("rank"))


@query(f"""SELECT query_id, md5(replace(replace({_sql_text(retrieval.ANSWER_PROMPT)}, '{{context}}', c), '{{question}}', 'what? ' || query_id)) AS prompt_md5 FROM (SELECT conv_id AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id)""")
def answer_prompts(spark, d):
    """The prompt an answerer gets, given back by one that repeats it."""
    ctx = retrieval.stuff_context(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")).withColumn("question", F.concat(F.lit("what? "), s("query_id")))
    return retrieval.answer(ctx, retrieval.ANSWER_PROMPT, lambda p: p).select("query_id", F.md5("answer").alias("prompt_md5"))


@query("""SELECT 'chat' AS step, 'm' AS model, query_id, status, CASE WHEN length(p) = 0 THEN 0 ELSE greatest(1, length(p) // 4) END AS input_tokens, CASE WHEN status = 'ok' THEN greatest(1, length(substr(p, 1, 100)) // 4) ELSE 0 END AS output_tokens FROM (
SELECT conv_id AS query_id, 'CONTEXT:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'QUESTION: what?' || chr(10) AS p, CASE WHEN length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) % 2 = 0 THEN 'ok' ELSE 'error' END AS status FROM conversations GROUP BY conv_id)""")
def answer_ledger(spark, d):
    """Ledger rows of an answerer that fails on every context of odd length, appended and read back."""

    def call(p: str) -> str:
        if len(p) % 2 != 27 % 2:  # the template adds 27 characters
            raise RuntimeError("odd")
        return p[:100]

    ctx = retrieval.stuff_context(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")).withColumn("question", F.lit("what?"))
    path = scratch(spark)
    sinks.append(retrieval.answer_events(retrieval.answer(ctx, generate=call), "m", F.lit(0.0)), path)
    return spark.read.parquet(path).select("step", "model", F.col("meta.query_id").cast("long").alias("query_id"), F.col("meta.status").alias("status"), "input_tokens", "output_tokens")


@query("""SELECT conv_id, sum(3 + CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + greatest(1, length(role) // 4) + CASE WHEN turn % 3 = 0 THEN 1 + greatest(1, length('speaker' || conv_id) // 4) ELSE 0 END) + 3 AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id""")
def named_message_tokens(spark, d):
    rows = table(spark, d, "conversations").withColumn("name", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("speaker"), s("conv_id"))))
    return retrieval.message_tokens(rows)


@query("SELECT conv_id AS doc_id, turn AS page, CASE WHEN length(arg_max(t, (length(t), -k))) > 20 AND (length(arg_max(t, (length(t), -k))) - length(regexp_replace(arg_max(t, (length(t), -k)), '[^\\p{L}]', '', 'g'))) / length(arg_max(t, (length(t), -k))) <= 0.7 THEN arg_max(t, (length(t), -k)) ELSE '' END AS text FROM (SELECT conv_id, turn, k, trim(substr(replace(replace(replace(text, chr(10), ' '), 'Jan', 'jan'), 'Feb', 'feb'), 1, n)) AS t FROM conversations, (SELECT unnest([6, 3, 11, 4]) AS n0, unnest([0, 1, 2, 3]) AS k), LATERAL (SELECT CASE n0 WHEN 3 THEN 0 ELSE n0 * (1 + turn % 5) END AS n)) GROUP BY conv_id, turn")
def ocr_readings(spark, d):
    """Turns as figures: a hook that reads more in some modes and fails in one; lines that look like a table's go."""

    def ocr(image: bytes, mode: int) -> str:
        if mode == 3:
            raise RuntimeError("no such mode")
        times, _, text = image.decode().partition("|")
        return text[: mode * int(times)]

    calm = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("Jan"), F.lit("jan")), F.lit("Feb"), F.lit("feb"))
    figures = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("figure"), F.concat((1 + F.col("turn") % 5).cast("string"), F.lit("|"), calm).cast("binary").alias("image"))
    return long(layout.read_figures(figures, ocr).select("doc_id", "page", "text"), "doc_id", "page")


# --- files: written below the shared folder, read back


@query("SELECT conv_id || '-' || turn AS unit_id, conv_id::VARCHAR AS doc_id, turn + 1 AS page, role AS unit_type, text AS content, turn::DOUBLE AS y0, role AS kind FROM conversations")
def unit_files(spark, d):
    """Units as JSON, written and read with the readers' schema."""
    units = table(spark, d, "conversations").select(
        F.concat_ws("-", s("conv_id"), s("turn")).alias("unit_id"), s("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.col("role").alias("unit_type"), F.lit("single").alias("column"),
        F.array(F.lit(0.0), F.col("turn").cast("double"), F.lit(1.0), F.col("turn") + 1.0).alias("bbox"), F.col("turn").cast("double").alias("y0"), F.lit("text").alias("source"), F.lit("#a").alias("anchor"), F.col("text").alias("content"), F.create_map(F.lit("kind"), "role").alias("extra"),
    )
    path = scratch(spark)
    sinks.write_json(units, path)
    back = T.read_json(spark, path, T.UNITS, lines=True)
    return long(back.select("unit_id", "doc_id", "page", "unit_type", "content", "y0", F.col("extra.kind").alias("kind")), "page")


@query("SELECT 't' || l_orderkey AS table_id, count(*) AS n_rows, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts, 2 AS fixes FROM lineitem GROUP BY l_orderkey")
def table_files(spark, d):
    """Tables as JSON, written and read with the readers' schema."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    tabs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    tabs = tabs.select(F.concat(F.lit("t"), s("l_orderkey")).alias("table_id"), F.lit(1).alias("page"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"), F.array(F.lit("line"), F.lit("part")).alias("headers"), "rows", F.create_map(F.lit("merged_tokens"), F.lit(2)).alias("fixes"), F.lit("parser").alias("provenance"))
    path = scratch(spark)
    sinks.write_json(tabs, path)
    back = T.read_json(spark, path, T.TABLES, lines=True)
    return long(back.select("table_id", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r[1]), ",").alias("parts"), F.col("fixes.merged_tokens").alias("fixes")), "n_rows", "fixes")


@query("SELECT conv_id AS doc_id, 'metrics' AS kind, count(*) AS value FROM conversations GROUP BY conv_id UNION ALL SELECT doc_id, 'progress', event_id % 11 FROM (SELECT event_id, user_id AS doc_id FROM events)")
def event_sinks(spark, d):
    """Metrics and progress appended to one partitioned log by two writers, and read back."""
    path = scratch(spark)
    metrics = assembly.unit_metrics(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("paragraph").alias("unit_type"), F.lit("text").alias("source")))
    sinks.append(metrics.select("doc_id", F.lit("metrics").alias("kind"), F.col("total_units").alias("value")), path, ("kind",))
    progress = states(spark, d).select("doc_id", F.lit("progress").alias("kind"), observe.stage_index(F.col("stage")).cast("long").alias("value"))
    sinks.append(progress, path, ("kind",))
    return spark.read.parquet(path).select("doc_id", "kind", "value")


@query("SELECT event_id AS meta_id, event_type AS step, user_id % 3 AS model_no, event_id % 97 AS output_tokens FROM events")
def ledger_files(spark, d):
    """The ledger as JSON lines with blank lines among them, by read_ledger()."""
    line = F.to_json(F.struct(F.col("event_id").cast("double").alias("ts"), F.col("event_type").alias("step"), (F.col("user_id") % 3).cast("string").alias("model"), F.lit(1).alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"), F.create_map(F.lit("id"), s("event_id")).alias("meta")))
    path = scratch(spark)
    table(spark, d, "events").select(F.explode(F.array(line, F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    got = T.read_ledger(spark, path)
    return got.select(F.col("meta.id").cast("long").alias("meta_id"), "step", F.col("model").cast("long").alias("model_no"), "output_tokens")


@query("SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '_enhanced' ELSE '' END AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def markdown_files(spark, d):
    """A file a document, base.md or base_enhanced.md, by the executors, and read_markdown() on them."""
    docs = table(spark, d, "documents").filter("text is not null").select(s("doc_id").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("version"), "text")
    path = scratch(spark)
    sinks.write_markdown(docs, path, 256)
    return T.read_markdown(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT vec_id, label::VARCHAR AS namespace FROM embeddings WHERE label NOT IN (2, 7)")
def namespace_removal(spark, d):
    """Partitions of two namespaces deleted, an unknown name skipped."""
    path = scratch(spark)
    vectors(spark, d).select("vec_id", s("label").alias("namespace"), F.lit("v2").alias("version")).write.partitionBy("namespace", "version").parquet(path)
    names = spark.createDataFrame([("2", "testing"), ("3", "final"), ("7", "testing")], "id string, type string")
    gone = ["2", "7", "unknown"]
    sinks.remove_namespaces(spark, path, names, gone, gone)
    return spark.read.parquet(path).select("vec_id", s("namespace").alias("namespace"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR label = 4 THEN 'moved' ELSE 'n' || label END AS namespace, CASE WHEN vec_id % 7 = 0 OR label = 4 THEN 1 ELSE 0 END AS round FROM embeddings")
def partition_upsert(spark, d):
    """Every seventh vector moves to another partition and one partition moves as a whole: no old row stays behind."""
    path = scratch(spark)
    v = vectors(spark, d).select("vec_id", F.concat(F.lit("n"), s("label")).alias("namespace"), F.lit("v2").alias("version"), F.lit(0).alias("round"), "label")
    sinks.upsert_partitions(spark, v.drop("label"), path, "vec_id")
    moved = v.filter("vec_id % 7 = 0 or label = 4").withColumn("namespace", F.lit("moved")).withColumn("round", F.lit(1)).drop("label")
    sinks.upsert_partitions(spark, moved, path, "vec_id")
    return long(spark.read.parquet(path).select("vec_id", "namespace", "round"), "round")


@query("SELECT n_name AS profile, part, key, value FROM (SELECT n_name, n_nationkey, unnest(['enhancement_types', 'enhancement_types', 'domains']) AS part, unnest(['risk', 'k' || n_regionkey, 'finance']) AS key, unnest([n_nationkey % 2, 1, n_regionkey % 2]) AS value FROM nation)")
def profile_files(spark, d):
    """A JSON file a nation, a template among them, by list_profiles() and read_profiles()."""
    types = F.create_map(F.lit("_comment"), F.lit(9), F.lit("risk"), (F.col("n_nationkey") % 2).cast("int"), F.concat(F.lit("k"), s("n_regionkey")), F.lit(1))
    body = F.to_json(F.struct(F.col("n_name").alias("client_name"), types.alias("enhancement_types"), F.create_map(F.lit("finance"), (F.col("n_regionkey") % 2).cast("int")).alias("domains")))
    rows = table(spark, d, "nation").select(F.concat("n_name", F.lit(".json")).alias("file"), body.alias("text"))
    path = scratch(spark)
    sinks.write_files(rows.unionByName(rows.orderBy("file").limit(1).withColumn("file", F.lit("template.json"))), path)
    return long(T.read_profiles(spark, path).join(T.list_profiles(spark, path), "profile", "left_semi").select("profile", "part", "key", "value"), "value")


def line_parser(data: bytes):
    """A parser hook for files of lines: each line of a file is a block of one page, ten points high."""
    for k, line in enumerate(data.decode().split("\n")):
        spans = [x for x in line.split(" ") if x]
        yield {"page": 1 + k // 50, "block_idx": str(k), "type": "text" if spans else "figure", "bbox": (0, 10 * (k % 50), 6 * len(line), 10 * (k % 50) + 10), "text": " ".join(spans).strip(BLANKS), "size": (600, 500)}


@query(r"""SELECT doc_id::VARCHAR AS doc_id, 1 + k // 50 AS page, k AS block_no, CASE WHEN regexp_replace(t, ' +', '', 'g') = '' THEN 'figure' ELSE 'text' END AS type, round(6.0 * length(t) * 10 / 300000, 6) AS area_ratio, md5(trim(regexp_replace(t, ' +', ' ', 'g'))) AS text_md5 FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))""")
def parsed_blocks(spark, d):
    """Blocks of files through a parser hook, every file whole."""
    path = scratch(spark)
    sinks.write_files(table(spark, d, "documents").filter("text is not null").select(F.concat(s("doc_id"), F.lit(".pdf")).alias("file"), "text"), path, 256)
    b = T.read_pdfs(spark, path, line_parser)
    return long(b.select("doc_id", "page", F.col("block_idx").cast("long").alias("block_no"), "type", F.round("area_ratio", 6).alias("area_ratio"), F.md5("text").alias("text_md5")), "page")


def table_parser(data: bytes):
    """A parser hook for files of tables: rows by line, cells by tab, tables by blank line, one page each."""
    for k, part in enumerate(data.decode().split("\n\n")):
        yield {"page": 1 + k, "cells": [[c or None for c in row.split("\t")] for row in part.split("\n")], "size": (612, 792), "bbox": (50, 20, 300, 90) if k else None}


@query("""SELECT l_orderkey::VARCHAR AS doc_id, 1 AS page, '| Line | Part | Flag |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS content, 50.0::DOUBLE AS x0 FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey::VARCHAR, 2, '| N |' || chr(10) || '|---|' || chr(10) || '| ' || count(*) || ' |', 50.0::DOUBLE FROM lineitem GROUP BY l_orderkey""")
def parsed_tables(spark, d):
    """Tables of files through a parser hook, cleaned, as units; one table of every file has one row and goes, one an empty column."""
    row = F.concat_ws("\t", s("l_linenumber"), F.lit(""), s("l_partkey"), "l_returnflag")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", row.alias("row")))), lambda r: r["row"]), "\n")
    text = F.concat(F.lit("Line\tEmpty\tPart\tFlag\n"), body, F.lit("\n\nN\n"), F.count("*").cast("string"), F.lit("\n\nalone"))
    per = table(spark, d, "lineitem").groupBy(F.expr("l_orderkey").alias("k")).agg(text.alias("text"))
    # a file holds one order's tables; files are packed so that there are few of them
    packed = per.select(F.concat(s("k"), F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))
    units = tabular.table_units(tabular.clean_tables(T.parse_tables(packed, table_parser)))
    return long(units.select("doc_id", "page", "content", "x0"), "page")


# --- text, its patterns spelled out


_MONTH_ID = "Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember"
_MONTH_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
_ALL = r"regexp_extract_all"
_TEXT = r"replace(replace(text, '. ', '. On Kamis, 13 Februari 2025 and March 4, 2024 or 2023-05-06, in Q2 2025 and FY 2024, year 2019: 12.5% of Rp 1.500 juta, $2,000 million; '), ' the ', ' www.a.example/x see https://b.example/y?z=1 a.b@c.example.org ')"
_PROPS = rf"""SELECT doc_id, t, array_to_string(list_sort(list_distinct(flatten([
list_transform({_ALL}(t, '(?i)\b(\d{{1,2}})\s+({_MONTH_ID})\s+(\d{{4}})\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')),
list_transform({_ALL}(t, '(?i)\b(Senin|Selasa|Rabu|Kamis|Jumat|Sabtu|Minggu),?\s+(\d{{1,2}})\s+({_MONTH_ID})\s+(\d{{4}})\b'), lambda x: regexp_replace(replace(x, ',', ' '), '\s+', ' ', 'g')),
list_transform({_ALL}(t, '(?i)\b({_MONTH_EN})\s+(\d{{1,2}}),?\s+(\d{{4}})\b'), lambda x: regexp_replace(replace(x, ',', ' '), '\s+', ' ', 'g')),
list_transform({_ALL}(t, '\b(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})\b'), lambda x: regexp_replace(x, '[-/]', ' ', 'g')),
list_transform({_ALL}(t, '\b(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}})\b'), lambda x: regexp_replace(x, '[-/]', ' ', 'g'))])))[1:20], '|') AS dates,
array_to_string(list_sort(list_distinct(flatten([{_ALL}(t, '(?i)\b(Q[1-4]\s+\d{{4}})\b', 1), {_ALL}(t, '(?i)\b(FY\s*\d{{4}})\b', 1), {_ALL}(t, '(?i)\b(tahun\s+\d{{4}})\b', 1), {_ALL}(t, '(?i)\b(year\s+\d{{4}})\b', 1)])))[1:10], '|') AS temporal_references,
array_to_string(list_sort(list_distinct(list_concat({_ALL}(t, '\b(\d+[,.]\d+)%', 1), {_ALL}(t, '\b(\d{{1,3}}(?:[,.]\d{{3}})*(?:[,.]\d+)?)\b', 1))))[1:30], '|') AS numbers,
array_to_string(list_sort(list_distinct({_ALL}(t, '(?i)https?://[^\s<>"]+|www\.[^\s<>"]+')))[1:10], '|') AS urls,
array_to_string(list_sort(list_distinct({_ALL}(t, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b')))[1:10], '|') AS emails,
CASE WHEN contains(lower(t), 'laporan keuangan') OR contains(lower(t), 'financial report') OR contains(lower(t), 'balance sheet') OR contains(lower(t), 'income statement') OR contains(lower(t), 'neraca') OR contains(lower(t), 'laba rugi') THEN 'financial_report'
WHEN contains(lower(t), 'market insight') OR contains(lower(t), 'market analysis') OR contains(lower(t), 'analisis pasar') OR contains(lower(t), 'daily market') THEN 'market_insight'
WHEN contains(lower(t), 'product') OR contains(lower(t), 'produk') THEN 'product_info'
WHEN contains(lower(t), 'kontrak') OR contains(lower(t), 'contract') OR contains(lower(t), 'perjanjian') OR contains(lower(t), 'agreement') OR contains(lower(t), 'legal') OR contains(lower(t), 'hukum') THEN 'legal_document'
WHEN contains(lower(t), 'abstract') OR contains(lower(t), 'abstrak') OR contains(lower(t), 'methodology') OR contains(lower(t), 'metodologi') OR contains(lower(t), 'research') OR contains(lower(t), 'penelitian') THEN 'research_paper'
WHEN contains(lower(t), 'proposal') OR contains(lower(t), 'usulan') OR contains(lower(t), 'penawaran') THEN 'proposal' WHEN contains(lower(t), 'report') OR contains(lower(t), 'laporan') THEN 'report'
WHEN contains(lower(t), 'presentation') OR contains(lower(t), 'presentasi') OR contains(lower(t), 'slide') THEN 'presentation' ELSE 'unknown' END AS document_type,
list_sum(list_transform(['dan', 'yang', 'untuk', 'dengan', 'pada', 'adalah', 'dari', 'ini', 'dalam'], lambda w: contains(' ' || lower(t) || ' ', ' ' || w || ' ')::INT)) AS n_id,
list_sum(list_transform(['and', 'the', 'for', 'with', 'this', 'that', 'from', 'are', 'was', 'were'], lambda w: contains(' ' || lower(t) || ' ', ' ' || w || ' ')::INT)) AS n_en"""


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a date, a period, amounts and addresses woven into their sentences, and one keyword of each class in some of them."""
    text = F.replace("text", F.lit(". "), F.lit(". On Kamis, 13 Februari 2025 and March 4, 2024 or 2023-05-06, in Q2 2025 and FY 2024, year 2019: 12.5% of Rp 1.500 juta, $2,000 million; "))
    text = F.replace(text, F.lit(" the "), F.lit(" www.a.example/x see https://b.example/y?z=1 a.b@c.example.org "))
    return table(spark, d, "documents").select("doc_id", F.concat(text, F.element_at(F.array(*map(F.lit, _KEYWORDS)), (1 + F.col("doc_id") % len(_KEYWORDS)).cast("int"))).alias("text"))


_KEYWORDS = [" x", " Neraca", " daily market", " produk dan yang untuk", " Agreement", " abstrak", " usulan", " laporan adalah dari ini", " slide", " hukum product"]
_MARKED_SQL = f"(SELECT doc_id, {_TEXT} || ([{', '.join(chr(39) + k + chr(39) for k in _KEYWORDS)}])[1 + doc_id % {len(_KEYWORDS)}] AS t FROM documents)"


@query(f"SELECT doc_id, dates, temporal_references, numbers, urls, emails, document_type, CASE WHEN n_id > n_en THEN 'indonesian' WHEN n_en > n_id THEN 'english' ELSE 'mixed' END AS language FROM ({_PROPS} FROM {_MARKED_SQL})")
def marked_properties(spark, d):
    """All properties of whole documents, patterns and keywords spelled out in the SQL."""
    p = assembly.properties(marked_documents(spark, d))
    lists = [F.array_join(c, "|").alias(c) for c in ("dates", "temporal_references", "numbers", "urls", "emails")]
    return p.select("doc_id", *lists, "document_type", "language")


@query(f"""SELECT doc_id, '---' || chr(10) || 'title: "D' || doc_id || '"' || chr(10) || 'document_type: ' || document_type || chr(10) || 'language: en' || chr(10) || 'total_pages: 1' || chr(10) || 'has_tables: false' || chr(10) || 'has_images: true' || CASE WHEN dates = '' THEN '' ELSE chr(10) || 'dates:' || chr(10) || array_to_string(list_transform(string_split(dates, '|')[1:5], lambda x: '- ' || x), chr(10)) END || CASE WHEN temporal_references = '' THEN '' ELSE chr(10) || 'temporal_references:' || chr(10) || array_to_string(list_transform(string_split(temporal_references, '|')[1:3], lambda x: '- ' || x), chr(10)) END || chr(10) || '---' || chr(10) AS head FROM ({_PROPS} FROM {_MARKED_SQL})""")
def full_front_matter(spark, d):
    p = assembly.properties(marked_documents(spark, d))
    head = assembly.front_matter(F.concat(F.lit("D"), s("doc_id")), F.col("document_type"), F.lit("en"), F.lit(1), F.lit(False), F.lit(True), F.col("dates"), F.col("temporal_references"))
    return p.select("doc_id", head.alias("head"))


_SPAN_OF = [("currency", "'idr'", r"(?i)(?:Rp|IDR)\s?([\d,.]+)(?:\s*(?:ribu|juta|miliar|triliun))?"), ("currency", "'usd'", r"(?i)(?:USD|\$)\s?([\d,.]+)(?:\s*(?:thousand|million|billion))?"), ("percentage", "NULL", r"(\d+(?:[.,]\d+)?)\s*%"), ("period", "NULL", r"(?i)(\d+)\s*(tahun|bulan|hari|minggu|kuartal|semester)"), ("number", "NULL", r"\b(\d{1,3}(?:[,.]\d{3})*(?:[,.]\d+)?)\b")]
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {currency} AS currency, m[i] AS value, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, t FROM (SELECT doc_id, t, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM {_MARKED_SQL}))"""
    for kind, currency, p in _SPAN_OF
)


@query(f"SELECT doc_id, kind, currency, value, a::BIGINT AS \"start\", (a + length(value))::BIGINT AS \"end\", CASE WHEN kind = 'number' THEN substr(t, greatest(0, a - 20) + 1, a + length(value) + 20 - greatest(0, a - 20)) END AS context FROM ({_SPANS})")
def marked_pattern_spans(spark, d):
    """Every numeric pattern with its place, patterns spelled out in the SQL."""
    return long(enrichment.pattern_spans(marked_documents(spark, d)), "start", "end")


@query(f"SELECT doc_id, kind, count(*) AS n, array_to_string(list_transform(list(value ORDER BY a)[1:5], lambda x: x), '|') AS samples FROM ({_SPANS}) GROUP BY doc_id, kind")
def marked_pattern_samples(spark, d):
    got = config.pattern_samples(enrichment.pattern_spans(marked_documents(spark, d)))
    return got.select("doc_id", "kind", "n", F.array_join("samples", "|").alias("samples"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'kept/' || c_custkey || '.md' WHEN 1 THEN 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') || CASE WHEN c_nationkey % 2 = 0 THEN '_enhanced.md' ELSE '.md' END ELSE 'markdown_' || CASE WHEN c_nationkey % 2 = 0 THEN 'v2' ELSE 'v1' END || '.md' END AS file FROM customer")
def version_files(spark, d):
    k = F.col("c_custkey") % 3
    paths = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("base_name"), F.when(F.col("c_nationkey") % 2 == 0, "v2").otherwise("v1").alias("version"), F.when(k == 0, F.concat(F.lit("kept/"), s("c_custkey"), F.lit(".md"))).otherwise("").alias("recorded"), (k == 1).alias("exists_named"))
    return assembly.resolve_version(paths).select("c_custkey", "file")


@query("SELECT b.item_id, d.doc_id, instr(d.text, b.text) AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def anchor_find_runs(spark, d):
    """anchor_find by the way for more anchors than workers can hold."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor"))
    return enrichment.find_anchors(table(spark, d, "documents").select("doc_id", "text"), items, most_bytes=0).select("item_id", "doc_id", "position")
