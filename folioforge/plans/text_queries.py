"""Queries of text extraction, classification, repair and chunking, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as X
from ..operators import assembly, enrichment, retrieval
from ..sources.tables import simple_text_blocks, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _list(c):
    return F.array_join(c, "|")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')))[1:10], '|') AS emails FROM documents""")
def extract_emails(spark, d):
    return docs(spark, d).select("doc_id", _list(X.emails(F.col("text"))).alias("emails"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)https?://[^\s<>"]+|www\.[^\s<>"]+')))[1:10], '|') AS urls FROM (SELECT page_id, 'see ' || url || ' or www.example.org/' || page_id || ' now' AS t FROM pages)""")
def extract_urls(spark, d):
    t = F.concat(F.lit("see "), "url", F.lit(" or www.example.org/"), F.col("page_id").cast("string"), F.lit(" now"))
    return table(spark, d, "pages").select("page_id", _list(X.urls(t)).alias("urls"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b(\d+[,.]\d+)%', 1), regexp_extract_all(text, '\b(\d{1,3}(?:[,.]\d{3})*(?:[,.]\d+)?)\b', 1))))[1:30], '|') AS numbers FROM documents""")
def extract_numbers(spark, d):
    return docs(spark, d).select("doc_id", _list(X.numbers(F.col("text"))).alias("numbers"))


@query(r"""SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all('rate ' || CAST(l_discount AS VARCHAR) || '% and ' || CAST(l_tax AS VARCHAR) || '% of it', '\b(\d+[,.]\d+)%', 1), '|') AS percents FROM lineitem""")
def extract_percents(spark, d):
    t = F.concat(F.lit("rate "), F.col("l_discount").cast("string"), F.lit("% and "), F.col("l_tax").cast("string"), F.lit("% of it"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _list(X.percents(t)).alias("percents"))


_DATES_SQL = " , ".join(f"list_transform(regexp_extract_all(t, '{p}'), lambda x: regexp_replace(x, '{p}', '{to.replace('$', chr(92))}'))" for p, to in X.DATE_PATTERNS)


@query(f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(flatten([{_DATES_SQL}])))[1:20], '|') AS dates FROM (
SELECT o_orderkey, 'Placed ' || strftime(o_orderdate, '%Y-%m-%d') || ', due Kamis, ' || (1 + o_orderkey % 28) || ' Februari ' || strftime(o_orderdate, '%Y') || ' or March ' || (1 + o_orderkey % 9) || ', ' || strftime(o_orderdate, '%Y') || '; ref ' || strftime(o_orderdate, '%d/%m/%Y') AS t FROM orders)""")
def extract_dates(spark, d):
    year, day = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey")
    t = F.concat(
        F.lit("Placed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", due Kamis, "), (1 + day % 28).cast("string"), F.lit(" Februari "), year,
        F.lit(" or March "), (1 + day % 9).cast("string"), F.lit(", "), year, F.lit("; ref "), F.date_format("o_orderdate", "dd/MM/yyyy"),
    )
    return table(spark, d, "orders").select("o_orderkey", _list(X.dates(t)).alias("dates"))


_TEMPORAL_SQL = " , ".join(f"regexp_extract_all(t, '{p}', 1)" for p in X.TEMPORAL_PATTERNS)


@query(f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(flatten([{_TEMPORAL_SQL}])))[1:10], '|') AS refs FROM (
SELECT o_orderkey, 'In Q' || (1 + o_orderkey % 4) || ' ' || strftime(o_orderdate, '%Y') || ' and FY' || strftime(o_orderdate, '%Y') || ', tahun ' || (2000 + o_orderkey % 30) AS t FROM orders)""")
def extract_temporal(spark, d):
    k, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    t = F.concat(F.lit("In Q"), (1 + k % 4).cast("string"), F.lit(" "), year, F.lit(" and FY"), year, F.lit(", tahun "), (2000 + k % 30).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", _list(X.temporal_references(t)).alias("refs"))


_TYPES_SQL = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{k}'" for k, words in X.DOCUMENT_TYPES.items())


@query(f"SELECT doc_id, CASE {_TYPES_SQL} ELSE 'unknown' END AS document_type FROM documents")
def doc_type_classify(spark, d):
    return docs(spark, d).select("doc_id", X.document_type(F.col("text")).alias("document_type"))


def _count_sql(words):
    return " + ".join(f"contains(t, ' {w} ')::INT" for w in words)


@query(f"SELECT doc_id, CASE WHEN a > b THEN 'indonesian' WHEN b > a THEN 'english' ELSE 'mixed' END AS language FROM (SELECT doc_id, {_count_sql(X.WORDS_ID)} AS a, {_count_sql(X.WORDS_EN)} AS b FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents))")
def language_detect(spark, d):
    return docs(spark, d).select("doc_id", X.language(F.col("text")).alias("language"))


_CUR = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p, _ in X.CURRENCY)
_COUNTS = f"{_CUR} AS currency, len(regexp_extract_all(text, '{X.PERCENTAGE}')) AS percentage, len(regexp_extract_all(text, '{X.PERIOD}')) AS period, len(regexp_extract_all(text, '{X.NUMBER}')) AS number"


@query(f"SELECT doc_id, {_COUNTS} FROM documents")
def numeric_pattern_counts(spark, d):
    return docs(spark, d).select("doc_id", X.numeric_pattern_counts(F.col("text")).alias("c")).select("doc_id", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("currency", "percentage", "period", "number")])


@query(f"SELECT doc_id, CASE WHEN currency + percentage + period + number >= 10 THEN 'financial' WHEN contains(lower(text), 'pasal') OR contains(lower(text), 'ayat') THEN 'legal' WHEN contains(lower(text), 'langkah') OR contains(lower(text), 'prosedur') THEN 'procedural' ELSE 'general' END AS content_type FROM (SELECT doc_id, text, {_COUNTS} FROM documents)")
def content_type(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("text").alias("content"), F.lit(0).alias("tables"))
    return enrichment.analyse_window(rows).select("doc_id", "content_type")


@query()
def numeric_pattern_spans(spark, d):
    return enrichment.pattern_spans(docs(spark, d))


@query("SELECT doc_id, count(*) AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE upper(line) = line AND lower(line) <> line AND length(line) < 80 GROUP BY doc_id")
def heading_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(X.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("headings"))


@query("SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, length(unnest(p)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def line_explode(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"))


@query("""SELECT doc_id, k AS block_no, round((k - 1) * 842.0 / n, 4) AS y0, round(k * 842.0 / n, 4) AS y1, length(trim(p[k])) AS chars FROM (
SELECT doc_id, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> '') AS p FROM documents))""")
def simple_blocks(spark, d):
    spaced = docs(spark, d).withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    b = simple_text_blocks(spaced)
    return b.select(F.col("doc_id").cast("long").alias("doc_id"), (F.regexp_extract("block_idx", r"(\d+)$", 1).cast("long") + 1).alias("block_no"), F.round("y0", 4).alias("y0"), F.round("y1", 4).alias("y1"), F.length("text").cast("long").alias("chars"))


@query(r"""SELECT page_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_text(spark, d):
    t = X.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')) AS clean_md5 FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(10) || ' ' || chr(10) || chr(10) || ' ') AS text FROM documents)""")
def ws_cleanup(spark, d):
    spaced = F.replace("text", F.lit(". "), F.lit(".  \n \n\n "))
    return docs(spark, d).select("doc_id", F.md5(X.clean_white_space(spaced)).alias("clean_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, ' the ', ' Daan '), '(?i)\bdaan\b', 'dan', 'g'), '(?i)\byano\b', 'yang', 'g'), '(?i)\bunluk\b', 'untuk', 'g')) AS fixed_md5 FROM documents""")
def ocr_corrections(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.fix_ocr_words(F.replace("text", F.lit(" the "), F.lit(" Daan ")))).alias("fixed_md5"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents),
b AS (SELECT doc_id, l, len(l) AS n, list_transform(l, lambda x: regexp_full_match(x, '\d+\.?\d*\.?\s*')) AS b FROM t),
e AS (SELECT doc_id, l, n, list_transform(range(1, n + 1), lambda i: coalesce(nullif(list_position(b[i:], false), 0) + i - 1, n + 1)) AS e FROM b),
r AS (SELECT doc_id, 1::BIGINT AS i, 0 AS step, '' AS o FROM e UNION ALL
SELECT doc_id, CASE WHEN alone THEN i + 1 ELSE j + j - i END, step + 1, CASE WHEN alone THEN l[i] ELSE array_to_string(list_transform(range(i, j), lambda k: l[k] || CASE WHEN j + k - i <= n AND l[j + k - i] <> '' THEN ' ' || l[j + k - i] ELSE '' END), chr(10)) END
FROM (SELECT r.doc_id, r.i, r.step, e.l, e.n, e.e[r.i] AS j, e.e[r.i] - r.i < 2 AND (e.e[r.i] = r.i OR e.e[r.i] > e.n OR e.l[e.e[r.i]] = '') AS alone FROM r JOIN e ON e.doc_id = r.doc_id WHERE r.i <= e.n))
SELECT doc_id, string_agg(o, chr(10) ORDER BY step) AS text FROM r WHERE step > 0 GROUP BY doc_id""")
def numbered_sections(spark, d):
    return enrichment.repair_numbered_sections(docs(spark, d))


@query(r"""SELECT doc_id, count(*) AS lines, sum((length(t) < 10 OR (length(t) - length(regexp_replace(t, '[^\p{L}]', '', 'g'))) / greatest(length(t), 1) > 0.7 OR contains(t, '%') OR contains(t, '$') OR contains(t, '|') OR contains(t, 'USD') OR contains(t, 'IDR') OR contains(t, 'Feb') OR contains(t, 'Jan'))::INT) AS table_lines FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents) GROUP BY doc_id""")
def table_text_predicate(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(X.likely_table_text(F.col("line")).cast("long")).alias("table_lines"))


@query(r"""SELECT doc_id, count(*) AS important FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents) WHERE CASE
WHEN length(t) < 5 AND regexp_matches(t, '^\d+$') THEN false WHEN length(t) > 100 THEN true
WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 3 AND regexp_matches(t, '[.,;:!?]') THEN true
WHEN regexp_matches(t, '\p{Ll}') AND regexp_matches(t, '\p{Lu}') AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 2 THEN true
WHEN regexp_matches(t, '\d') AND regexp_matches(t, '\p{L}') AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 2 THEN true
ELSE length(t) > 20 END GROUP BY doc_id""")
def header_importance(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keep = X.important_header(F.trim("line"), F.lit(10.0), F.lit(100.0), F.lit(595.0))
    return lines.filter(keep).groupBy("doc_id").agg(F.count("*").alias("important"))


@query("""SELECT l_orderkey, len(cells) AS n_rows, array_to_string(list_transform(cells, lambda r: array_to_string(r, ';')), '/') AS parsed FROM (
SELECT l_orderkey, list([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag] ORDER BY l_linenumber, l_partkey, l_returnflag) AS cells FROM lineitem GROUP BY l_orderkey)""")
def md_table_parse(spark, d):
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag"), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))), lambda x: x["row"])
    text = F.concat(F.lit("| line | part | flag |\n|---|---|---|\n"), F.array_join(lines, "\n"))
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(text.alias("text")).select("l_orderkey", C.parse_markdown_table(F.col("text")).alias("t"))
    return t.select("l_orderkey", F.size("t.rows").cast("long").alias("n_rows"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ";")), "/").alias("parsed"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN l_discount || '% | ' || l_tax || '%' WHEN l_linenumber % 4 = 1 THEN l_partkey || ' | ' || l_suppkey WHEN l_linenumber % 4 = 2 THEN '-' || l_partkey ELSE (1 + l_orderkey % 28) || '-Feb | ' || (1 + l_partkey % 9) || '-Mar' END AS cell FROM lineitem""")
def cell_split(spark, d):
    k = F.col("l_linenumber") % 4
    s = lambda c: F.col(c).cast("string")
    raw = (
        F.when(k == 0, F.concat(s("l_discount"), F.lit("%"), s("l_tax"), F.lit("%"))).when(k == 1, F.concat(s("l_partkey"), F.lit(" "), s("l_suppkey"))).when(k == 2, F.concat(F.lit("("), s("l_partkey"), F.lit(")")))
        .otherwise(F.concat((1 + F.col("l_orderkey") % 28).cast("string"), F.lit("-Feb"), (1 + F.col("l_partkey") % 9).cast("string"), F.lit("-Mar")))
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.split_cell(raw).alias("cell"))


@query("""SELECT n_nationkey, 'Name|Col1|line two|' || CASE WHEN n_regionkey = 0 THEN 'Col3' ELSE 'R' || n_regionkey END AS headers, '| ' || n_name || ' | ' || n_regionkey || ' |' AS row_md FROM nation""")
def header_normalise(spark, d):
    names = F.array(F.lit(" Name "), F.lit("  "), F.lit("line\ntwo"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
    cells = F.array(F.array(F.col("n_name"), F.lit(" "), F.col("n_regionkey").cast("string")))
    kept = F.transform(cells, lambda r: C.keep_columns(r, C.filled_columns(cells)))
    md = F.split(C.markdown_table(F.array(F.lit("a"), F.lit("b")), kept), "\n")
    return table(spark, d, "nation").select("n_nationkey", _list(C.headers(names)).alias("headers"), F.get(md, F.lit(2)).alias("row_md"))


@query("SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') || '…' END AS snippet FROM (SELECT doc_id, trim(text) AS t FROM documents)")
def source_snippets_300(spark, d):
    return docs(spark, d).select("doc_id", X.snippet_300(F.col("text")).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE CASE WHEN p > 0 AND 400 - p > 320 THEN substr(h, 1, 400 - p) ELSE h END || '...' END AS snippet FROM (SELECT doc_id, text, substr(text, 1, 400) AS h, instr(reverse(substr(text, 1, 400)), ' ') AS p FROM documents)")
def source_snippets_400(spark, d):
    return docs(spark, d).select("doc_id", X.snippet_400(F.col("text")).alias("snippet"))


@query("SELECT doc_id, substr(md5(text), 1, 12) AS content_id FROM documents")
def content_ids(spark, d):
    return docs(spark, d).select("doc_id", X.content_id(F.col("text")).alias("content_id"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(source || ':' || lang || '?/' || doc_id, '[\\/:*?"<>|]+', '_', 'g')), ''), 'document') AS file_name FROM documents""")
def safe_file_names(spark, d):
    return docs(spark, d).select("doc_id", X.safe_name(F.concat("source", F.lit(":"), "lang", F.lit("?/"), F.col("doc_id").cast("string"))).alias("file_name"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("""SELECT conv_id, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + CASE WHEN length(role) = 0 THEN 0 ELSE greatest(1, length(role) // 4) END + 3) + 3 AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id""")
def message_tokens(spark, d):
    return retrieval.message_tokens(table(spark, d, "conversations"))


@query("""SELECT doc_id, k AS chunk, k * 1450 AS char_start, least(k * 1450 + 1800, n) AS char_end, md5(substr(text, k * 1450 + 1, 1800)) AS chunk_md5 FROM (
SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(0, CAST(ceil((length(text) - 350) / 1450.0) AS INT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, d):
    c = retrieval.fixed_chunks(docs(spark, d))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5("text").alias("chunk_md5"))


@query()
def chunk_recursive(spark, d):
    return retrieval.recursive_chunks(docs(spark, d))


@query("""WITH c AS (SELECT doc_id, k AS chunk, k * 1450 AS a, least(k * 1450 + 1800, n) AS b FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, CAST(ceil((length(text) - 350) / 1450.0) AS INT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0)),
s AS (SELECT doc_id, k AS seg, k * 700 AS a, least((k + 1) * 700, n) AS b FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(ceil(length(text) / 700.0) AS INT))) AS k FROM documents WHERE length(text) > 0))
SELECT c.doc_id, c.chunk, array_to_string(list_sort(list('s' || lpad(CAST(seg AS VARCHAR), 5, '0'))), '|') AS segment_ids FROM c JOIN s ON c.doc_id = s.doc_id AND c.a < s.b AND s.a < c.b GROUP BY ALL""")
def chunk_segment_overlap(spark, d):
    n = F.length("text")
    seg = docs(spark, d).filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / 700).cast("int") - 1)).alias("k"))
    seg = seg.select("doc_id", F.concat(F.lit("s"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("segment_id"), (F.col("k") * 700).alias("char_start"), F.least((F.col("k") + 1) * 700, "n").alias("char_end"))
    got = retrieval.chunk_segments(retrieval.fixed_chunks(docs(spark, d)), seg)
    return got.select("doc_id", F.col("chunk").cast("long").alias("chunk"), _list(F.col("segment_ids")).alias("segment_ids"))


@query()
def document_properties(spark, d):
    return assembly.properties(docs(spark, d))
