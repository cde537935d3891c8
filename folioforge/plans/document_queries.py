"""Queries of retrieval, windows, curation and synthesis, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, enrichment, retrieval
from ..sources.sinks import keep_latest
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cosine(a: str, b: str) -> str:
    return f"round({_DOT.format(a=a, b=b)} / ({_NORM.format(v=a)} * {_NORM.format(v=b)}), 6)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def first_vector(spark: SparkSession, d: str) -> DataFrame:
    """The vector of the smallest id, as the query."""
    return vectors(spark, d).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT doc_id, k AS chunk, k * 1450 AS a, substr(text, k * 1450 + 1, 1800) AS t, lang FROM (SELECT doc_id, text, lang, unnest(range(0, greatest(0, CAST(ceil((length(text) - 350) / 1450.0) AS INT) - 1) + 1)) AS k FROM documents WHERE length(text) > 0)),
top AS (SELECT c.doc_id, c.chunk, c.a, c.t, {_cosine('e.embedding', 'q.q')} AS score FROM c JOIN embeddings e ON e.vec_id = c.doc_id, q WHERE c.lang = 'en' ORDER BY score DESC, c.doc_id, c.chunk LIMIT 15)
SELECT doc_id || '_v2_' || chunk AS id, score, a AS char_start, CASE WHEN length(t) <= 400 THEN t ELSE CASE WHEN p > 0 AND 400 - p > 320 THEN substr(h, 1, 400 - p) ELSE h END || '...' END AS snippet FROM (SELECT *, substr(t, 1, 400) AS h, instr(reverse(substr(t, 1, 400)), ' ') AS p FROM top)""")
def retrieve_topk(spark, d):
    """Flagship: the best documents of one language by cosine, then their chunks, top-k with snippets.

    A document has a chunk at least and its chunks share its score, so the chunks of the 15 best documents hold the 15
    best chunks: only those are cut.
    """
    docs = table(spark, d, "documents").filter("lang = 'en' and length(text) > 0").select("doc_id", "text")
    one = first_vector(spark, d).select("q", retrieval.norm(F.col("q")).alias("nq"))
    e = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding").crossJoin(F.broadcast(one))
    score = F.try_divide(retrieval.dot(F.col("embedding"), F.col("q")), retrieval.norm(F.col("embedding")) * F.col("nq"))
    e = e.select("doc_id", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))
    best = docs.select("doc_id").join(e, "doc_id").orderBy(F.desc("score"), "doc_id").limit(15)
    texts = docs.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")  # 15 rows
    top = retrieval.fixed_chunks(texts).join(F.broadcast(best), "doc_id").orderBy(F.desc("score"), "doc_id", "chunk").limit(15)
    return top.select(F.concat(F.col("doc_id").cast("string"), F.lit("_v2_"), F.col("chunk").cast("string")).alias("id"), "score", F.col("char_start").cast("long").alias("char_start"), X.snippet_400(F.col("text")).alias("snippet"))


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, label, {_cosine('embedding', 'q')} AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return retrieval.cosine_topk(vectors(spark, d), first_vector(spark, d), 10).select("vec_id", "label", "score")


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, label, {_cosine('embedding', 'q')} AS score FROM embeddings, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark, d):
    return retrieval.cosine_topk(vectors(spark, d).filter("label = 3"), first_vector(spark, d), 10).select("vec_id", "label", "score")


@query(f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_cosine('e.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cosine('e.embedding', 'q.embedding')} DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def multi_query_topk(spark, d):
    """The stated query set: every row whose id is divisible by 20, against all rows, in blocks."""
    q = vectors(spark, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.multi_query_topk(vectors(spark, d), q, 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, CASE WHEN e.label % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, {_cosine('e.embedding', 'q.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, version ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank, max(CASE WHEN version = 'v1' THEN id END) AS v1_id, max(CASE WHEN version = 'v1' THEN score END) AS v1_score, max(CASE WHEN version = 'v2' THEN id END) AS v2_id, max(CASE WHEN version = 'v2' THEN score END) AS v2_score FROM r WHERE rank <= 3 GROUP BY query_id, rank""")
def version_compare(spark, d):
    q = vectors(spark, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = vectors(spark, d).withColumn("version", F.when(F.col("label") % 2 == 0, "v1").otherwise("v2"))
    return retrieval.compare_versions(retrieval.multi_query_topk(v, q, 3, "vec_id", "version").withColumn("rank", F.col("rank").cast("long")))


@query("""SELECT event_id, CASE WHEN min(value) OVER w >= 0 AND max(value) OVER w <= 1 THEN round(value, 4) ELSE round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 1.0), 4) END AS score FROM events WINDOW w AS (PARTITION BY event_type)""")
def score_minmax(spark, d):
    return table(spark, d, "events").select("event_id", retrieval.display_score(F.col("value"), Window.partitionBy("event_type")).alias("score"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value * 2 END, least(1.0, greatest(0.0, 1 - value))), 6) AS score FROM events")
def score_resolution(spark, d):
    k, v = F.col("event_id") % 3, F.col("value")
    return table(spark, d, "events").select("event_id", F.round(retrieval.resolve_score(F.when(k == 0, v), F.when(k == 1, v * 2), v), 6).alias("score"))


@query("SELECT conv_id AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context, count(*) AS n_context FROM conversations GROUP BY conv_id")
def stuff_context(spark, d):
    return retrieval.stuff_context(table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"))


@query("""SELECT query_id, answer, 'ok' AS status, CASE WHEN length(p) = 0 THEN 0 ELSE greatest(1, length(p) // 4) END AS input_tokens, CASE WHEN length(answer) = 0 THEN 0 ELSE greatest(1, length(answer) // 4) END AS output_tokens FROM (
SELECT conv_id AS query_id, 'CONTEXT:' || chr(10) || c || chr(10) || chr(10) || 'QUESTION: what?' || chr(10) AS p, substr(string_split(c || chr(10) || chr(10) || 'QUESTION: what?' || chr(10), '. ')[1], 1, 400) AS answer FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id))""")
def answer_stub(spark, d):
    ctx = stuff_context(spark, d).withColumn("question", F.lit("what?"))
    got = retrieval.answer(ctx)
    return got.select("query_id", "answer", "status", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))


_ROLE = "CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END"


@query(f"""SELECT conv_id, string_agg(CASE WHEN turn > 0 AND (turn // 2) <> ((turn - 1) // 2) THEN '---' || chr(10) || chr(10) || '## Page ' || (turn // 2) || chr(10) || chr(10) ELSE '' END || CASE WHEN upper(text) = text AND lower(text) <> text AND length(text) < 80 THEN '### ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE text <> '' GROUP BY conv_id""")
def reading_order_assembly(spark, d):
    c = table(spark, d, "conversations")
    units = c.select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("page"), F.lit("single").alias("column"), F.col("turn").cast("double").alias("y0"), (F.col("turn") + 1).cast("double").alias("y1"), F.lit(0.0).alias("x0"), F.format_string("u%05d", F.col("turn")).alias("unit_id"), F.lit("paragraph").alias("unit_type"), F.col("text").alias("content"))
    return assembly.assemble(assembly.reading_order(units)).select(F.col("doc_id").alias("conv_id"), "markdown")


@query("""WITH RECURSIVE u AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT conv_id, k, turn, n, 0 AS win, n AS total FROM u WHERE k = 1 UNION ALL
SELECT u.conv_id, u.k, u.turn, u.n, CASE WHEN w.total + u.n > 200 THEN w.win + 1 ELSE w.win END, CASE WHEN w.total + u.n > 200 THEN u.n ELSE w.total + u.n END FROM w JOIN u ON u.conv_id = w.conv_id AND u.k = w.k + 1)
SELECT conv_id, win AS window_no, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY k) AS members, sum(n) AS tokens FROM w GROUP BY conv_id, win""")
def window_pack(spark, d):
    return _packed(spark, d, 0)


def _packed(spark: SparkSession, d: str, overlap: int) -> DataFrame:
    units = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("unit_id"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    w = enrichment.pack_windows(units, 200, overlap)
    return w.select(F.col("doc_id").alias("conv_id"), F.col("window").cast("long").alias("window_no"), F.array_join("members", ",").alias("members"), F.col("tokens").cast("long").alias("tokens"))


@query()
def window_pack_overlap(spark, d):
    return _packed(spark, d, 60)


@query(r"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, regexp_replace(trim(lower(substr(text, 1, 200))), '\s+', ' ', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_fingerprint(spark, d):
    items = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    return enrichment.drop_near_duplicates(items, "lang", ("doc_id",)).select("doc_id")


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'Approved' WHEN toxic = 1 THEN 'rejected' ELSE 'edited' END AS status FROM labels) WHERE lower(status) IN ('approved', 'edited')")
def approved_only(spark, d):
    status = F.when(F.col("quality") == 1, "Approved").when(F.col("toxic") == 1, "rejected").otherwise("edited")
    return enrichment.approved(table(spark, d, "labels").withColumn("status", status)).select("doc_id", "quality")


@query("""WITH i AS (SELECT doc_id, source, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang END IS NOT NULL AS ok FROM documents), s AS (SELECT source, avg((NOT ok)::INT) AS bad FROM i GROUP BY source)
SELECT i.doc_id FROM i JOIN s USING (source) WHERE ok AND bad <= 0.1""")
def type_validity_ratio(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.col("source").alias("window"), F.col("lang").alias("type"))
    selected = spark.createDataFrame([("en",), ("fr",), ("de",)], "type string")
    kept = enrichment.valid_types(items.withColumn("id", F.col("doc_id")).withColumn("doc_id", F.lit(0)), selected, 0.1)
    return kept.select(F.col("id").alias("doc_id"))


@query("""SELECT doc_id, priority, rank FROM (SELECT doc_id, source, priority, row_number() OVER (PARTITION BY source ORDER BY priority DESC, conf DESC, doc_id) AS rank FROM (
SELECT doc_id, source, conf, least(10, greatest(1, CASE WHEN t IN ('formula_discovery') THEN 8 WHEN t = 'pattern_recognition' THEN 6 ELSE 5 END + (n_chars > 2000)::INT + (conf >= 0.85)::INT)) AS priority FROM (SELECT doc_id, source, n_chars, (doc_id % 100) / 100.0 AS conf, CASE WHEN lang = 'en' THEN 'formula_discovery' WHEN lang = 'fr' THEN 'pattern_recognition' ELSE 'other' END AS t FROM documents)))""")
def priority_rank(spark, d):
    kind = F.when(F.col("lang") == "en", "formula_discovery").when(F.col("lang") == "fr", "pattern_recognition").otherwise("other")
    rows = table(spark, d, "documents").withColumn("confidence", (F.col("doc_id") % 100) / 100.0).withColumn("ordinal", F.col("doc_id"))
    rows = rows.withColumn("priority", enrichment.priority_score(kind, F.when(F.col("n_chars") > 2000, "financial").otherwise("general"), F.col("confidence")))
    return enrichment.rank(rows, "source").select("doc_id", F.col("priority").cast("long").alias("priority"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE 1 END AS n_items, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 'k' || json_extract_string(props, '$.k') END AS title FROM events""")
def json_recover(spark, d):
    """Five shapes of a generated response: plain, fenced, trailing comma, wrapped in prose, hopeless."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"enhancements": [{"type": "t", "title": "k'), k, F.lit('", "content": "c"}]}'))
    m = F.col("event_id") % 5
    raw = F.when(m == 0, body).when(m == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(m == 2, F.regexp_replace(body, r"\}\]\}$", "},]}")).when(m == 3, F.concat(F.lit("Sure, this is it: "), body, F.lit(" Done."))).otherwise("no json at all")
    got = table(spark, d, "events").select("event_id", enrichment.recover_json(raw).alias("i"))
    return got.select("event_id", F.size("i").cast("long").alias("n_items"), F.get("i", F.lit(0))["title"].alias("title"))


@query("SELECT source AS doc_id, lang AS type, count(*) AS n FROM documents GROUP BY source, lang")
def type_distribution(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("type"))
    return enrichment.type_distribution(rows).select("doc_id", F.explode("distribution").alias("type", "n"))


_ANCHORS = """SELECT b.item_id, d.doc_id, instr(d.text, b.text) AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


@query(_ANCHORS)
def anchor_find(spark, d):
    return anchored(spark, d).select("item_id", "doc_id", "position")


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as anchors in documents, with the first place of each."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor"))
    return enrichment.find_anchors(table(spark, d, "documents").select("doc_id", "text"), items)


@query(f"SELECT doc_id, count(*) AS footnotes FROM ({_ANCHORS}) GROUP BY doc_id")
def footnote_counts(spark, d):
    hits = anchored(spark, d)
    notes = hits.select("doc_id", F.col("item_id").alias("ordinal"), "anchor", F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("x").alias("type"))
    docs = table(spark, d, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return enrichment.synthesise(docs, notes).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("anchored").cast("long").alias("footnotes"))


@query("SELECT label, count(*) AS total_chunks FROM embeddings GROUP BY ROLLUP (label)")
def namespace_stats(spark, d):
    got = retrieval.namespace_stats(vectors(spark, d).select(F.col("label").alias("namespace")))
    return got.select(F.col("namespace").alias("label"), "total_chunks")


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 7)")
def namespace_delete(spark, d):
    from ..sources.sinks import delete_namespace

    names = spark.createDataFrame([("2", "testing"), ("3", "final"), ("7", "testing")], "id string, type string")
    kept = delete_namespace(vectors(spark, d).withColumn("namespace", F.col("label").cast("string")), names, ["2", "7", "unknown"])
    return kept.select("vec_id", "label")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 7 = 1")
def namespace_upsert(spark, d):
    v = vectors(spark, d).select("vec_id", "label")
    changed = v.filter("vec_id % 7 = 0").withColumn("label", F.col("label") + 100)
    added = v.filter("vec_id % 7 = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return keep_latest(v, changed.unionByName(added), "vec_id")


@query()
def hashed_embeddings(spark, d):
    return retrieval.hash_embedding(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query()
def enrichment_flow(spark, d):
    """Units, windows, stub generation, recovery, validation, ranking and synthesis in one plan.

    Every window is generated for. Notes go by rank: of those at one place, and in the appendix, the first come first. A generator gets the window's whole content, not user_prompt, which has a cap.
    """
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    chunks = retrieval.recursive_chunks(table(spark, d, "documents").select("doc_id", "text"), overlap=0)
    units = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk").alias("ordinal"), F.col("chunk").cast("string").alias("unit_id"), F.lit("paragraph").alias("unit_type"), F.col("text").alias("content"), X.token_estimate(F.col("text")).alias("tokens"))
    windows = enrichment.analyse_window(enrichment.window_content(enrichment.pack_windows(units), units))
    items = enrichment.long_enough(enrichment.items_of(enrichment.generate(windows, keep=("content_type",)), "content_type"))
    selected = spark.createDataFrame([(t,) for t in enrichment.HIGH_TYPES + enrichment.MEDIUM_TYPES], "type string")
    items = enrichment.valid_types(items, F.broadcast(selected))
    # ordinals count within a window; from here on within the document
    items = items.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("window", "ordinal")) - 1)
    items = items.withColumn("priority", enrichment.priority_score(F.col("type"), F.col("content_type"), F.col("confidence")))
    items = enrichment.rank(enrichment.drop_near_duplicates(items))
    notes = items.select("doc_id", F.col("rank").alias("ordinal"), F.col("title").alias("anchor"), "title", "content", "type")
    return enrichment.synthesise(docs, notes)
