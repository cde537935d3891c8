"""Chunking, lineage, embedding, vector tables, exact filtered top-k, answers and their sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import text as X
from ..functions.batches import pieces

CHUNK, OVERLAP = 1800, 350
# Separators of the recursive splitter, from coarse to fine.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", " ", ""]


def fixed_chunks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, char_start, char_end, text): windows of fixed stride over the whole text."""
    stride = size - overlap
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / stride).cast("int") - 1)
    rows = documents.filter(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * stride
    return rows.select("doc_id", "chunk", start.alias("char_start"), F.least(start + size, n).alias("char_end"), F.substr("text", start + 1, F.lit(size)).alias("text"))


def split_recursively(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[tuple[int, int]]:
    """Spans of chunks of at most ``size`` characters: split at the coarsest separator that occurs, finer where a part is too long, then merge up with overlap."""
    separators = SEPARATORS if separators is None else separators

    def parts(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= size:
            return [(a, b)]
        while level < len(separators) - 1 and separators[level] and separators[level] not in text[a:b]:
            level += 1
        s = separators[level]
        if not s:
            return [(k, min(k + size, b)) for k in range(a, b, size)]
        out, at = [], a
        while at < b:
            k = text.find(s, at, b)
            end = b if k < 0 else k + len(s)
            out += [(at, end)] if end - at <= size else parts(at, end, min(level + 1, len(separators) - 1))
            at = end
        return out

    chunks: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for p in parts(0, len(text), 0):
        if held and p[1] - held[0][0] > size:
            chunks.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or p[1] - held[0][0] > size):
                held.pop(0)
        held.append(p)
    if held:
        chunks.append((held[0][0], held[-1][1]))
    out = []
    for a, b in chunks:
        body = text[a:b]
        lead = len(body) - len(body.lstrip())
        if body.strip():
            out.append((a + lead, a + len(body.rstrip())))
    return out


def recursive_chunks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, char_start, char_end, text); offsets come from the splitter itself, never from searching."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, (a, b) in enumerate(split_recursively(t, size, overlap))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=["doc_id", "chunk", "char_start", "char_end", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, chunk int, char_start int, char_end int, text string")


def chunk_segments(chunks: DataFrame, segments: DataFrame, bin_size: int = CHUNK) -> DataFrame:
    """(doc_id, chunk, segment_ids): segments that overlap a chunk. A range join with bins as added keys: a pair is found in each bin both touch and kept in the first."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / bin_size)))
    c = chunks.select("doc_id", "chunk", "char_start", "char_end", bins("char_start", "char_end").alias("bin"))
    s = segments.select("doc_id", "segment_id", F.col("char_start").alias("s_start"), F.col("char_end").alias("s_end"), bins("char_start", "char_end").alias("bin"))
    hit = (F.col("char_start") < F.col("s_end")) & (F.col("s_start") < F.col("char_end")) & (F.floor(F.greatest("char_start", "s_start") / bin_size) == F.col("bin"))
    return c.join(s, ["doc_id", "bin"]).filter(hit).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_set("segment_id")).alias("segment_ids"))


def hash_embedding(documents: DataFrame, dim: int = 64, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Rows with ``embedding``, unit vectors: a provider's, or signed word hashes, which stand for no model's quality.

    A word adds +1 or -1 (fifth hexadecimal digit of its md5, even or odd) at the slot its first eight digits give. Texts
    without words, null ones too, get the zero vector.
    """

    def hashed(texts: list[str]) -> list:
        import hashlib

        import numpy as np

        class Known(dict):
            """Twice a word's slot, and one more for those that add -1."""

            def __missing__(self, w: str) -> int:
                h = hashlib.md5(w.encode()).hexdigest()
                self[w] = at = int(h[:8], 16) % dim * 2 + int(h[8], 16) % 2
                return at

        out, known = [], Known()
        for t in texts:
            words = (t or "").lower().split()
            n = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=2 * dim)
            v = (n[0::2] - n[1::2]).astype(np.float64)
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    call = embed or hashed
    schema = StructType([*documents.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(call(texts), pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return documents.mapInArrow(work, schema)


def embed_query(spark: SparkSession, texts: dict[int, str], dim: int = 64, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
    """(query_id, question, q): query texts as vectors of the same embedder as the documents'."""
    rows = spark.createDataFrame(sorted(texts.items()), "query_id long, text string")
    return hash_embedding(rows, dim, embed).select("query_id", F.col("text").alias("question"), F.col("embedding").alias("q"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Six digits; 0 where either vector is all zeros, which has no direction."""
    return F.round(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)), 6)


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, id_column: str = "vec_id") -> DataFrame:
    """The k rows of largest cosine with the one row of ``query`` (column q): a broadcast of one row, then TakeOrderedAndProject. Zero vectors score 0."""
    one = query.limit(1).select("q", norm(F.col("q")).alias("_nq"))
    score = F.try_divide(dot(F.col("embedding"), F.col("q")), norm(F.col("embedding")) * F.col("_nq"))
    scored = vectors.crossJoin(F.broadcast(one)).withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 6))
    return scored.drop("q", "_nq").orderBy(F.desc("score"), id_column).limit(k)


def multi_query_topk(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", *by: str) -> DataFrame:
    """(query_id, *by, id, score, rank): exact top-k of each query (within each value of ``by``); queries and vectors meet as a grid of shards, see vector_index. Null vectors and those without a direction, of either side, score 0."""
    from . import vector_index

    return vector_index.multi_query_topk(vectors, queries, k, id_column, *by)


def compare_versions(results: DataFrame) -> DataFrame:
    """(query_id, rank, v1_id, v1_score, v2_id, v2_score) from top-k lists by version."""
    pick = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{v}_{c}")
    return results.groupBy("query_id", "rank").agg(pick("v1", "id"), pick("v1", "score"), pick("v2", "id"), pick("v2", "score"))


def min_max(score: Column, over: Window, invert: bool = False) -> Column:
    """Scores to 0..1 over a window; 1 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    scaled = (score - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(1 - scaled if invert else scaled, F.lit(1.0))


def display_score(score: Column, over: Window) -> Column:
    """Raw scores if all lie in 0..1, else min-max; four digits."""
    raw = (F.min(score).over(over) >= 0) & (F.max(score).over(over) <= 1)
    return F.round(F.when(raw, score).otherwise(min_max(score, over)), 4)


def resolve_score(relevance: Column, score: Column, distance: Column) -> Column:
    return F.coalesce(relevance, score, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance)))


def sources(results: DataFrame) -> DataFrame:
    """(id, score, snippet, metadata) of ranked chunks with ``text``."""
    keys = [c for c in ("source_document", "version", "namespace", "char_start", "char_end", "pages", "header_paths") if c in results.columns]
    meta = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    return results.select(F.col("id").cast("string").alias("id"), F.round("score", 4).alias("score"), X.snippet_400(F.col("text")).alias("snippet"), meta.alias("metadata")).orderBy(F.desc("score"), "id")


def stuff_context(results: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, context): texts by rank, a blank line between them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return results.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("context"), F.count("*").alias("n_context"))


#: What an answerer is told, around {context} and {question}: ground rules, the context of all documents, the question.
ANSWER_PROMPT = """You answer questions from the documents below and from nothing else.

Rules:
1. Use every document of the context that bears on the question, and name the document that a statement comes from.
2. Give figures, dates and names exactly as they stand, with what they refer to.
3. Use bullet points or numbers where the answer is a list, and group it by document where that helps.
4. Don't guess and don't add general knowledge. If no document holds the answer, say: that information isn't in the documents.

CONTEXT (from several documents):
{context}

QUESTION:
{question}

ANSWER:"""


def answer_events(answers: DataFrame, model: str, ts: Column | None = None) -> DataFrame:
    """Ledger rows (ts, step, model, input_tokens, output_tokens, meta) of answers, failed ones too, for append()."""
    meta = F.create_map(F.lit("query_id"), F.col("query_id").cast("string"), F.lit("status"), F.col("status"))
    when = ts if ts is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return answers.select(when.alias("ts"), F.lit("chat").alias("step"), F.lit(model).alias("model"), F.col("input_tokens").cast("long").alias("input_tokens"), F.coalesce(F.col("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"), meta.alias("meta"))


def answer(contexts: DataFrame, template: str = "CONTEXT:\n{context}\n\nQUESTION: {question}\n", generate: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, answer, status, error, input_tokens, output_tokens); the stub quotes the context's first sentence. Failures are rows, not text."""
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.col("context")), F.lit("{question}"), F.col("question"))
    call = generate or (lambda p: p.split("CONTEXT:\n", 1)[-1].split(". ", 1)[0][:400])

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for p in batch.column(1).to_pylist():
                try:
                    rows.append((call(p or ""), "ok", None))
                except Exception as e:  # a hook may fail in any way; the row tells
                    rows.append((None, "error", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=["query_id", "prompt", "answer", "status", "error"])

    rows = contexts.select(F.col("query_id").cast("long").alias("query_id"), prompt.alias("prompt")).mapInArrow(work, "query_id long, prompt string, answer string, status string, error string")
    return rows.select("query_id", "answer", "status", "error", X.token_estimate(F.col("prompt")).alias("input_tokens"), X.token_estimate(F.col("answer")).alias("output_tokens"))


def message_tokens(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tokens of a message list: three for each message, one more for each that has a ``name`` (where there is such a column) besides the name's own, and three at the end."""
    named = F.when(F.col("name").isNotNull(), X.token_estimate(F.col("name")) + 1).otherwise(0) if "name" in messages.columns else F.lit(0)
    each = X.token_estimate(F.col("text")) + X.token_estimate(F.col("role")) + 3 + named
    return messages.groupBy(key).agg((F.sum(each) + 3).alias("tokens"), F.count("*").alias("messages"))


def namespace_stats(chunks: DataFrame) -> DataFrame:
    """Rows by namespace and in total (namespace null, last), sorted by name."""
    counted = chunks.rollup("namespace").agg(F.grouping("namespace").alias("_total"), F.count("*").alias("total_chunks"))
    return counted.orderBy("_total", F.asc_nulls_first("namespace")).drop("_total")
