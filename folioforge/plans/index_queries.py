"""Queries of the vector index, distributed top-k and stored partition values, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, vector_index
from ..session import scratch
from ..sources import sinks
from ..sources import tables as T
from ..sources.tables import table
from .document_queries import _DOT, _NORM, _cosine, vectors
from .engine_queries import _EMBEDDED, long, s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def searched(v: DataFrame, queries: DataFrame, k: int, cells: int) -> DataFrame:
    index = vector_index.build_index(v, scratch(v.sparkSession), cells)
    found, _ = vector_index.search(index, queries, k)
    return long(found.select("query_id", "id", "score", "rank"), "rank")


@query(f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_cosine('e.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cosine('e.embedding', 'q.embedding')} DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def indexed_topk(spark, d):
    """Exact top-k by the index, for every row whose id is divisible by 20. The given vectors have no clusters, so the index saves nothing here; indexed_documents is where it does."""
    q = vectors(spark, d).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return searched(vectors(spark, d), q, 5, 16)


_COSINE_OR_0 = f"round(coalesce({_DOT.format(a='e.e', b='q.e')} / nullif({_NORM.format(v='e.e')} * {_NORM.format(v='q.e')}, 0), 0), 6)"


@query(f"""WITH T AS (SELECT doc_id AS id, text FROM documents), v AS ({_EMBEDDED}), s AS (SELECT q.id AS query_id, e.id AS id, {_COSINE_OR_0} AS score FROM v e, v q WHERE q.id % 20 = 0)
SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def indexed_documents(spark, d):
    """The documents nearest to every twentieth one, by an index over their hashed vectors."""
    v, q = document_vectors(spark, d)
    return searched(v, q, 5, 200).withColumn("score", F.round("score", 4))


def document_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of all documents, hashed once and stored, and every twentieth one as a query."""
    v = vector_index.kept(retrieval.hash_embedding(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")).drop("text"))
    return v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"""WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 1 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN vec_id % 50 = 2 OR vec_id % 50 = 3 OR vec_id % 50 = 4 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS e FROM embeddings), s AS (SELECT q.id AS query_id, e.id, {_COSINE_OR_0} AS score FROM e q, e WHERE q.id % 20 = 0 OR q.id % 50 BETWEEN 1 AND 4)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def odd_vectors(spark, d):
    """Vectors of zeros, null ones, shorter ones and ones with a null, among the queries too: all score 0."""
    k, v = F.col("vec_id") % 50, F.col("embedding")
    odd = F.when(k == 1, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(k == 2, None).when(k == 3, F.slice(v, 1, 10)).when(k == 4, F.transform(v, lambda x, i: F.when(i > 0, x))).otherwise(v)
    rows = vectors(spark, d).withColumn("embedding", odd)
    q = rows.filter("vec_id % 20 = 0 or vec_id % 50 between 1 and 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return long(retrieval.multi_query_topk(rows, q, 5), "rank")


# --- stored partition values

_SPACE = "(['007', '7', '1', 'abc', NULL, 'a b', '2024-01-31', '1e3', 'x=y/z', 'true'])[1 + {n} % 10]"


def space(number):
    return F.get(F.array(*map(F.lit, ["007", "7", "1", "abc", None, "a b", "2024-01-31", "1e3", "x=y/z", "true"])), (number % 10).cast("int"))


@query(f"""SELECT o_orderkey AS id, {_SPACE.format(n='(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END)')} AS namespace, epoch_us(date_trunc('year', o_orderdate)) AS version_us, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS round FROM orders""")
def partition_values(spark, d):
    """Every third order is written again to another partition; the partitions are texts that look like numbers, dates or truth values, null, and dates."""
    o, path = table(spark, d, "orders"), scratch(spark)
    year = F.trunc("o_orderdate", "year")
    first = o.select(F.col("o_orderkey").alias("id"), space(F.col("o_orderkey")).alias("namespace"), year.alias("version"), F.lit(0).alias("round"))
    again = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), space(F.col("o_orderkey") + 4).alias("namespace"), year.alias("version"), F.lit(1).alias("round"))
    for rows in (first, again):
        sinks.upsert_partitions(spark, rows, path, "id")
    got = spark.read.schema(first.schema).parquet(path)
    return long(got.select("id", "namespace", F.unix_micros(F.col("version").cast("timestamp")).alias("version_us"), "round"), "round")


@query(f"SELECT namespace, count(*) AS n FROM (SELECT {_SPACE.format(n='o_orderkey')} AS namespace FROM orders) WHERE namespace IS NULL OR namespace NOT IN ('007', 'abc', 'x=y/z', '1e3') GROUP BY 1")
def namespace_values(spark, d):
    """Namespaces that look like other types are deleted by their names as texts: 007 goes, 7 stays."""
    path = scratch(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), space(F.col("o_orderkey")).alias("namespace"), F.lit("v2").alias("version"))
    sinks.upsert_partitions(spark, rows, path, "id")
    names = rows.select(F.col("namespace").alias("id")).filter("id is not null").distinct().withColumn("type", F.lit("testing"))
    gone = ["007", "abc", "x=y/z", "1e3", "1000", "unknown"]
    sinks.remove_namespaces(spark, path, names, gone, gone)
    return spark.read.schema(rows.schema).parquet(path).groupBy("namespace").agg(F.count("*").alias("n"))


@query("SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN ' a b' WHEN 1 THEN ' 100% +x' ELSE ' %20é' END AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def blank_file_names(spark, d):
    """Files with blanks, per cent signs and other letters in their names keep them."""
    k = F.col("doc_id") % 3
    name = F.concat(s("doc_id"), F.when(k == 0, " a b").when(k == 1, " 100% +x").otherwise(" %20é"), F.lit(".md"))
    path = scratch(spark)
    sinks.write_files(table(spark, d, "documents").filter("text is not null").select(name.alias("file"), "text"), path, 256)
    return T.read_markdown(spark, path).select("doc_id", F.md5("text").alias("text_md5"))
