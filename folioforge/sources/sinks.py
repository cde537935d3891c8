"""Writers: partitioned Parquet, keyed upsert, append-only events, deletion of namespaces, rendered files.

Parquet folders have no transactions. Every writer that replaces something stages the new rows first, so a failure while
they are computed leaves the old ones; a failure in the short last step, the move, is repaired by running it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as X


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append-only sink of events, metrics, states and raw responses."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Units, tables, figures or metrics as JSON lines; fields that are null are left out, as readers expect."""
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def one_of_each(rows: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the largest by ``order``, and among equals by the row's text, so that a repetition of the job keeps the same one."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order), F.desc(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_latest(old: DataFrame, new: DataFrame, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """Keyed union: a row of ``new`` replaces the rows of its key in ``old``. Of equal keys in new one stays, see one_of_each()."""
    fresh = one_of_each(new, key, order)
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def upsert_partitions(spark: SparkSession, new: DataFrame, path: str, key: str = "id", partition_by: tuple[str, ...] = ("namespace", "version"), order: tuple[str, ...] = ()) -> None:
    """Upsert into partitioned Parquet, through a staging folder.

    Rewritten are the partitions that ``new`` writes to and those where its keys stood before, so a key that moves to
    another partition leaves no old row behind; a partition that loses its last row is removed. Partition values are
    read back as what ``new`` has them as, never guessed from folder names: "007" stays a text, and null, which shares
    its folder with the empty text, is a value like any other.
    """
    by = list(partition_by)
    for c in (c for c in by if new.schema[c].dataType == StringType()):
        new = new.withColumn(c, F.nullif(F.col(c), F.lit("")))
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    old = _existing(spark, path, new.schema)
    if old is None:
        one_of_each(new, key, order).write.partitionBy(*by).parquet(path)
        return
    moved = old.join(new.select(key).distinct(), key, "left_semi").select(*by)
    touched = new.select(*by).unionByName(moved).distinct()
    same = _on_equal(old, touched, by, "left_semi").select(*new.columns)
    keep_latest(same, new, key, order).write.parquet(staging)
    gone = _on_equal(touched, spark.read.parquet(staging).select(*by).distinct(), by, "left_anti").select(*(F.col(c).cast("string").alias(c) for c in by)).collect()  # partitions, not rows
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for row in gone:
        _remove(spark, _partition(path, {c: row[c] for c in by}))
    _remove(spark, staging)


def _guard(namespaces: DataFrame, names: list[str]) -> None:
    final = namespaces.filter(F.col("id").isin(names) & (F.col("type") == "final")).select("id").collect()
    if final:
        raise PermissionError(f"final namespaces can't be deleted: {sorted(r['id'] for r in final)}")


def delete_namespace(chunks: DataFrame, namespaces: DataFrame, names: list[str]) -> DataFrame:
    """Chunks without those of the named namespaces. Unknown names are skipped, rows without a namespace stay; namespaces of type 'final' are refused."""
    _guard(namespaces, names)
    return chunks.filter(~F.coalesce(F.col("namespace").isin(names), F.lit(False)))


def remove_namespaces(spark: SparkSession, path: str, namespaces: DataFrame, names: list[str], confirm: list[str]) -> list[str]:
    """Delete the named namespaces' partitions below ``path`` (partitioned by namespace first); gives the names that were there.

    ``confirm`` must repeat the names. Unknown names are skipped; namespaces of type 'final' are refused before anything
    goes. Names are compared as texts: "007" isn't "7". Rows without a namespace stay.
    """
    if sorted(confirm) != sorted(names):
        raise ValueError("the names must be confirmed")
    _guard(namespaces, names)
    old = _existing(spark, path, StructType([StructField("namespace", StringType())]))
    if old is None:
        return []
    there = {r["namespace"] for r in old.select("namespace").filter(F.col("namespace").isin(names)).distinct().collect()}
    for name in sorted(there):
        _remove(spark, _partition(path, {"namespace": name}))
    return sorted(there)


def markdown_files(docs: DataFrame) -> DataFrame:
    """(file, text) of docs (doc_id, version, text): ``base.md``, and ``base_enhanced.md`` for v2."""
    return docs.select(F.concat(X.safe_name(F.col("doc_id").cast("string")), F.when(F.col("version") == "v2", "_enhanced.md").otherwise(".md")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))


def write_markdown(docs: DataFrame, path: str, folders: int = 0) -> int:
    """One Markdown file a row of docs, see markdown_files(); gives the number of files."""
    return write_files(markdown_files(docs), path, folders)


def write_files(rows: DataFrame, path: str, folders: int = 0) -> int:
    """One file a row of (file, text) below ``path``, written by the executors; gives the number of files. Many files are better dealt over ``folders`` below it, by a hash of their names.

    ``path`` is a URI that all executors reach. A file is written under a name of its own and then moved, so a task that
    is run again, or twice at once, leaves whole files. Rows that repeat a file name give one file, the largest text.
    """

    def work(batches: Iterator) -> Iterator:
        import uuid
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        made = {root}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/{zlib.crc32(name.encode()) % folders:04d}" if folders else root
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(text.encode())
                where.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files = rows.groupBy("file").agg(F.max("text").alias("text"))
    return files.select("file", "text").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def latest(events: DataFrame, key: str, by: str) -> DataFrame:
    """The latest row of each key; of equal times the largest by the row's text."""
    return one_of_each(events, key, (by,))


def _on_equal(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join in which nulls are equal."""
    same = [left[c].eqNullSafe(right[c]) for c in columns]
    return left.join(right, reduce(lambda a, b: a & b, same), how)


def _existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """What is stored at ``path``, its columns and partition values of the given types; other partition columns are guessed."""
    try:
        stored = spark.read.parquet(path).columns
        return spark.read.schema(StructType([f for f in schema if f.name in stored])).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _partition(path: str, values: dict) -> str:
    """Folder of a partition, its values escaped as Spark's writer escapes them."""
    from pyspark import SparkContext

    escape = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    named = ("__HIVE_DEFAULT_PARTITION__" if v is None or v == "" else escape(str(v)) for v in values.values())
    return "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in zip(values, named, strict=True))])


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
