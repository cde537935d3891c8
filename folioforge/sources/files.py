"""Whole files found and read by the executors: the driver lists nothing and holds no names.

Folders are listed in tasks, a sub-folder each, and their files are dealt over all cores and opened where they are read.
Paths are URIs or places that all executors reach. Names that begin with a dot or an underscore are left out, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes, and files, that a batch of contents holds before it is passed on.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1024


def file_system(path: str) -> tuple:
    """(file system, place in it, what stands before a place in a path). Names are taken as they are, with blanks and per cent signs."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path, ""
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    host, _, name = rest.lstrip("/").partition("/")
    where, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return where, f"{root.rstrip('/')}/{name}", f"{scheme}://{host}"


def open_file(path: str):
    """A file of any file system that pyarrow knows, with seek()."""
    where, place, _ = file_system(path)
    return where.open_input_file(place)


def _entries(path: str, deep: bool) -> Iterator[tuple[str, int, bool]]:
    """(path, bytes, whether it is a folder) of what lies in a folder, or of a file itself."""
    from pyarrow import fs

    where, place, head = file_system(path)
    inside = where.get_file_info(place).type == fs.FileType.Directory
    root = place.rstrip("/")
    for x in where.get_file_info(fs.FileSelector(root, recursive=deep) if inside else [place]):
        if x.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if inside and any(part.startswith((".", "_")) for part in x.path[len(root) + 1 :].split("/")):
            continue
        folder = x.type == fs.FileType.Directory
        yield (path.rstrip("/") + x.path[len(root) :] if inside else path), x.size or 0, folder


def _list(df: DataFrame, deep: bool) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for found in _entries(path, deep):
                    held.append(found)
                    if len(held) == 10_000:
                        yield _table(pa, held)
                        held = []
                yield _table(pa, held)

    def _table(pa, held: list):
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "size", "folder"])

    return df.mapInArrow(work, "path string, size long, folder boolean")


def width(spark: SparkSession) -> int:
    """Tasks that files are dealt over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files at or below ``path``, empty ones too, dealt over tasks. A path with wildcards is left to Spark's own listing, on the driver."""
    ship(spark)
    n = width(spark)
    if any(c in path for c in "*?[{"):
        found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
        return found.repartition(n, "path")
    top = _list(spark.createDataFrame([(path,)], "path string").coalesce(1), False)
    below = _list(top.filter("folder").select("path").repartition(n, "path"), True)
    return top.unionByName(below).filter("not folder").select("path", "size").repartition(n, "path")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content binary) of all files at or below ``path``."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(names: list, contents: list):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for batch in batches:
            names, contents, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with open_file(name) as f:
                    data = f.read()
                names.append(name)
                contents.append(data)
                held += len(data)
                if held >= BATCH_BYTES or len(names) >= BATCH_FILES:
                    yield passed(names, contents)
                    names, contents, held = [], [], 0
            yield passed(names, contents)

    return listed(spark, path).select("path").mapInArrow(work, "path string, content binary")


def as_uri(path: str) -> str:
    """A path as Spark writes it in _metadata.file_path."""
    _, place, head = file_system(path)
    return (head or "file://") + "".join(c if ord(c) > 127 else quote(c, safe="/!$&'()*+,;=:@~") for c in place)
