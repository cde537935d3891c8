"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Where the public tokenizer files lie; every operator that needs one takes the path as a parameter.
TOKENIZER_DIR = os.environ.get("FOLIOFORGE_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: the installed package's own answer, else the folder above."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table of a folder. Local Python workers are told where this package lies; a cluster gets it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, have)))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the one folder all executors share.

    Only a local master may do without that setting: a temporary folder takes its place, which goes with the process.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(scratch, "own", None)
        if base is None:
            base = scratch.own = tempfile.mkdtemp(prefix="folioforge-")
            atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/folioforge-{uuid.uuid4().hex}"
    for held in _HELD:
        held.append(path)
    return path


#: Folders made inside each open given_back().
_HELD: list[list[str]] = []


@contextmanager
def given_back(spark: SparkSession):
    """Delete at the end every folder that scratch() made meanwhile, but for those in the list that is given. What was read from them must be used up by then."""
    keep: list[str] = []
    made: list[str] = []
    _HELD.append(made)
    try:
        yield keep
    finally:
        _HELD[:] = [x for x in _HELD if x is not made]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in set(made) - set(keep):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialise(df: DataFrame, partitions: int | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    return written(df, partitions, **options)[0]


def written(df: DataFrame, partitions: int | None = None, **options: str) -> tuple[DataFrame, str]:
    """As materialise(), and the folder."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    (df.coalesce(partitions) if partitions else df).write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep_rows(docs: DataFrame, columns: list[str], judge: Callable) -> DataFrame:
    """Rows of docs, whole, for which the function that ``judge()`` makes in each task says so: given these columns of some rows (Arrow), a list of booleans.

    Rows travel as one struct, so columns may have any name and type, and texts are sent once.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows, places = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row")), [docs.columns.index(c) for c in columns]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        trim()
        says = judge()
        for batch in slices(batches, 500):
            yield batch.filter(pa.array(says(*(pc.struct_field(batch.column(0), [k]) for k in places)), pa.bool_()))

    kept = rows.mapInArrow(work, StructType([StructField("_row", StructType(docs.schema.fields))]))
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def drawn(h, share):
    """Whether a row whose 64-bit hash is h is among this share of all; 53 bits of the hash count, so the smallest shares are met too."""
    return F.shiftrightunsigned(h, 11).cast("double") < share * float(1 << 53)


def fold_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(batch, name: str) -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def trim() -> None:
    """Give the system back what earlier tasks of this worker have freed: glibc keeps it for itself as long as anything lies behind it. Other C libraries go without."""
    import ctypes

    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator, rows: int) -> Iterator:
    """Cut incoming batches so that what a worker builds for one of them stays small. A task begins without what others left behind."""
    trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
