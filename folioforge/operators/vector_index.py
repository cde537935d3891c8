"""Top-k over vectors without the driver, and an exact index over cells of near vectors.

grid_topk() meets queries and vectors as a grid of shards, both sides distributed. A vector index cuts the vectors into
cells, each with a centre, and stores them by cell. A search visits the nearest cells first, and then those only that the
triangle inequality can't rule out: a cell whose members lie between ``low`` and ``radius`` from its centre holds nothing
nearer to a query than that ring is, nor than the box of its members' sketches is to the query's. A sketch has the vector's
AXES principal coordinates and the length of what they leave over; sketches are never farther apart than their vectors.
What a search finds is what a full scan finds; what it saves depends on how clustered the vectors are, and share_read()
tells it.

Vectors that are null, empty, of another length than the query, all zeros or not finite score 0 with every query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.batches import pieces
from ..session import scratch

#: Vectors and queries of a shard: what a task holds of either side (fewer vectors where they have over 64 components).
SHARD, QUERY_SHARD = 65_536, 8_192
#: Vectors and queries of one matrix product within a shard.
BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors that an index is fitted on, at most: those of smallest hash. Every vector is indexed.
SAMPLE = 50_000
#: Principal coordinates of a sketch.
AXES = 16
#: The cell of vectors without a direction.
ODD_CELL = -1
#: What rounding to six digits can move a score by, and float64 sums besides.
SLACK = 2e-6


def directions(column, dims: int):
    """(unit rows float64, which rows have a direction) of an Arrow column of lists; rows without one are all zeros."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    whole = np.asarray(column.is_valid()) & (sizes == dims)
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    rows = np.zeros((len(column), dims))
    if whole.any():
        rows[whole] = flat[starts[whole][:, None] + np.arange(dims)]
    length = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    rows[~good] = 0
    rows[good] /= length[good][:, None]
    return rows, good


def sharded(df: DataFrame, part: list[str], size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(df with its shard number ``name`` within its part, (part, n_<name>): shards of each part). Shards have some ``size`` rows each."""
    counts = df.groupBy(*part).agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{name}"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"n_{name}")).cast("int")
    return df.join(counts, part).withColumn(name, place).drop(f"n_{name}"), counts


def grid_topk(vectors: DataFrame, queries: DataFrame, k: int, dims: int, part: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *by, id, score): at least the k best of vectors (id, embedding, *part, *by) for each of queries (query_id, q, *part), of the same part.

    Each part is a grid of vector shards and query shards; a cell of the grid is one task of matrix products in blocks, which gives
    k rows a query (and value of ``by``). Vectors are sent once for each QUERY_SHARD queries, queries once for each SHARD
    vectors, and nothing through the driver. best() takes the k best of all.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if not part:
        part = ["_part"]
        vectors, queries = vectors.withColumn("_part", F.lit(0)), queries.withColumn("_part", F.lit(0))
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "embedding", *part, *by)
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "q", *part)
    v, v_counts = sharded(vectors, part, max(1, SHARD * 64 // max(64, dims)), "vs")
    q, q_counts = sharded(queries, part, QUERY_SHARD, "qs")
    every = lambda df, counts, name: df.join(counts, part).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"n_{name}") - 1))).drop(f"n_{name}")
    key = [*part, "vs", "qs"]
    kinds = [vectors.schema[c].dataType for c in by]
    schema = StructType([StructField("query_id", LongType()), *(StructField(c, t) for c, t in zip(by, kinds, strict=True)), StructField("id", LongType()), StructField("score", DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def meet(vs, qs):
        import numpy as np

        if not vs.num_rows or not qs.num_rows:
            return arrow.empty_table()
        u, _ = directions(qs.column("q"), dims)
        asked, keys = qs.column("query_id"), vs.select(list(by))
        groups: dict[tuple, list[int]] = {}
        vectors = vs.column("embedding").combine_chunks()
        for at, value in enumerate(zip(*(c.to_pylist() for c in keys.columns), strict=True) if by else [()] * vs.num_rows):
            groups.setdefault(value, []).append(at)
        ids = vs.column("id").to_numpy()
        out = []
        for value, at in groups.items():
            order = np.array(at)[np.argsort(ids[at], kind="stable")]
            n, m = len(order), min(k, len(order))
            # a key is one number: the score's digits, larger ones first, then the place by id; so the m smallest keys are the m best
            top = np.zeros((len(u), 0), np.int64)
            for start in range(0, n, BLOCK):
                some = order[start : start + BLOCK]
                x, _ = directions(vectors.take(pa.array(some)), dims)
                held = []
                for first in range(0, len(u), QUERY_BLOCK):
                    key = np.rint(u[first : first + QUERY_BLOCK] @ x.T * 1e6).astype(np.int64)
                    key *= -n
                    key += np.arange(start, start + len(some))
                    key = np.concatenate([top[first : first + QUERY_BLOCK], np.partition(key, m - 1, axis=1)[:, :m] if len(some) > m else key], axis=1)
                    held.append(np.partition(key, m - 1, axis=1)[:, :m] if key.shape[1] > m else key)
                top = np.concatenate(held)
            top.sort(axis=1)
            place = top % n
            rows = np.repeat(np.arange(len(u)), m)
            found = [asked.take(pa.array(rows)), *(pa.array([v] * len(rows), arrow.field(c).type) for c, v in zip(by, value, strict=True))]
            out.append(pa.table([*found, pa.array(ids[order][place].ravel()), pa.array(((place - top) // n / 1e6).ravel())], schema=arrow))
        return pa.concat_tables(out)

    left = every(v, q_counts, "qs").groupBy(*key)
    return left.cogroup(every(q, v_counts, "vs").groupBy(*key)).applyInArrow(meet, schema)


def best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """Rows with ``rank``, the k of largest score for each query (and value of ``by``); of equal scores the smaller id."""
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dims(df: DataFrame, column: str) -> int:
    """The most frequent length of a column's vectors."""
    first = df.filter(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def multi_query_topk(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", *by: str) -> DataFrame:
    """(query_id, *by, id, score, rank): exact top-k by cosine of each query (within each value of ``by``), see grid_topk(). Rows that repeat a query's id are one query's: give ids of their own."""
    dims = _dims(vectors, "embedding")
    rows = vectors.select(F.col(id_column).alias("id"), "embedding", *by)
    return best(grid_topk(rows, queries.select("query_id", "q"), k, max(1, dims), None, by), k, *by)


class VectorIndex:
    """An index at a folder: ``vectors`` (id, embedding, other columns, gap) partitioned by cell, and the ``cells``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        """(cell, centre, n, low, radius, box_low, box_high), a row for each cell that has vectors; ODD_CELL has no centre."""
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def axes(self) -> list[list[float]]:
        """Principal axes of the sample the index was fitted on, one long each."""
        return [r["axis"] for r in self.spark.read.parquet(f"{self.path}/axes").orderBy("k").collect()]


def sketched(u, axes):
    """Sketches of unit rows: coordinates on orthonormal axes, and the length of the rest."""
    import numpy as np

    p = u @ axes.T
    return np.concatenate([p, np.sqrt(np.maximum(0.0, (u * u).sum(axis=1) - (p * p).sum(axis=1)))[:, None]], 1)


def unit(v: Column) -> Column:
    """A vector on the unit sphere; null for one without a direction."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((length > 0) & (length < float("inf")), F.transform(v, lambda x: x.cast("double") / length))


def build_index(vectors: DataFrame, path: str, cells: int = 64, id_column: str = "vec_id", seed: int = 7, rounds: int = 8) -> VectorIndex:
    """Index of all rows of vectors at ``path``.

    Centres come from k-means over the SAMPLE vectors of smallest hash, at most, and axes from their principal components;
    then every vector goes to its nearest centre. A cell's ring and box are measured on all its members, so searches are
    exact however good centres and axes are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    spark, path = vectors.sparkSession, path.rstrip("/")
    dims = _dims(vectors, "embedding")
    directed = vectors.select(F.when(F.size("embedding") == dims, unit(F.col("embedding"))).alias("u")).filter("u is not null")
    # fitting goes over the sample in many passes
    sample = kept(directed.orderBy(F.xxhash64("u")).limit(SAMPLE)).select(array_to_vector("u").alias("features"))
    centres, axes = [], []
    if (n := sample.count()) > 0:
        axes = PCA(k=min(AXES, dims), inputCol="features", outputCol="p").fit(sample).pc.toArray().T.tolist() if n > 1 else []
        centres = [c.tolist() for c in KMeans(k=max(2, cells), seed=seed, maxIter=rounds).fit(sample).clusterCenters()]
    schema = StructType([StructField("cell", LongType()), StructField("gap", DoubleType()), StructField("sketch", ArrayType(DoubleType())), StructField("row", vectors.schema)])

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c, a = np.array(centres, np.float64).reshape(len(centres), dims), np.array(axes, np.float64).reshape(len(axes), dims)
        for batch in pieces(batches, 2048):
            u, good = directions(batch.column(1), dims)
            far = np.full((len(u), 1), np.inf) if not len(c) else np.sqrt(np.maximum(0, (u * u).sum(axis=1)[:, None] - 2 * u @ c.T + (c * c).sum(axis=1)))
            at = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(good, at, ODD_CELL)), pa.array(np.where(good, far.min(axis=1), 0.0)), pa.array(list(sketched(u, a)), pa.list_(pa.float64())), batch.column(0)], names=["cell", "gap", "sketch", "row"])

    rows = vectors.select(F.struct(*(F.col(f"`{c}`") for c in vectors.columns)).alias("row"), "embedding").mapInArrow(place, schema)
    rows = rows.select(*(F.col("row").getField(c).alias("id" if c == id_column else c) for c in vectors.columns), "cell", "gap", "sketch")
    # a small cell is one file, a large one is split over as many tasks as its size asks for
    spark.sql("SELECT /*+ REBALANCE(cell) */ * FROM {rows}", rows=rows).sortWithinPartitions("cell", "gap").write.partitionBy("cell").parquet(f"{path}/vectors")
    index = VectorIndex(spark, path)
    centre = F.get(F.from_json(F.lit(str(centres)), "array<array<double>>"), F.col("cell").cast("int"))
    box = [F.array(*(f(F.col("sketch")[k]) for k in range(len(axes) + 1))).alias(name) for f, name in ((F.min, "box_low"), (F.max, "box_high"))]
    index.vectors.groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("radius"), *box).withColumn("centre", centre).coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame(list(enumerate(axes)), "k int, axis array<double>").coalesce(1).write.parquet(f"{path}/axes")
    return index


def bounds(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, q, cell, n, bound, place): every cell for every query by how near its ring comes. place: the number of vectors in nearer cells. There are as many rows as queries times cells; vectors don't count."""
    cells, axes = index.cells.collect(), index.axes  # a row for each cell, as many as the index was built with
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q")
    schema = StructType([*asked.schema, *(StructField(c, t) for c, t in (("cell", LongType()), ("n", LongType()), ("bound", DoubleType()), ("place", LongType())))])

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        inner = [c for c in cells if c["centre"] is not None]
        dims = len(inner[0]["centre"]) if inner else 1
        centre = np.array([c["centre"] for c in inner]).reshape(len(inner), dims)
        low, high, axis = np.array([c["low"] for c in inner]), np.array([c["radius"] for c in inner]), np.array(axes).reshape(len(axes), dims)
        box_low, box_high = (np.array([c[k] for c in inner]).reshape(len(inner), len(axes) + 1) for k in ("box_low", "box_high"))
        order = [*inner, *(c for c in cells if c["centre"] is None)]
        names, sizes = np.array([c["cell"] for c in order], np.int64), np.array([c["n"] for c in order], np.int64)
        for batch in pieces(batches, 64):  # a query becomes a row for each cell
            u, good = directions(batch.column(1), dims)
            d = np.sqrt(np.maximum(0, (u * u).sum(axis=1)[:, None] - 2 * u @ centre.T + (centre * centre).sum(axis=1)))
            ring = np.maximum(0, np.maximum(d - high, low - d))
            sketch = sketched(u, axis)
            for at in range(0, len(u), 64):
                away = np.maximum(0, np.maximum(box_low - sketch[at : at + 64, None], sketch[at : at + 64, None] - box_high))
                ring[at : at + 64] = np.maximum(ring[at : at + 64], np.sqrt((away * away).sum(axis=2)))
            # vectors without a direction score 0, as if they stood at a right angle; so do all for a query without one
            near = np.concatenate([ring, np.full((len(u), len(order) - len(inner)), 2**0.5)], 1)
            first = np.concatenate([d, np.full((len(u), len(order) - len(inner)), 2**0.5)], 1)
            near[~good] = 0
            by = np.argsort(first, axis=1, kind="stable")
            many = np.cumsum(sizes[by], axis=1) - sizes[by]
            take = pa.array(np.repeat(np.arange(len(u)), len(order)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(names[by].ravel()), pa.array(sizes[by].ravel()), pa.array(np.take_along_axis(near, by, 1).ravel()), pa.array(many.ravel())],
                names=["query_id", "q", "cell", "n", "bound", "place"],
            )

    return asked.mapInArrow(work, schema)


def _visit(index: VectorIndex, wanted: DataFrame, k: int) -> DataFrame:
    """The k best of the wanted cells (query_id, q, cell), those cells' folders alone."""
    cells = index.cells
    centred = cells.filter("centre is not null").select(F.size("centre").alias("n")).first()
    named = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # cells, not vectors
    there = index.vectors.filter(F.col("cell").isin(named)).withColumn("cell", F.col("cell").cast("long"))
    return grid_topk(there.select("id", "embedding", "cell"), wanted.select("query_id", "q", "cell"), k, centred["n"] if centred else 1, ["cell"])


def kept(df: DataFrame) -> DataFrame:
    """What later steps read more than once, computed once and written to the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (query_id, cell, n) that were read): exact top-k by cosine. Jobs run while this is called.

    First each query's nearest cells that hold k vectors are read; the k-th score is a bound on how far others may be, and
    then the cells whose rings come that near are. Queries that repeat an id are one query's: give ids of their own.
    """
    ways = bounds(index, queries)
    home = F.col("place") < k
    first = kept(best(_visit(index, kept(ways.filter(home)), k), k).drop("rank"))
    # cosine s on the unit sphere is a distance of sqrt(2 - 2 s)
    least = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_s"))
    reach = F.when(F.col("_n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("_s") - SLACK))) + SLACK)
    more = kept(ways.filter(~home).join(least, "query_id", "left").filter(F.coalesce(F.col("bound") <= reach, F.lit(True))))
    second = _visit(index, more, k)
    read = ways.filter(home).select("query_id", "cell", "n").unionByName(more.select("query_id", "cell", "n"))
    return best(first.unionByName(second), k), read


def share_read(index: VectorIndex, read: DataFrame, queries: DataFrame) -> float:
    """Share of all (query, vector) pairs whose vector's cell was read."""
    n, asked = index.cells.agg(F.sum("n")).first()[0] or 0, queries.count()
    return (read.agg(F.sum("n")).first()[0] or 0) / max(1, n * asked)
