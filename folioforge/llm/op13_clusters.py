"""Centroid clustering by exact Lloyd rounds: distances as |x|^2 - 2 x.c + |c|^2 in blocked float64 products.

Vectors become whole numbers, so a product in float64 is exact while all it adds up stays below 2**53; the bound is
checked for every block of vectors, and a block beyond it is computed in int64, or in Python integers beyond that.
Assignments, sums and centroids are therefore exact, and the same however the rows are dealt. A round is one pass:
RDD.treeAggregate combines counts and sums of k clusters in the executors; only k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import EXACT, whole_vectors

SCALE, DIMS, CLUSTERS, ROUNDS = 256, 64, 40, 5
#: Vectors of a block, and so the rows of a product.
BLOCK = 2048


def largest(x) -> int:
    return max(int(abs(x).max()), 0) if x.size else 0


def squared_distances(x, c):
    """Exact squared distances of rows of x to rows of c, both whole: float64 under the bound, else int64, else Python integers."""
    import numpy as np

    # all terms of the expansion and their partial sums are at most this
    bound = x.shape[1] * (largest(x) + largest(c)) ** 2
    kind = np.float64 if bound < EXACT else np.int64 if bound < 1 << 63 else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x, c) -> tuple:
    """(cluster, squared distance) of each row; of equal distances the smaller number."""
    import numpy as np

    far = squared_distances(x, c)
    at = far.argmin(axis=1) if far.dtype != object else np.array([min(range(len(c)), key=r.__getitem__) for r in far])
    return at, far[np.arange(len(x)), at]


def sums_by_cluster(x, at, k: int):
    """Exact sums of the rows of each cluster, Python integers: a product with the clusters' indicators under the bound, else int64 or integers."""
    import numpy as np

    bound = len(x) * max(1, largest(x))
    if bound < EXACT:
        return (np.eye(k)[at].T @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), np.int64 if bound < 1 << 63 else object)
    np.add.at(out, at, x)
    return out.astype(object)


def blocks(vectors: DataFrame, dims: int, scale: int):
    """RDD of whole matrices, a block of vectors each."""
    import numpy as np

    def work(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        for _, x in whole_vectors(batches, dims, scale, rows=BLOCK):
            if x.dtype != object and largest(x) < 1 << 31:
                x = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x)], pa.large_binary())], names=["block"])

    def opened(row):
        import pickle

        x = pickle.loads(row[0])
        return x if x.dtype == object else x.astype(np.int64)

    return vectors.mapInArrow(work, "block binary").rdd.map(opened)


def assigned_sums(data, centroids):
    """(counts, sums, sums of distances) by cluster, exact, of one pass over the blocks."""
    import numpy as np

    k, dims = centroids.shape
    zero = (np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object))

    def add(total, x):
        at, far = nearest(x, centroids)
        counts = np.bincount(at, minlength=k).astype(object)
        spread = np.zeros(k, object)
        for c in np.flatnonzero(counts):
            mine = far[at == c]
            spread[c] = sum(map(int, mine))
        return total[0] + counts, total[1] + sums_by_cluster(x, at, k), total[2] + spread

    return data.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


class Clusters:
    """What cluster() has found: centroids (whole numbers), and by cluster the counts and sums of squared distances."""

    def __init__(self, centroids, counts: list[int], inertia: list[int]):
        self.centroids, self.counts, self.inertia = centroids, counts, inertia
        self.digests = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: str):
    """The k usable vectors of smallest hash of their id, rows without id last; ties go to the smaller vector."""
    import numpy as np

    usable = vectors.filter((F.size("v") == dims) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    rows = usable.select("id", "v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("id", "v").toArrow()
    found = [x for _, x in whole_vectors(iter(rows.to_batches()), dims, scale)]
    if not found:
        return np.zeros((0, dims), np.int64)
    wide = any(x.dtype == object for x in found)
    return np.concatenate([x.astype(object) if wide else x for x in found])


def moved(centroids, counts, sums):
    """Componentwise floor(sum / count) of each cluster that isn't empty."""
    import numpy as np

    new = [[int(s) // int(n) for s in row] if n else list(map(int, c)) for c, n, row in zip(centroids, counts, sums, strict=True)]
    wide = max((abs(v) for c in new for v in c), default=0) >= 1 << 62
    return np.array(new, object if wide else np.int64)


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2:", column: str = "embedding", key: str = "vec_id") -> Clusters | None:
    """Clusters of all usable vectors (see assign()); None without any. Fewer than k vectors give as many clusters. A pass a round and one for the final sums; k * dims numbers come to the driver."""
    vectors = embeddings.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    centroids = first_centroids(vectors, k, dims, scale, seed)
    if not len(centroids):
        return None
    data = blocks(vectors, dims, scale)
    for _ in range(rounds):
        counts, sums, _ = assigned_sums(data, centroids)
        centroids = moved(centroids, counts, sums)
    counts, _, spread = assigned_sums(data, centroids)
    return Clusters(centroids, list(map(int, counts)), list(map(int, spread)))


def assign(embeddings: DataFrame, found: Clusters | None, scale: int = SCALE, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a usable vector.

    Usable are vectors of exactly the centroids' length without null or non-finite components; all others, empty and
    null ones fall away. Rows without id and rows that repeat an id count like any other (as first centroids they come
    last, and by their vector); other columns are ignored; an empty table gives no rows. Distances and inertias are
    exact, and null where 63 bits don't hold them.
    """
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return embeddings.sparkSession.createDataFrame([], kind)
    fits = lambda v: v if v < 1 << 63 else None
    spread, whole = [fits(v) for v in found.inertia], fits(sum(found.inertia))
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, x in whole_vectors(batches, found.centroids.shape[1], scale, rows=BLOCK):
            at, far = nearest(x, found.centroids)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, take, pa.array([fits(int(v)) for v in far], pa.int64()), pa.array(spread, pa.int64()).take(take), pa.array([whole] * len(at), pa.int64()), pa.array(found.digests).take(take)],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(work, kind)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components."""
    vectors = table(spark, sf_dir, "embeddings")
    return assign(vectors, cluster(vectors))


def oracle() -> str:
    """The same clusters in SQL, a pair of steps for each round: assign, then move."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = f"SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{{{'d': {far}, 'k': c.k}}}}) AS best FROM v, c{{n}} c GROUP BY v.r"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS}))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED ({assign.format(n=n)})")
        if n < ROUNDS:
            sums = f"SELECT k, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(x) AS y, unnest(range(1, {DIMS + 1})) AS i FROM a{n}) GROUP BY k, i"
            moved = f"SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM ({sums}) GROUP BY k"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN ({moved}) m ON m.k = c.k)")
    last = f"SELECT a.vec_id, a.best.k::INT AS cluster, a.best.d::BIGINT AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.k))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.best.k"
    return f"WITH {', '.join(steps)} {last}"


QUERIES = {"op13_clusters": op13_clusters}
ORACLES: dict[str, str] = {"op13_clusters": oracle()}
