"""Top-k by grid and by index against a plain scan."""

import math

import numpy as np
import pytest

from folioforge.operators import vector_index as vi


def plain(vectors, queries, k):
    """{query: [(id, score)]} by loops; vectors without a direction score 0."""

    def unit(v, dims):
        if v is None or len(v) != dims or any(c is None for c in v):
            return None
        n = math.sqrt(sum(c * c for c in v)) if all(map(math.isfinite, v)) else 0
        return [c / n for c in v] if n and math.isfinite(n) else None

    dims = max((len(v) for _, v in vectors if v), key=lambda n: (sum(1 for _, v in vectors if v and len(v) == n), n))
    rows = [(i, unit(v, dims)) for i, v in vectors]
    out = {}
    for i, q in queries:
        q = unit(q, dims)
        scored = [(-(round(sum(a * b for a, b in zip(q, v, strict=True)), 6) if q and v else 0.0) + 0.0, j) for j, v in rows]
        out[i] = [(j, -s + 0.0) for s, j in sorted(scored)[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def same(found, want):
    assert found.keys() == want.keys()
    for q, rows in want.items():
        assert [j for j, _ in found[q]] == [j for j, _ in rows]
        assert np.allclose([s for _, s in found[q]], [s for _, s in rows], atol=1.5e-6)


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 8))
    v = [(i, (centres[i % 12] + r.normal(size=8) * 0.1).round(3).tolist()) for i in range(600)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0] * 3), (1005, [None] * 8)]
    return v + odd + [(1006, v[5][1]), (1007, v[5][1])]


@pytest.fixture(scope="module")
def asked(clustered):
    return [(i, v) for i, v in clustered if i % 20 == 0 and i < 1000] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 8), (2003, [-x for x in clustered[0][1]])]


def frames(spark, vectors, queries):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4), spark.createDataFrame(queries, "query_id long, q array<double>").repartition(3)


@pytest.mark.parametrize("shard", [vi.SHARD, 50])
def test_grid(spark, clustered, asked, monkeypatch, shard):
    monkeypatch.setattr(vi, "SHARD", shard)
    monkeypatch.setattr(vi, "QUERY_SHARD", 7 if shard == 50 else vi.QUERY_SHARD)
    v, q = frames(spark, clustered, asked)
    same(got(vi.multi_query_topk(v, q, 7)), plain(clustered, asked, 7))
    both = v.withColumn("side", F_mod())
    by = vi.multi_query_topk(both, q, 4, "vec_id", "side")
    for side in (0, 1):
        same(got(by.filter(f"side = {side}")), plain([x for x in clustered if x[0] % 2 == side], asked, 4))
    assert vi.multi_query_topk(v.limit(0), q, 3).count() == 0 and vi.multi_query_topk(v, q.limit(0), 3).count() == 0


def F_mod():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 2


def test_index_is_exact_and_skips_cells(spark, clustered, asked, tmp_path):
    v, q = frames(spark, clustered, asked)
    index = vi.build_index(v, str(tmp_path / "index"), cells=12)
    for k in (1, 10, 700):
        found, read = vi.search(index, q, k)
        same(got(found), plain(clustered, asked, k))
    near = q.filter("query_id < 1000")
    found, read = vi.search(index, near, 10)
    assert vi.share_read(index, read, near) < 0.3
    assert found.count() == 10 * near.count()
    assert sum(r["n"] for r in index.cells.collect()) == len(clustered)


def test_index_without_vectors(spark, tmp_path):
    v, q = frames(spark, [(1, None), (2, [0.0, 0.0])], [(1, [1.0, 0.0])])
    index = vi.build_index(v, str(tmp_path / "index"), cells=3)
    assert got(vi.search(index, q, 5)[0]) == {1: [(1, 0.0), (2, 0.0)]}


def test_blocks_of_a_shard_give_one_ranking(spark, monkeypatch):
    """Blocks smaller than a shard: equal scores go to the smaller id across blocks, and no product holds a whole shard."""
    import numpy as np

    monkeypatch.setattr(vi, "BLOCK", 7)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-1, 2, 4)]) for i in rng.permutation(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q")
    got = {}
    for r in sorted(vi.multi_query_topk(v, q, 9).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    unit = {i: np.array(e) / (np.linalg.norm(e) or 1) for i, e in rows}
    for i in range(0, 150, 10):
        every = sorted(((-(round(float(unit[i] @ unit[j]), 6) + 0.0), j) for j in unit))[:9]
        assert got[i] == [(j, -s + 0.0) for s, j in every]


def test_pieces_keep_rows_and_their_order():
    import pyarrow as pa

    from folioforge.functions.batches import pieces

    batch = pa.record_batch({"a": list(range(1000)), "t": ["x" * 100] * 1000})
    got = list(pieces([batch, batch.slice(0, 0)], 300, 20_000))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1000)) and max(b.num_rows for b in got) < 200 and len(got[-1]) == 0


def test_bounds_of_many_queries_come_in_small_batches(spark, tmp_path):
    """A batch of queries times cells is never made at once; the index gives what a full scan gives."""
    v = spark.range(3000).selectExpr("id as vec_id", "transform(sequence(0, 7), k -> cast(sin(id * (k + 1)) as float)) as embedding")
    q = v.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as q")
    index = vi.build_index(v, str(tmp_path / "i"), 12)
    found = vi.search(index, q, 3)[0].select("query_id", "id", "rank").collect()
    assert sorted(found) == sorted(vi.multi_query_topk(v, q, 3).select("query_id", "id", "rank").collect()) and len(found) == 1800


def test_vectors_are_computed_few_times(spark, tmp_path, data):
    """However many passes fitting takes: once each for the length, the sample and the cells. Documents' vectors are stored, so their texts are hashed once."""
    from folioforge.plans import index_queries

    seen, n = spark.sparkContext.accumulator(0), 400

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").mapInArrow(count, "vec_id long, embedding array<double>")
    vi.build_index(v, str(tmp_path / "index"), 6)
    assert n <= seen.value <= 3 * n
    plan = index_queries.document_vectors(spark, data)[0]._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "MapInArrow" not in plan
