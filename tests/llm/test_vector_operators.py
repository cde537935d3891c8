"""Whitening and clusters against exact rational arithmetic and plain loops."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from folioforge.llm import op11_whitening as w
from folioforge.llm import op13_clusters as km
from folioforge.llm.vectors import whole_vectors

KIND = "vec_id long, embedding array<float>, n string, component int, v int, id string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "n", 1, 2, "x") for i, v in rows], KIND).repartition(parts)


def vectors(n: int, dims: int, seed: int = 5, offset: float = 0.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(dims, dims)) + 2 * np.eye(dims)
    return (r.normal(size=(n, dims)) @ mix / 4 + offset).astype(np.float32)


def whole(v, scale, shift=0):
    return [[math.floor(scale * float(c)) + shift for c in row] for row in v]


@pytest.mark.parametrize("dims", [1, 2, 3, 17, 64])
def test_symmetric_qr(dims):
    r = np.random.default_rng(dims)
    for a in (r.normal(size=(dims, dims)), np.zeros((dims, dims)), np.diag(np.arange(dims) * 1e6), np.ones((dims, dims))):
        a = a @ a.T
        values, rows = w.symmetric_qr(a)
        want = np.linalg.eigvalsh(a)[::-1]
        size = max(1.0, abs(want).max())
        assert abs(values - want).max() < 1e-12 * size
        assert abs(rows @ rows.T - np.eye(dims)).max() < 1e-12
        assert abs(rows @ a @ rows.T - np.diag(values)).max() < 1e-11 * size


def test_merging_states_equals_one_state():
    x = np.array(whole(vectors(3000, 8, offset=1e6), 64, 10**6), np.int64)
    parts = [w.welford(x[a:b]) for a, b in ((0, 1), (1, 700), (700, 3000))]
    n, sums, m2 = w.merged(w.merged(None, parts[2]), w.merged(parts[0], parts[1]))
    far = n * x.astype(object) - x.astype(object).sum(axis=0)
    exact = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in far.T @ far])
    assert (n, sums) == (3000, [int(s) for s in x.sum(axis=0)])
    assert abs(m2 - exact).max() < 1e-13 * abs(exact).max()


def whitening_by_hand(v, components):
    """Deviations and |whitened| from exact rational moments."""
    x = np.array(whole(v, 64, 10**6), object)
    n, far = len(x), None
    far = n * x - x.sum(axis=0)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in far.T @ far])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [int((r * r).sum()) for r in far], (far.astype(float) / n) @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening_against_exact_moments(spark):
    v = vectors(700, 12, offset=3.5)
    odd = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + odd + [(0, v[0].tolist()), (None, v[1].tolist())]
    df = table(spark, rows)
    model = w.fit(df, components=9)
    got = w.whiten(df, model).collect()
    full = np.concatenate([v, v[:2]])
    far, white, share = whitening_by_hand(full, 9)
    assert model.n == len(got) == 702 and model.identity_error < 1e-9
    assert np.allclose(np.array(model.values) / model.trace, share, rtol=1e-10)
    signs = None
    for r in sorted(got, key=lambda r: -1 if r["vec_id"] is None else r["vec_id"]):
        k = 1 if r["vec_id"] is None else r["vec_id"]
        signs = np.sign(np.array(r["whitened"]) * white[k]) if signs is None else signs
        assert r["deviation"] == far[k]
        assert np.allclose(np.array(r["whitened"]) * signs, white[k], rtol=0, atol=1e-9)


def test_whitening_without_spread_and_empty(spark):
    same = table(spark, [(i, [1.0, 2.0, float(i)]) for i in range(5)])
    got = w.whiten(same, w.fit(same)).collect()
    assert len(got) == 5 and all(len(r["whitened"]) == 3 and r["whitened"][1:] == [None, None] and r["whitened"][0] is not None for r in got)
    none = same.limit(0)
    assert w.fit(none) is None and w.whiten(none, None).count() == 0
    one = table(spark, [(1, [1e30, -1e30])])
    assert [(r["deviation"], r["whitened"]) for r in w.whiten(one, w.fit(one)).collect()] == [(0, [None, None])]


def test_query_whitening(spark, data):
    rows = w.op11_whitening(spark, data).collect()
    v = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()], np.float32)
    far, white, share = whitening_by_hand(v, 32)
    out = np.zeros_like(white)
    for r in rows:
        out[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == far[r["vec_id"]] and r["n"] == len(v) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-10)
    assert len(rows) == 32 * len(v)
    assert abs(abs(out) - abs(white)).max() < 1e-7
    assert abs(np.cov(out.T, bias=True) - np.eye(32)).max() < 1e-9


def test_products_are_exact_beyond_the_bound():
    for size in (100, 1 << 27, 1 << 40, 1 << 70):
        r = np.random.default_rng(size % 97)
        draw = lambda n: np.array([[int(v * size) for v in row] for row in r.uniform(-1, 1, (n, 5))], object if size > 1 << 61 else np.int64)
        x, c = draw(30), draw(7)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert [[int(v) for v in row] for row in km.squared_distances(x, c)] == want
        at, far = km.nearest(x, c)
        assert [(int(a), int(d)) for a, d in zip(at, far, strict=True)] == [(row.index(min(row)), min(row)) for row in want]
        sums = km.sums_by_cluster(x, np.asarray(at), 7)
        assert [list(map(int, s)) for s in sums] == [[sum(int(p[j]) for p, a in zip(x, at, strict=True) if a == k) for j in range(5)] for k in range(7)]


def clusters_by_hand(rows, k, rounds, dims):
    """(vec_id, cluster, distance, inertia of the cluster, inertia, digest) by plain loops."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z", x) for i, x in kept)
    cs = [x for _, x in first[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    place = lambda x: min((dist(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [place(x)[1] for _, x in kept]
        groups = [[x for (_, x), a in zip(kept, at, strict=True) if a == j] for j in range(len(cs))]
        cs = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    last = [(i, *place(x)) for i, x in kept]
    spread = [sum(d for _, d, a in last if a == j) for j in range(len(cs))]
    return sorted(((i, a, d, spread[a], sum(spread), hashlib.sha256(",".join(map(str, cs[a])).encode()).hexdigest()) for i, d, a in last), key=str)


def test_clusters_by_hand(spark):
    v = vectors(160, 6, 3).round(1)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(500, None), (501, []), (502, [1.0] * 5), (503, [None] * 6), (504, [float("inf")] * 6), (3, v[3].tolist()), (None, v[4].tolist()), (None, v[5].tolist())]
    rows += [(600 + i, [2.0] * 6) for i in range(20)]
    df = table(spark, rows)
    for k in (7, 40, 500):
        got = km.assign(df, km.cluster(df, k=k, rounds=3, dims=6)).collect()
        assert sorted((tuple(r) for r in got), key=str) == clusters_by_hand(rows, k, 3, 6)


def test_clusters_of_huge_and_no_vectors(spark):
    rows = [(i, [1e15 * i, -3e15, 1e38 if i == 4 else 0.5]) for i in range(6)]
    df = table(spark, rows)
    got = km.assign(df, km.cluster(df, k=2, dims=3)).collect()
    want = clusters_by_hand(rows, 2, 5, 3)
    fits = lambda v: v if v < 1 << 63 else None
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, a, fits(d), fits(s), fits(t), h) for i, a, d, s, t, h in want), key=str)
    assert km.cluster(df.limit(0)) is None and km.assign(df.limit(0), None).count() == 0


def test_whole_vectors_keep_offsets_of_slices():
    import pyarrow as pa

    batch = pa.record_batch({"i": pa.array(range(5)), "v": pa.array([[1.0, 2.0], None, [3.0], [4.0, 5.0], [6.0, None]], pa.list_(pa.float32()))})
    found = [(ids.to_pylist(), x.tolist()) for ids, x in whole_vectors(iter([batch.slice(1)]), 2, 2, 1, rows=2)]
    assert found == [([3], [[9, 11]])]
