"""SetSketch registers, their likelihood, and near-duplicate classes against all pairs of sets."""

import random

import duckdb
import numpy as np
import pytest

from folioforge.llm import op12_setsketch as ss
from folioforge.llm.op4_jaccard import shingle_sets


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)] if len(w) == 1 else zip(w, w[1:], strict=False)))
    return out


def by_hand(rows):
    """(doc_id, size, component, kept) by comparing all pairs."""
    sets = sets_of([t for _, t in rows])
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)], None if d is None else d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def changed(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def families():
    """Chains, stars whose arms aren't linked, pairs just above and below the threshold, copies in other case."""
    rng, rows = random.Random(3), []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 40, 200]))]
        text = " ".join(words)
        rows += [text, text.upper(), text.replace(" ", "\n\t"), text + " tail"]
        chain = words
        for _ in range(6):
            chain = changed(chain, max(1, len(words) // 25), rng)
            rows.append(" ".join(chain))
        rows += [" ".join(changed(words, max(1, len(words) // 20), rng)) for _ in range(8)]
        rows += [" ".join(changed(words, max(1, len(words) // 9), rng)) for _ in range(6)]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 6000, np.uint64)
    for a, b in (((0, 3000), (300, 3000)), ((0, 3000), (0, 2500)), ((0, 3000), (3000, 6000)), ((0, 50), (5, 55)), ((0, 6000), (0, 6000))):
        x, y = np.sort(pool[slice(*a)]), np.sort(pool[slice(*b)])
        regs = ss.registers(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).astype(int)
        union = np.sort(np.union1d(x, y))
        assert (ss.merge_registers(*regs) == ss.registers(union, np.array([0, len(union)]))[0]).all()
        larger, smaller = [(regs[0] > regs[1]).sum()], [(regs[0] < regs[1]).sum()]
        j, true = ss.estimated_similarity(larger, smaller, [len(x)], [len(y)])[0], len(np.intersect1d(x, y)) / len(union)
        assert abs(j - true) < 5 * 0.5 / ss.REGISTERS**0.5
        for at in (0.1, 0.5, 0.7):
            if abs(at - j) > 0.01 and at < min(len(x), len(y)) / max(len(x), len(y)):
                assert bool(ss.may_reach(at, np.array(larger), np.array(smaller), float(len(x)), np.array([float(len(y))]))[0]) == (j >= at)
    assert (1 - (1 - ss.equal_registers(0.8) ** ss.ROWS) ** ss.BANDS) >= ss.RECALL
    assert ss.registers(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * ss.REGISTERS]


def test_registers_have_the_stated_chance():
    rng = np.random.default_rng(2)
    equal = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 1000, np.uint64)
        x, y = np.sort(pool[:900]), np.sort(pool[100:])
        regs = ss.registers(np.concatenate([x, y]), np.array([0, 900, 1800]))
        equal.append((regs[0] == regs[1]).mean())
    assert abs(np.mean(equal) - ss.equal_registers(0.8)) < 0.015


@pytest.mark.parametrize("block", [4096, 40])
def test_families(spark, families, monkeypatch, block):
    """Blocks of 40 members cut every larger family, so hubs and the rest of the blocks are met."""
    monkeypatch.setattr(ss, "BLOCK", block)
    monkeypatch.setattr(ss, "HUBS", 2)
    rows = families
    if block == 40:  # one family of over a hundred, whose arms hang on a few texts
        rng = random.Random(9)
        words = [f"q{i}" for i in range(120)]
        arms = [" ".join(changed(words, 9, rng)) for _ in range(130)]
        second = arms[7].split()
        arms += [" ".join(changed(second, 9, rng)) for _ in range(30)] + [" ".join(words)] + [" ".join(changed(words, 14, rng)) for _ in range(20)]
        rows = families[:60] + [(1000 + i, t) for i, t in enumerate(arms)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(ss.near_duplicates(df)) == by_hand(rows)


def test_blocks_find_what_one_task_finds():
    """Any cut into blocks, with or without known parts, connects the same members."""
    rng = random.Random(4)
    words = [f"q{i}" for i in range(60)]
    texts = [" ".join(changed(words, rng.randrange(1, 9), rng)) for _ in range(60)]
    hashes, bounds = shingle_sets([t.encode().split() for t in texts], 2)
    sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    regs = [r.tobytes() for r in ss.registers(hashes, bounds).astype(">u2")]
    group = ss.Group(list(range(60)), regs, sets, 80)

    def parts(edges):
        label = list(range(60))
        for x, y in edges:
            a, b = label[x], label[y]
            label = [min(a, b) if v in (a, b) else v for v in label]
        return label

    whole = parts(group.connect(list(range(60))))
    first = group.connect(list(range(60)), np.arange(20))
    assert parts(first + group.connect(parts(first), np.arange(20, 60))) == whole
    assert [sum(r[2] == d for r in by_hand(list(enumerate(texts)))) for d in sorted(set(whole))] == [whole.count(d) for d in sorted(set(whole))]


def test_odd_rows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(ss.near_duplicates(docs)) == by_hand(rows)


def test_empty(empty):
    got = ss.near_duplicates(empty)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_query(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted((tuple(r) for r in con.sql(ss.ORACLES["op12_setsketch"]).select("doc_id, n_shingles, component_id, kept").fetchall()), key=str)
    assert found(ss.op12_setsketch(spark, data)) == want
