"""Near-duplicate classes by SetSketch registers: bands of registers, a joint likelihood estimate, then exact verification.

1. Every text becomes its set of shingles (SHINGLE words); texts of equal sets are one member, and only members go on.
2. A sketch has REGISTERS registers. Each is the least of exponential variates that the set's shingles draw, kept as its
   truncated logarithm to base BASE (so larger registers are smaller variates). Two sets' registers, taken one by one at
   their maximum, are the union's: sketches merge. Equal registers become likelier with similarity.
3. BANDS bands of ROWS registers each are hashed. Members that share a band meet; a band with many members is a star
   around its smallest id, so its rows grow with its members and not with their pairs. Connected stars are groups, and
   every pair that shares a band is inside one.
4. Inside a group, pairs are estimated first: from the numbers of larger, smaller and equal registers and both sets'
   sizes follows the similarity of largest likelihood. Pairs whose sizes and estimates allow the threshold are counted on
   the full sets, breadth first, so that a member is compared with those only that aren't connected to it yet.
5. A group of over BLOCK members or BLOCK_SHINGLES shingles is cut into blocks by hash. Each block is connected on its
   own, then with the members that most others hang on (HUBS a group). What then is outside of its group's largest part
   is compared with every block, block against block, until nothing is left to compare: no pair is skipped.
6. Connected components of the verified edges are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import given_back, materialise, slices, table, utf8, written
from .op4_jaccard import components, shingle_sets

SHINGLE, THRESHOLD_PERCENT, RECALL = 2, 80, 1 - 1e-6
BASE, RATE, LARGEST, ROWS = 1.02, 20.0, 0xFFFE, 5
#: Standard errors of an estimate by which it may miss the threshold before the pair isn't counted.
LOOSE_ERRORS = 5.0
BLOCK, BLOCK_SHINGLES, HUBS = 4096, 2_000_000, 64
MAX_ROUNDS = 60
#: Members of groups are broadcast to the texts only up to this number (some 60 bytes each).
BROADCAST_ROWS = 500_000


def differs(x: float) -> float:
    """Probability that a register of one of two sets is the larger one; x: the share of the union's elements that only that set has."""
    return -math.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def equal_registers(similarity: float) -> float:
    """Probability that a register is equal, at least, for two sets of that similarity, whatever their sizes."""
    apart = 1 - similarity
    return 1 - max(2 * differs(apart / 2), differs(apart))


def band_count(threshold: float = THRESHOLD_PERCENT / 100, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands that a pair at the threshold needs to share one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - equal_registers(threshold) ** rows))


BANDS = band_count()
REGISTERS = BANDS * ROWS


def registers(hashes, bounds):
    """uint16 registers, a row for each text, 0 for a text without shingles."""
    import numpy as np

    random = np.random.Generator(np.random.PCG64(5_2020_1108))
    a, b = random.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, REGISTERS, np.uint64)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), REGISTERS), np.uint16)
    if len(full):
        at = bounds[:-1][full]
        # the least exponential variate belongs to the least uniform one
        least = np.stack([np.minimum.reduceat(hashes * a[k] + b[k], at) for k in range(REGISTERS)], 1)
        uniform = ((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        k = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / math.log(BASE))
        out[full] = np.clip(k, 0, LARGEST)
    return out


def merge_registers(a, b):
    """The sketch of the union of two sets."""
    import numpy as np

    return np.maximum(a, b)


def likelihood(j, larger, smaller, n_a, n_b):
    """Logarithm of the likelihood of similarity j, given how many registers of a are larger and smaller than b's, and both sets' sizes; arrays of one length."""
    import numpy as np

    u = n_a / (n_a + n_b)
    v = 1 - u
    share = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)
    p, q = share(u - v * j), share(v - u * j)
    return larger * np.log(p) + smaller * np.log(q) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - p - q, 1e-12))


def estimated_similarity(larger, smaller, n_a, n_b):
    """The similarity of largest likelihood, between 0 and what both sizes allow; arguments as of likelihood()."""
    import numpy as np

    larger, smaller, n_a, n_b = (np.asarray(x, float) for x in (larger, smaller, n_a, n_b))
    high = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    low = np.zeros_like(high)
    for _ in range(40):  # the likelihood is concave in j
        third = (high - low) / 3
        left = likelihood(low + third, larger, smaller, n_a, n_b) < likelihood(high - third, larger, smaller, n_a, n_b)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def may_reach(similarity: float, larger, smaller, n_a, n_b):
    """Whether estimated_similarity() is that or more: the likelihood, which is concave, still rises there."""
    return likelihood(similarity, larger, smaller, n_a, n_b) >= likelihood(similarity - 1e-4, larger, smaller, n_a, n_b)


def loose(threshold: float = THRESHOLD_PERCENT / 100) -> float:
    """Estimated similarity from which a pair is counted exactly."""
    return threshold - LOOSE_ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, h, size, k1, k2, registers): hash of the text, size and 128-bit key of the shingle set, its sketch."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .wordhash import mix

        for batch in slices(batches, 300):
            hashes, bounds = shingle_sets([x.lower().split() for x in utf8(batch, "text")], k)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            k1, k2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(full):
                k1[full] = np.add.reduceat(mix(hashes), bounds[:-1][full])
                k2[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(0x632BE59BD9B4E019)), bounds[:-1][full])
            rows = registers(hashes, bounds).astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["doc_id", "h", "size", "k1", "k2", "registers"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, h long, size long, k1 long, k2 long, registers binary")


def meetings(members: DataFrame) -> DataFrame:
    """(a, b): edges from each member to the smallest id in each of its bands, distinct; what shares a band is connected."""

    def banded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .wordhash import mix

        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in slices(batches, 2000):
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(salt, regs.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + regs[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "id"])

    rows = members.select("id", "registers").mapInArrow(banded, "band long, id long")
    least = rows.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    return rows.join(least, "band").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


class Group:
    """Some members of a group in one task: their ids, registers, sorted shingle hashes; edges are found by connect()."""

    def __init__(self, ids, regs, sets, percent: int):
        import numpy as np

        self.ids, self.percent = ids, percent
        self.regs = np.frombuffer(b"".join(regs), ">u2").reshape(len(ids), -1).astype(np.int32)
        self.sizes = np.array([len(s) // 8 for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = np.frombuffer(b"".join(sets), np.uint64)
        self.distinct, code = np.unique(flat, return_inverse=True)
        self.code = code.astype(np.int32)

    def similar(self, x: int, others):
        """Which of others (places) reach the threshold with x on their full sets; only pairs that sizes and sketches allow are counted."""
        import numpy as np

        n, m = self.sizes[x], self.sizes[others]
        near = np.flatnonzero((100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)))
        if len(near):
            diff = self.regs[others[near]] - self.regs[x]
            near = near[may_reach(loose(self.percent / 100), (diff < 0).sum(axis=1), (diff > 0).sum(axis=1), float(n), m[near].astype(float))]
        if not len(near):
            return others[:0]
        mine = np.zeros(len(self.distinct), bool)
        mine[self.code[self.ends[x] - n : self.ends[x]]] = True
        found = []
        for y in others[near].tolist():
            both = int(np.count_nonzero(mine[self.code[self.ends[y] - self.sizes[y] : self.ends[y]]]))
            if 100 * both >= self.percent * (int(n) + int(self.sizes[y]) - both):
                found.append(y)
        return np.array(found, np.int64)

    def connect(self, parts, fronts=None) -> list[tuple[int, int]]:
        """Edges (place, place) that connect whatever links connect; parts: what is connected already, a label a place. fronts: the only places to compare with others, all by default.

        Breadth first over parts: a place is compared with those only that are in no part reached so far.
        """
        import numpy as np

        parts, edges = np.asarray(parts), []
        by_part: dict = {}
        for place, label in enumerate(parts.tolist()):
            by_part.setdefault(label, []).append(place)
        allowed = None if fronts is None else np.zeros(len(parts), bool)
        if fronts is not None:
            allowed[fronts] = True
        unreached = np.ones(len(parts), bool)
        for first in range(len(parts)):
            if not unreached[first]:
                continue
            todo = list(by_part[parts[first]])
            unreached[todo] = False
            while todo:
                x = todo.pop()
                others = np.flatnonzero(unreached)
                if allowed is not None and not allowed[x]:
                    others = others[allowed[others]]
                if not len(others):
                    if allowed is None:
                        break
                    continue
                for y in self.similar(x, others).tolist():
                    if unreached[y]:
                        edges.append((x, y))
                        more = by_part[parts[y]]
                        unreached[more] = False
                        todo += more
        return edges


def with_sets(docs: DataFrame, placed: DataFrame, k: int = SHINGLE) -> DataFrame:
    """placed (doc_id, h, and other columns) with ``registers`` and ``shingles``, the sketch and the sorted hashes of the text that has this id and hash; one row a row of docs that does."""
    few = placed.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    others = [c for c in placed.columns if c not in ("doc_id", "h")]

    def shingled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 300):
            hashes, bounds = shingle_sets([x.lower().split() for x in utf8(batch, "text")], k)
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            regs = [r.tobytes() for r in registers(hashes, bounds).astype(">u2")]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], names=[*others, "registers", "shingles"])

    kind = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes if c in others)
    return rows.join(F.broadcast(placed) if few else placed, ["doc_id", "h"]).select("text", *others).mapInArrow(shingled, f"{kind}, registers binary, shingles binary")


def compared(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(a, b) edges, one task a key, of rows (key, id, part, front, registers, shingles): members of one part are connected already, and pairs without a front are compared elsewhere."""

    def compare(rows):
        import numpy as np
        import pyarrow as pa

        seen = {}
        for i, part, front, regs, s in zip(*(rows.column(c).to_pylist() for c in ("id", "part", "front", "registers", "shingles")), strict=True):
            seen[i] = (part, front or seen.get(i, (0, False))[1], regs, s)  # rows that repeat an id and its text are one member
        ids = sorted(seen)
        group = Group(ids, [seen[i][2] for i in ids], [seen[i][3] for i in ids], percent)
        fronts = np.array([seen[i][1] for i in ids])
        edges = group.connect([seen[i][0] for i in ids], None if fronts.all() else np.flatnonzero(fronts))
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], pa.int64()), "b": pa.array([ids[y] for _, y in edges], pa.int64())})

    return rows.select(*key, "id", "part", "front", "registers", "shingles").groupBy(*key).applyInArrow(compare, "a long, b long")


def verified_edges(docs: DataFrame, members: DataFrame, groups: DataFrame, percent: int = THRESHOLD_PERCENT, k: int = SHINGLE) -> DataFrame:
    """(a, b): edges of pairs that reach the threshold, enough to connect all that such pairs connect inside groups (id, root) of members (id, doc_id, h, size)."""
    held = groups.join(members, "id")
    sizes = held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = held.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = materialise(placed.select("id", "doc_id", "h", "root", "blocks", "block"))
    alone = placed.select("id", "doc_id", "h", "root", "block", F.col("id").alias("part"), F.lit(True).alias("front"))
    edges = materialise(compared(with_sets(docs, alone, k), ["root", "block"], percent))
    if not (large := placed.filter("blocks > 1")).limit(1).count():
        return edges
    for hubs in (True, False):
        edges = edges.unionByName(materialise(compared(with_sets(docs, across(large, edges, hubs), k), ["root", "block", "other"], percent)))
    return edges


def across(large: DataFrame, edges: DataFrame, hubs: bool) -> DataFrame:
    """Rows for compared() that find what connects blocks of a group, given the edges so far.

    hubs: the HUBS members of a group with most edges meet every block. Else every block of the members outside of the
    group's largest part meets every block of the group; groups of one part are done.
    """
    parts = large.join(components(edges).withColumnRenamed("root", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    columns = ["id", "doc_id", "h", "root", "blocks", "block", "part"]
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if hubs:
        degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
        ranked = parts.join(degree, "id").withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("count"), "id")))
        chosen = ranked.filter(F.col("_n") <= HUBS).select(*columns).withColumn("block", each).withColumn("front", F.lit(True))
        others = parts.select(*columns).withColumn("front", F.lit(False))
        rows = chosen.unionByName(others).withColumn("other", F.lit(-1))
    else:
        most = parts.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
        left = parts.join(most.filter("parts > 1"), "root").withColumn("front", F.col("part") != F.col("main"))
        fronts = left.filter("front").select("root", F.col("block").alias("mine")).distinct()
        # (block, other): fronts of one block against all of another; a block's own pairs are known
        sent = left.filter("front").select(*columns, "front").withColumn("other", each).withColumn("mine", F.col("block"))
        met = left.select(*columns, "front").join(fronts, "root").withColumn("other", F.col("block"))
        rows = sent.unionByName(met).filter("mine <> other").withColumn("front", F.col("front") & (F.col("block") == F.col("mine")))
        rows = rows.withColumn("block", F.col("mine"))
    return materialise(rows.select("id", "doc_id", "h", "root", "block", F.col("other").cast("int").alias("other"), "part", "front"))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs; kept: doc_id = component_id.

    component_id: the smallest doc_id that chains of links reach, itself included. Texts are linked if their shingle
    sets' similarity is percent or more, so equal sets are. Null and empty texts and those without words have no
    shingles and are classes of their own by id. Rows without id are linked to nothing and have component and kept
    null. Rows that repeat an id are judged each by its own text: such rows may have different components. Other
    columns are ignored; an empty table gives no rows. Jobs run while this is called.
    """
    known = materialise(sketches(docs, k))
    filled = known.filter("size > 0 and doc_id is not null")
    keyed = filled.groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "h", "size", "registers"), F.struct("doc_id", "h")).alias("s"))
    members = materialise(keyed.select("k1", "k2", "s.*").withColumn("id", F.monotonically_increasing_id()))
    groups = components(meetings(members), MAX_ROUNDS)
    found = components(verified_edges(docs, members.select("id", "doc_id", "h", "size"), groups, percent, k), MAX_ROUNDS)
    named = found.join(members.select("id", "doc_id", "k1", "k2"), "id")
    class_of = named.groupBy("root").agg(F.min("doc_id").alias("component_id")).join(named.select("root", "k1", "k2"), "root").select("k1", "k2", "component_id")
    own = members.select("k1", "k2", F.col("doc_id").alias("least")).join(class_of, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("component_id", "least").alias("component_id"))
    linked = filled.select("doc_id", "size", "k1", "k2").join(own, ["k1", "k2"]).select("doc_id", "size", "component_id")
    alone = known.filter("not (size > 0 and doc_id is not null)").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents")
    with given_back(spark) as last:
        out, folder = written(near_duplicates(docs))
        last.append(folder)
    return out


QUERIES = {"op12_setsketch": op12_setsketch}
ORACLES: dict[str, str] = {
    "op12_setsketch": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS g FROM d),
m AS (SELECT md5(array_to_string(g, chr(0))) AS k, any_value(g) AS g, min(doc_id) AS rep FROM s WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY 1),
x AS (SELECT k, len(g) AS size, unnest(g) AS h FROM m), c AS (SELECT a.k AS a, b.k AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS both_ FROM x a JOIN x b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c WHERE 100 * both_ >= 80 * (sa + sb - both_)),
reach AS (SELECT k AS a, k AS b FROM m UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
class AS (SELECT reach.a AS k, min(m.rep) AS class_id FROM reach JOIN m ON m.k = reach.b GROUP BY reach.a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NULL THEN NULL WHEN len(s.g) = 0 THEN s.doc_id ELSE class.class_id END AS component_id FROM s LEFT JOIN class ON class.k = md5(array_to_string(s.g, chr(0))))"""
}
