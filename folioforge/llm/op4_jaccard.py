"""Near-duplicate join: a MinHash LSH forest over word shingles, then exact verification.

1. Every text becomes a set of shingles (SHINGLE words). Texts with equal sets form one member; only members go on.
2. The forest has TREES tries of DEPTH MinHash labels. A trie is its sorted label paths, range-partitioned: what shares a
   prefix is a run. Matching starts with the longest prefix. Members of a run are compared by sketch and joined loosely,
   which gives candidate groups; runs of over NODE members are dealt as pairs of blocks.
3. Candidate groups are verified exactly from shingle sets: all pairs inside a group, block against block, counted
   where they are, so pairs never become rows. Links, and one spanning edge for each connected pair of parts, come out,
   with a histogram of the links' similarities.
4. From the histogram follows how many links the prefix has missed (a pair of similarity s meets with probability
   1 - (1 - s^depth)^TREES, so each link found stands for the inverse of that). While the recall measured so is under
   RECALL the prefix is shortened to the longest one that should reach it, and 2 and 3 run again; prefix_depth() is the
   shortest ever needed, whatever the similarities. What the sketches say of the longest prefix's pairs chooses the
   first prefix that is verified in the same way, so that one verification is mostly enough.
5. Connected components over the verified edges are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, utf8

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.9999
#: Bytes of a label in a path.
LABEL = 2
#: Bytes of a sketch (one byte a hash), and the estimated similarity under which a pair isn't a candidate:
#: six standard errors of a 64-hash estimate below the threshold at most.
SKETCH, LOOSE = 64, 0.55
#: Members of a run that are compared at once; longer runs are cut into blocks of half as many.
NODE = 4096
#: Members that are verified against each other at once, and shingles of theirs (a single text may have more).
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Ids, and long runs or hubs, are broadcast only up to this number of rows.
BROADCAST_ROWS = 1_000_000
#: Edges of a node from which its least neighbour is broadcast instead of shuffled to one task.
HUB = 128


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold itself meets in some tree with probability recall."""
    while depth > 1 and meeting(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def expected_recall(links: dict[float, float], depth: int) -> float:
    """Share of links that meet at a depth; links: number by similarity, of all there are."""
    return sum(n * meeting(s, depth) for s, n in links.items()) / sum(links.values())


def next_depth(found: dict[float, int], depth: int) -> int:
    """The prefix to match after ``depth``: the same one if the recall measured from the links found reaches RECALL, else the longest shorter one that should.

    A prefix without any link has measured nothing; prefix_depth() follows it.
    """
    least = min(depth, prefix_depth())
    if not found:
        return least
    there = {s: n / meeting(s, depth) for s, n in found.items()}
    return next((d for d in range(depth, least, -1) if expected_recall(there, d) >= RECALL), least)


def shingle_sets(texts: list[list[bytes]], k: int = SHINGLE):
    """(hashes, first of each text): sorted distinct shingle hashes, text by text. A text shorter than k words is one shingle; one without words has none."""
    import numpy as np

    from .wordhash import Words, grams, run_hashes

    words = Words(texts, 1)
    counts, starts = words.counts, words.starts
    gram = grams(words.hashes[0], k)
    doc = words.doc_of()
    inner = np.flatnonzero(doc[: len(gram)] == doc[k - 1 :][: len(gram)]) if len(gram) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    of = np.concatenate([doc[inner], short])
    hashes = np.concatenate([gram[inner], run_hashes(words.hashes[0], starts[short], starts[short] + counts[short] - 1)]) if words.n else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[new], hashes[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def _multipliers(n: int):
    import numpy as np

    random = np.random.Generator(np.random.PCG64(20240229))
    return random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, size, k1, k2, paths, sketch): hash of the text, size and 128-bit key of the shingle set, label paths of all trees end to end, sketch."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .wordhash import mix

        a, b = _multipliers(max(TREES * DEPTH, SKETCH))
        for batch in slices(batches, 300):
            raw = utf8(batch, "text")
            hashes, bounds = shingle_sets([x.split() for x in raw])
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            least = np.full((len(a), len(raw)), np.iinfo(np.uint64).max, np.uint64)
            k1, k2 = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
            if len(full):
                at = bounds[:-1][full]
                for k in range(len(a)):
                    least[k, full] = np.minimum.reduceat(hashes * a[k] + b[k], at)
                k1[full] = np.add.reduceat(mix(hashes), at)
                k2[full] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(0x632BE59BD9B4E019)), at)
            paths = np.ascontiguousarray(mix(least[: TREES * DEPTH]).astype(">u2").T)
            sketch = np.ascontiguousarray(((least[:SKETCH] >> np.uint64(56)).astype(np.uint8) ^ (least[:SKETCH] >> np.uint64(20)).astype(np.uint8)).T)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (paths, sketch))],
                names=["doc_id", "h", "size", "k1", "k2", "paths", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, h long, size int, k1 long, k2 long, paths binary, sketch binary")


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def similar_neighbours(sketches, ids) -> list[tuple[int, int, int]]:
    """Edges (id, id, equal bytes) that connect what estimated similarity LOOSE connects: breadth first, so a member is compared with unvisited ones only."""
    import numpy as np

    todo = np.arange(len(ids))
    # equal bytes also come by chance, once in 256
    needed = int(SKETCH * (LOOSE + (1 - LOOSE) / 256))
    edges = []
    while len(todo) > 1:
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            x = front.pop()
            equal = (sketches[todo] == sketches[x]).sum(axis=1)
            near = equal >= needed
            found = todo[near]
            todo = todo[~near]
            edges += [(int(ids[x]), int(ids[y]), int(n)) for y, n in zip(found, equal[near], strict=True)]
            front += found.tolist()
    return edges


def runs_of(forest: DataFrame, depth: int) -> DataFrame:
    """(tree, node, low, high, path, id, sketch): members by tree and prefix; a run of over NODE members as all pairs (low, high) of its blocks."""
    step = LABEL * DEPTH
    trees = forest.select("id", "sketch", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("id", "sketch", "tree", F.expr(f"substring(paths, 1 + tree * {step}, {step})").alias("path")).withColumn("node", F.substring("path", 1, LABEL * depth))
    counts = rows.groupBy("tree", "node").agg(F.count("*").alias("n")).filter(F.col("n") > NODE)
    counts, most = materialise(counts), NODE
    while counts.filter(F.col("n") > most).count() > BROADCAST_ROWS:  # blocks grow so that the list of long runs stays small
        most *= 2
    long = counts.filter(F.col("n") > most).select("tree", "node", F.ceil(F.col("n") * 2 / most).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(long), ["tree", "node"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a block meets itself with every other block, so it need not be alone
    dealt = dealt.filter("blocks = 1 or mine <> other")
    return dealt.select("tree", "node", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "path", "id", "sketch")


def candidate_edges(forest: DataFrame, depth: int) -> DataFrame:
    """(a, b, equal): edges between members (id, paths, sketch) whose connected groups hold every candidate pair of a prefix, and equal bytes of their sketches. At most runs' members in number."""

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

        def close(edges: list):
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "equal"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(i).to_numpy() for i in (0, 2, 3)], 1).astype(np.int32)
            now = [np.concatenate([np.ascontiguousarray(places).view(np.uint8), matrix(batch.column(1))], 1), batch.column(4).to_numpy(), matrix(batch.column(5))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            key, ids, sketches = now
            firsts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            edges: list = []
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if b - a > 1:
                    edges += similar_neighbours(sketches[a:b], ids[a:b])
            held = [x[firsts[-1] :] for x in now]  # the last run may go on
            yield close(edges)
        yield close(similar_neighbours(held[2], held[1]) if held is not None else [])

    runs = runs_of(forest, depth)
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["tree", "node", "low", "high"]
    trie = runs.repartitionByRange(parts, *key).sortWithinPartitions(*key, "path")
    return trie.select("tree", "node", "low", "high", "id", "sketch").mapInArrow(walk, "a long, b long, equal int").groupBy("a", "b").agg(F.max("equal").alias("equal"))


def with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): edges with the least v of their u. A u with many edges has its least v broadcast (there are few of them by their number of edges), so its edges stay where they are; few edges in all are written out with every least v broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    if n_edges <= BROADCAST_ROWS:  # no more rows than edges
        return edges.join(F.broadcast(least.select("u", "m")), "u").select("u", "v", "m")
    hub = max(HUB, n_edges // BROADCAST_ROWS)
    hubs = F.broadcast(least.filter(F.col("_n") > hub).select("u", "m"))
    there = edges.join(hubs, "u", "left")
    few = there.filter("m is null").select("u", "v").join(least.filter(F.col("_n") <= hub).select("u", "m"), "u")
    return there.filter("m is not null").select("u", "v", "m").unionByName(few.select("u", "v", "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): connected components of edges (a, b) by alternating large-star and small-star steps; root is the smallest id.

    Every round is written to the shared folder; the loop ends when the edges, all pointing at their roots, stay the same.
    The rounds needed grow with the logarithm of the longest path; more than ``rounds`` of them are an error.
    """
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda: e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    before = state()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * before["n"]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, before["n"]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select("x.v", "x.m").filter("v <> m")
        e = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct())


def links_of(sets: list, ids: list[int], split: int | None = None) -> tuple[dict[int, int], list[tuple[int, int]], dict[int, int]]:
    """(links by id, spanning edges, links by similarity in hundredths) of the pairs whose Jaccard similarity reaches THRESHOLD.

    sets: sorted distinct hashes. split: pairs of one set before and one set from this position on; else all pairs.
    """
    import numpy as np

    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    new_code = np.cumsum(np.bincount(code, minlength=len(count)) > 0) - 1
    code = new_code[code]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((n, n), np.float32)
    step = 2048
    total = int(code[-1]) + 1 if len(code) else 0
    for at in range(0, total, step):
        a, b = np.searchsorted(code, [at, at + step])
        some = np.zeros((n, min(step, total - at)), np.float32)
        some[owner[a:b], code[a:b] - at] = 1
        rows = np.flatnonzero(some.any(axis=1))
        part = some[rows]
        common[np.ix_(rows, rows)] += part @ part.T
    either = sizes[:, None] + sizes[None, :] - common
    near = common >= THRESHOLD * either - 1e-6
    np.fill_diagonal(near, False)
    if split is not None:
        near[:split, :split] = False
        near[split:, split:] = False
    links = {ids[k]: int(x) for k, x in enumerate(near.sum(axis=1)) if x}
    pairs = np.argwhere(np.triu(near))
    similar, number = np.unique(np.floor(100 * common[pairs[:, 0], pairs[:, 1]] / either[pairs[:, 0], pairs[:, 1]] + 1e-4).astype(int), return_counts=True)
    sets_of = Union(n)
    edges = [(ids[x], ids[y]) for x, y in pairs.tolist() if sets_of.join(x, y)]
    return links, edges, dict(zip(similar.tolist(), number.tolist(), strict=True))


def verify(docs: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, a, b) for groups (id, root) of members (id, doc_id, h, size): 'link' rows (id, part of its number of links), 'edge' rows (id, id), 'similar' rows (hundredths, number of links).

    A group of more than BLOCK members, or BLOCK_SHINGLES shingles, is cut by hash into blocks that are verified pair by
    pair of blocks. A member's text is that of any row with its doc_id and text hash.
    """
    held = groups.join(members, "id")
    sizes = held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = held.join(sizes, "root").select("id", F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "root", "blocks").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = materialise(placed)
    few = placed.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    wanted = rows.join(F.broadcast(placed) if few else placed, ["_doc", "_h"])

    def shingled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 300):
            hashes, bounds = shingle_sets([x.split() for x in utf8(batch, "text")])
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "root", "blocks", "mine")), pa.array(sets, pa.binary())], names=["id", "root", "blocks", "mine", "shingles"])

    sets = wanted.select("id", "root", "blocks", "mine", "text").mapInArrow(shingled, "id long, root long, blocks int, mine int, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("id", "root", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "shingles")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        seen: dict[int, tuple] = {}
        for i, mine, s in zip(*(table.column(c).to_pylist() for c in ("id", "mine", "shingles")), strict=True):
            seen[i] = (mine, np.frombuffer(s, np.uint64))  # rows that repeat an id and its text are the same member
        ids = sorted(seen, key=lambda i: (seen[i][0], i))
        links, edges, similar = links_of([seen[i][1] for i in ids], ids, None if low == high else sum(seen[i][0] == low for i in ids)) if len(ids) > 1 else ({}, [], {})
        kind = ["link"] * len(links) + ["edge"] * len(edges) + ["similar"] * len(similar)
        a, b = [*links, *(e[0] for e in edges), *similar], [*links.values(), *(e[1] for e in edges), *similar.values()]
        return pa.table({"kind": kind, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    return pairs.groupBy("root", "low", "high").applyInArrow(compare, "kind string, a long, b long")


def linked(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, int, float | None]:
    """(verify()'s rows, the depth of the prefix they come from, the recall measured there, None without links). Prefixes are shortened until the recall is RECALL."""
    forest, depth = members.select("id", "paths", "sketch"), DEPTH
    edges = materialise(candidate_edges(forest, depth))
    estimated = {min(1.0, max(0.0, (r["equal"] / SKETCH - 1 / 256) / (1 - 1 / 256))): r["n"] for r in edges.groupBy("equal").agg(F.count("*").alias("n")).collect()}  # SKETCH rows at most
    first = next_depth({s: n for s, n in estimated.items() if s >= THRESHOLD}, depth)
    if first != depth:
        edges, depth = candidate_edges(forest, first), first
    while True:
        groups = components(edges)
        checked = materialise(verify(docs, members.select("id", "doc_id", "h", "size"), groups))
        found = {(r["a"] + 0.5) / 100 if r["a"] < 100 else 1.0: r["n"] for r in checked.filter("kind = 'similar'").groupBy("a").agg(F.sum("b").alias("n")).collect()}  # 21 rows at most
        new = next_depth(found, depth)
        if new == depth:
            return checked, depth, sum(found.values()) / sum(n / meeting(s, depth) for s, n in found.items()) if found else None
        edges, depth = candidate_edges(forest, new), new


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, h, k1, k2, class_id, n_links, n_copies), one row per row of docs that has an id; h: hash of the text."""
    known = materialise(signatures(docs.filter("doc_id is not null")))
    filled = known.filter("size > 0")
    keyed = filled.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min_by(F.struct("doc_id", "h", "size", "paths", "sketch"), F.struct("doc_id", "h")).alias("s"))
    members = materialise(keyed.select("k1", "k2", "n", "s.*").withColumn("id", F.monotonically_increasing_id()))
    checked, _, _ = linked(docs, members)
    groups = components(checked.filter("kind = 'edge'").select("a", "b"))
    links = checked.filter("kind = 'link'").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n_links"))
    named = groups.join(members.select("id", "doc_id"), "id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    near = groups.join(least, "root").select("id", "class_id").join(links, "id")
    member = members.select("id", "k1", "k2", "n", "doc_id").join(near, "id", "left")
    member = member.select("k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    found = filled.select("doc_id", "h", "k1", "k2").join(member, ["k1", "k2"]).select("doc_id", "h", "k1", "k2", "class_id", "n_links", "n_copies")
    zero = F.lit(0).cast("long")
    alone = known.filter("size = 0").select("doc_id", "h", "k1", "k2", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return found.unionByName(alone)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row per row of docs.

    class_id: the smallest id that chains of links and copies reach. n_links: other distinct shingle sets at THRESHOLD
    or more. n_copies: other rows with the same set. Texts without words (null ones too) are linked to nothing: each is
    its own class. Rows without id have class null and count nowhere. Rows that repeat an id with other words are
    members of their own, each with its own links. Other columns are ignored. Jobs run while this is called.
    """
    none = docs.filter("doc_id is null").select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")), *(F.lit(0).cast("long").alias(c) for c in ("n_links", "n_copies")))
    return classified(docs).select("doc_id", "class_id", "n_links", "n_copies").unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the class id, all columns.

    Rows without id stay. Of rows that repeat an id and the words one stays; rows of one id with other words are judged
    each by its own class. Texts without words are classes of their own by id.
    """
    heads = classified(docs).filter("doc_id = class_id").groupBy("doc_id", "k1", "k2").agg(F.min(F.struct(F.col("h").isNull().alias("_null"), "h")).alias("s")).select(F.col("doc_id").alias("_doc"), F.col("s.h").alias("_h"))
    marked = docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64(F.col("text").cast("string")))
    kept = marked.filter("doc_id is not null").join(heads, ["_doc", "_h"], "left_semi").dropDuplicates(["_doc", "_h"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter("doc_id is null"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {
    "op4_jaccard_join": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d),
m AS (SELECT g, md5(array_to_string(g, chr(0))) AS k, min(doc_id) AS rep, count(*) AS n FROM s WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY g),
x AS (SELECT k, rep, len(g) AS size, unnest(g) AS h FROM m), c AS (SELECT a.k AS a, b.k AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS both_ FROM x a JOIN x b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c WHERE both_ >= 0.8 * (sa + sb - both_) - 1e-9),
reach AS (SELECT k AS a, k AS b FROM m UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
class AS (SELECT reach.a AS k, min(m.rep) AS class_id FROM reach JOIN m ON m.k = reach.b GROUP BY reach.a), n AS (SELECT a AS k, count(*) AS links FROM l GROUP BY a)
SELECT s.doc_id, CASE WHEN s.doc_id IS NULL THEN NULL WHEN len(s.g) = 0 THEN s.doc_id ELSE class.class_id END AS class_id, CASE WHEN s.doc_id IS NULL THEN 0 ELSE coalesce(n.links, 0) END AS n_links, CASE WHEN s.doc_id IS NULL THEN 0 ELSE coalesce(m.n - 1, 0) END AS n_copies
FROM s LEFT JOIN m ON m.g = s.g LEFT JOIN class ON class.k = m.k LEFT JOIN n ON n.k = m.k"""
}
