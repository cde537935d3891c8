"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

What a document repeats is a stretch of WINDOW words or more, so a document is parsed into factors: from a place on,
the longest stretch that some document with a smaller id holds, found through an index of the reference's windows and
extended word by word; where nothing of WINDOW words matches, one word is passed over. A factor ends at a boundary;
the windows across it may stand in another document, so the parse goes on with the first of them. Factors become
duplicate spans.

No document meets every other one. Each window is anchored at the smallest hash among its GRAM-word grams, so equal
windows have equal anchors, and the windows of one anchor with their words form a phrase of at most
2 * WINDOW - GRAM words. Reference blocks hold the phrases of their anchors, and a document is factored phrase by phrase
against the block of each:

1. Tasks give the anchors of their documents to blocks of anchors, which say which ones several documents hold. An
   anchor that a task itself meets twice needs no question, so a common anchor costs a block one entry a task.
2. Documents, dealt by id, give the phrases of shared anchors, as words, to the reference blocks; of equal phrases in one
   deal only the earliest document's goes, the others are factors of it (their words are compared). Anchors with a
   large share of all phrases are dealt window by window, so no block gets all phrases of a common anchor.
3. A block factors its phrases in the order of their documents, and adds each to its index.
4. Factors go back to the documents.

What is dealt goes in packed blobs, one for each task and block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import materialise, slices, table, utf8

WINDOW, GRAM = 13, 5
#: Documents of a task that are hashed at once, and entries a task gathers before it deals them out.
ROWS, ENTRIES = 300, 2_000_000
#: An anchor with over 1 / COMMON of all anchors' places, and over LEAST_COMMON places, is dealt by its windows: COMMON anchors at most.
COMMON, LEAST_COMMON = 100_000, 5_000
PLACES = [("anchor", "<u8"), ("phrase", "<u8"), ("text", "<i8"), ("at", "<i4"), ("n", "<i4"), ("first", "<i8")]
#: ``key``: the lower half of an anchor, its upper half chose the block. ``bucket``: the deal of the one document, -1 for several.
ENTRY = [("key", "<u4"), ("count", "<u4"), ("bucket", "<i4")]
REPLY = [("anchor", "<u8")]
#: ``row``: hash of id and text. ``size``: bytes of the phrase's words, which follow the columns.
PHRASE = [("key", "<u8"), ("doc", "<i8"), ("row", "<u8"), ("at", "<i4"), ("size", "<u4")]
SPAN = [("row", "<u8"), ("at", "<i4"), ("n", "<i4")]
BLOB = "bucket int, kind int, blob binary"
ASKED, SHARED, HOT, WORDS, FOUND = range(5)
#: Text of a deal that one group of rows holds, aimed at; a very large corpus gets larger deals before it gets more.
BUCKET_BYTES, BUCKETS, LARGE_BYTES = 2 << 20, 20_000, 128 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def pack(rows) -> bytes:
    """A structured array, column by column, the first one as differences, byte by byte, compressed."""
    import numpy as np
    import zstandard

    out = []
    for k, c in enumerate(rows.dtype.names):
        column = np.ascontiguousarray(rows[c])
        if not k:
            column = np.diff(column, prepend=column.dtype.type(0))
        out.append(np.ascontiguousarray(column.view(np.uint8).reshape(len(rows), -1).T).tobytes())
    return len(rows).to_bytes(4, "little") + zstandard.compress(b"".join(out), 1)


def unpack_one(blob: bytes, kind: list):
    import numpy as np
    import zstandard

    kind = np.dtype(kind)
    n = int.from_bytes(blob[:4], "little")
    raw, at = zstandard.decompress(blob[4:]), 0
    rows = np.empty(n, kind)
    for k, c in enumerate(kind.names):
        size = kind[c].itemsize
        column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind[c]).ravel()
        rows[c] = np.cumsum(column, dtype=kind[c]) if not k else column
        at += n * size
    return rows


def unpack(blobs: list[bytes], kind: list):
    import numpy as np

    out = [unpack_one(b, kind) for b in blobs]
    return np.concatenate(out) if out else np.empty(0, kind)


def pack_words(rows, words: list[bytes]) -> bytes:
    """PHRASE rows and their words."""
    import zstandard

    head = pack(rows)
    return len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join(words), 3)


def unpack_words(blobs: list[bytes]):
    """(PHRASE rows, words of each)."""
    import numpy as np
    import zstandard

    out, words = [], []
    for blob in blobs:
        n = 4 + int.from_bytes(blob[:4], "little")
        rows, raw = unpack_one(blob[4:n], PHRASE), zstandard.decompress(blob[n:])
        ends = np.cumsum(rows["size"], dtype=np.int64)
        words += [raw[a:b] for a, b in zip((ends - rows["size"]).tolist(), ends.tolist(), strict=True)]
        out.append(rows)
    return (np.concatenate(out) if out else np.empty(0, PHRASE)), words


def deal(rows, bucket, kind: int, words: list[bytes] | None = None) -> Iterator:
    """Arrow batches (bucket, kind, blob) of a structured array; bucket: the bucket of each row. No rows, no batch."""
    import numpy as np
    import pyarrow as pa

    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    firsts = np.flatnonzero(firsts_of(bucket))
    ends = np.append(firsts[1:], len(rows))
    cuts = list(zip(firsts.tolist(), ends.tolist(), strict=True))
    blobs = [pack(rows[a:b]) for a, b in cuts] if words is None else [pack_words(rows[a:b], [words[k] for k in order[a:b].tolist()]) for a, b in cuts]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[firsts].astype(np.int32), pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def as_table(batches):
    import pyarrow as pa

    return pa.Table.from_batches(list(batches), pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())]))


def doc_bucket(docs, n: int):
    """As in bucket_column()."""
    return (docs ^ (docs >> 15)) % n


def bucket_column(n: int):
    """The deal of a row's id; rows without id are spread by their text."""
    i = F.col("doc_id")
    return F.coalesce(F.pmod(i.bitwiseXOR(F.shiftright(i, 15)), F.lit(n)), F.pmod(F.xxhash64("text"), F.lit(n))).cast("int")


def block_of(anchors, n: int):
    import numpy as np

    return ((anchors >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def row_key(doc: int, text: bytes) -> int:
    """Tells rows apart that share an id but not their text."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text, seed=doc & 0xFFFFFFFFFFFFFFFF)


def firsts_of(*keys):
    """Whether each row of sorted keys begins a new group."""
    import numpy as np

    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def places_of(words):
    """PLACES of all texts of a slice: each run of windows with the same anchor place. first: its first word in the slice."""
    import numpy as np

    from .wordhash import grams, run_hashes

    gram = grams(words.hashes[0], GRAM)
    per = WINDOW - GRAM + 1
    n = len(gram) - per + 1
    if n <= 0:
        return np.empty(0, PLACES)
    best, where = gram[:n].copy(), np.arange(n, dtype=np.int64)
    for j in range(1, per):
        less = gram[j : j + n] < best
        best[less] = gram[j : j + n][less]
        where[less] = np.flatnonzero(less) + j
    text = words.doc_of()
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :][:n])
    if not len(at):
        return np.empty(0, PLACES)
    where = where[at]
    first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.append(first[1:], len(at)) - 1
    lo, hi = at[first], at[last]
    rows = np.empty(len(first), PLACES)
    rows["anchor"] = gram[where[first]]
    rows["phrase"] = run_hashes(words.hashes[1], lo, hi + WINDOW - 1) + (where[first] - lo).astype(np.uint64)
    rows["text"], rows["first"], rows["n"] = text[lo], lo, hi - lo + 1
    rows["at"] = lo - words.starts[text[lo]]
    return rows


def single_windows(rows, words):
    """PLACES of the single windows of rows; a window's own hash is its anchor, so that windows are dealt one by one."""
    import numpy as np

    from .wordhash import run_hashes

    n = rows["n"].astype(np.int64)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.repeat(rows, n)
    out["at"] += inside.astype(np.int32)
    out["first"] += inside
    out["n"] = 1
    for column, k in (("anchor", 0), ("phrase", 1)):
        out[column] = run_hashes(words.hashes[k], out["first"], out["first"] + WINDOW - 1)
    return out


class Asked:
    """Anchors of a task's documents: entries for blocks of anchors, and what the task can say by itself."""

    def __init__(self, n: int):
        self.n, self.held, self.size, self.rows = n, [], 0, 0

    def add(self, anchors, texts, buckets) -> None:
        import numpy as np

        order = np.lexsort((texts, anchors))
        anchors, texts, buckets = anchors[order], texts[order], buckets[order]
        new = firsts_of(anchors, texts)
        self.held.append((anchors[new], texts[new] + self.rows, buckets[new], np.diff(np.append(np.flatnonzero(new), len(new)))))
        self.size += int(new.sum())

    def flush(self) -> Iterator:
        import numpy as np

        if not self.size:
            return
        anchors, texts, buckets, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((texts, anchors))
        anchors, buckets, counts = anchors[order], buckets[order], counts[order]
        firsts = np.flatnonzero(firsts_of(anchors))
        several = np.diff(np.append(firsts, len(anchors))) > 1
        entries = np.empty(len(firsts), ENTRY)
        entries["key"] = (anchors[firsts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        entries["count"] = np.minimum(np.add.reduceat(counts, firsts), 1 << 31)
        entries["bucket"] = np.where(several, -1, buckets[firsts])
        block = block_of(anchors[firsts], self.n)
        order = np.lexsort((entries["key"], block))
        yield from deal(entries[order], block[order], ASKED)
        known = np.repeat(several, np.diff(np.append(firsts, len(anchors))))
        yield from shared_anchors(short_names(anchors[known], self.n), buckets[known])


def shared_anchors(anchors, buckets) -> Iterator:
    """Replies to deals: each anchor once a deal."""
    import numpy as np

    order = np.lexsort((anchors, buckets))
    anchors, buckets = anchors[order], buckets[order]
    new = firsts_of(anchors, buckets) if len(anchors) else np.zeros(0, bool)
    rows = np.empty(int(new.sum()), REPLY)
    rows["anchor"] = anchors[new]
    yield from deal(rows, buckets[new], SHARED)


def answer(bucket: int, entries):
    """What a block of anchors replies: to single documents the anchors that others hold too, and (kind HOT, without a blob) how many places common anchors have.

    An anchor's upper half isn't kept, so two anchors may be taken for one: documents then give phrases that nothing matches.
    """
    import numpy as np
    import pyarrow as pa

    entries = entries[np.argsort(entries["key"], kind="stable")]
    firsts = np.flatnonzero(firsts_of(entries["key"]))
    sizes = np.diff(np.append(firsts, len(entries)))
    shared = np.maximum.reduceat(entries["bucket"] < 0, firsts) | (sizes > 1)
    tell = entries[np.repeat(shared, sizes) & (entries["bucket"] >= 0)]
    keys = tell["key"].astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
    said = as_table(shared_anchors(keys, tell["bucket"].astype(np.int64)))
    counts = np.add.reduceat(entries["count"].astype(np.int64), firsts)
    common = np.flatnonzero(counts > LEAST_COMMON)
    names = entries["key"][firsts[common]].astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
    hot = {"bucket": pa.array([0] * len(common), pa.int32()), "kind": pa.array([HOT] * len(common), pa.int32()), "anchor": pa.array(names.view(np.int64)), "places": pa.array(counts[common])}
    return pa.concat_tables([said, pa.table(hot)], promote_options="default").select(["bucket", "kind", "blob", "anchor", "places"])


def short_names(anchors, n: int):
    """An anchor as blocks of anchors name it: block and lower half."""
    import numpy as np

    return (anchors & np.uint64(0xFFFFFFFF)) | (block_of(anchors, n).astype(np.uint64) << np.uint64(32))


def phrases_of(texts: list[list[bytes]], docs, rows, wanted, common, n: int):
    """(PHRASE rows, words, SPAN rows): phrases of wanted anchors for the reference blocks, and factors that equal an earlier document's phrase of the same deal."""
    import numpy as np

    from .wordhash import Words

    words = Words(texts)
    found = places_of(words)
    names = short_names(found["anchor"], n)
    found, names = found[np.isin(names, wanted)], names[np.isin(names, wanted)]
    if len(common):
        often = np.isin(names, common)
        found = np.concatenate([found[~often], single_windows(found[often], words)])
    doc = docs[found["text"]]
    order = np.lexsort((found["at"], doc, found["phrase"], found["anchor"]))
    found, doc = found[order], doc[order]
    new = firsts_of(found["anchor"], found["phrase"])
    firsts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = doc > doc[firsts[group]]
    again = np.flatnonzero(later)
    both = (found[again], found[firsts[group[again]]])
    at = ((r["text"].tolist(), r["at"].tolist(), (r["at"] + r["n"] + WINDOW - 1).tolist()) for r in both)
    same = [texts[t][a:b] == texts[u][c:d] for t, a, b, u, c, d in zip(*(x for r in at for x in r), strict=True)]
    later[again] = same  # equal hashes: the words must be equal too
    spans = np.empty(int(later.sum()), SPAN)
    spans["row"], spans["at"], spans["n"] = rows[found["text"][later]], found["at"][later], found["n"][later] + WINDOW - 1
    given, doc = found[~later], doc[~later]
    said = [b" ".join(texts[t][a : a + k + WINDOW - 1]) for t, a, k in zip(given["text"].tolist(), given["at"].tolist(), given["n"].tolist(), strict=True)]
    out = np.empty(len(given), PHRASE)
    out["key"], out["doc"], out["row"], out["at"] = given["anchor"], doc, rows[given["text"]], given["at"]
    out["size"] = [len(x) for x in said]
    return out, said, spans


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[p : p + WINDOW]) for p in range(len(words) - WINDOW + 1)]


def factors(words: list[bytes], doc: int, index: dict, windows: list[bytes] | None = None) -> list[tuple[int, int]]:
    """(place, words) of the factors of a phrase against the index of windows: window -> (document, words, place) of the first document that holds it."""
    out: list[tuple[int, int]] = []
    windows = windows_of(words) if windows is None else windows
    at, n = 0, len(words)
    while at + WINDOW <= n:
        there = index.get(windows[at])
        if there is None or there[0] >= doc:
            at += 1
            continue
        _, other, place = there
        size = WINDOW
        while at + size < n and place + size < len(other) and words[at + size] == other[place + size]:
            size += 1
        out.append((at, size))
        at += size - WINDOW + 1  # the first window across the boundary
    return out


def factor_block(rows, words: list[bytes]):
    """SPAN rows and their documents of a reference block: every phrase factored against those of the same anchor in documents with smaller ids."""
    import numpy as np

    order = np.lexsort((rows["at"], rows["doc"], rows["key"]))
    rows, words = rows[order], [words[k] for k in order.tolist()]
    firsts = np.flatnonzero(firsts_of(rows["key"])).tolist() if len(rows) else []
    spans: list[tuple[int, int, int, int]] = []
    docs, keys, ats = rows["doc"].tolist(), rows["row"].tolist(), rows["at"].tolist()
    for a, b in zip(firsts, [*firsts[1:], len(rows)], strict=True):
        if docs[a] == docs[b - 1]:
            continue
        if len(set(words[a:b])) == 1:  # the first document's phrase is one factor of all others
            size = words[a].count(b" ") + 1
            spans += [(keys[k], ats[k], size, docs[k]) for k in range(a, b) if docs[k] > docs[a]]
            continue
        index: dict = {}
        whole: dict[bytes, tuple[int, int, list]] = {}  # phrase -> (document, words, its factors)
        for k in range(a, b):
            doc, text = docs[k], words[k]
            known = whole.get(text)
            if known is not None:
                got = [(0, known[1])] if known[0] < doc else known[2]
            else:
                said = text.split(b" ")
                windows = windows_of(said)
                got = factors(said, doc, index, windows)
                whole[text] = (doc, len(said), got)
                for p, window in enumerate(windows):
                    index.setdefault(window, (doc, said, p))
            spans += [(keys[k], ats[k] + p, size, doc) for p, size in got]
    out = np.empty(len(spans), SPAN)
    for c, i in (("row", 0), ("at", 1), ("n", 2)):
        out[c] = [x[i] for x in spans]
    return out, np.array([x[3] for x in spans], np.int64)


def duplicate_words(n: int, spans):
    """Which of a document's n words spans cover."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans["at"].astype(np.int64), 1)
    np.add.at(edge, np.minimum(spans["at"].astype(np.int64) + spans["n"], n), -1)
    return np.cumsum(edge[:n]) > 0


def find_duplicates(docs: DataFrame, finish: Callable, schema: str | StructType, carry: bool = False) -> DataFrame:
    """The table that ``finish(batch, words, covered)`` makes of docs, batch by batch.

    batch has doc_id, text and, with ``carry``, the whole row as the struct _row, so columns of any name and type pass;
    words has each text's words; covered has, for each row, None or a mask of the words to remove. Rows without id
    neither remove nor lose words, null and empty texts have none, equal ids don't remove each other's words, and rows
    of one id with different texts are judged each by its own text. Jobs run while this is called.
    """
    spark = docs.sparkSession
    own = [F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, min(BUCKETS, -(-size // BUCKET_BYTES)), -(-size // LARGE_BYTES)) | 1

    def ask(batches: Iterator) -> Iterator:
        import numpy as np

        from .wordhash import Words

        asked = Asked(n)
        for batch in slices(batches, ROWS):
            batch = batch.filter(batch.column(0).is_valid())
            found = places_of(Words([x.split() for x in utf8(batch, "text")]))
            docs = batch.column(0).to_numpy()
            asked.add(found["anchor"], found["text"], doc_bucket(docs, n)[found["text"]] if len(found) else np.zeros(0, np.int64))
            asked.rows += len(docs)
            if asked.size >= ENTRIES:
                yield from asked.flush()
        yield from asked.flush()

    def reply(table):
        return answer(table.column("bucket")[0].as_py(), unpack(table.column("blob").to_pylist(), ENTRY))

    asked = materialise(rows.select("doc_id", "text").mapInArrow(ask, BLOB))
    replied = materialise(asked.filter(F.col("kind") == ASKED).groupBy("bucket").applyInArrow(reply, f"{BLOB}, anchor long, places long"))
    given = spark.sparkContext.broadcast(_common(replied))  # COMMON anchors at most

    def give(left, right):
        import numpy as np

        wanted = np.unique(unpack(right.column("blob").to_pylist(), REPLY)["anchor"])
        if not len(wanted) or not left.num_rows:
            return as_table([])
        texts, ids, keys = [], [], []
        for batch in left.to_batches():
            for i, raw in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                if i is not None and raw:
                    texts.append(raw.split())
                    ids.append(i)
                    keys.append(row_key(i, raw))
        said, words, spans = phrases_of(texts, np.array(ids, np.int64), np.array(keys, np.uint64), wanted, given.value, n)
        here = int(right.column("bucket")[0].as_py())
        order = np.argsort(said["key"], kind="stable")
        out = list(deal(said[order], (said["key"][order] % np.uint64(n)).astype(np.int64), WORDS, [words[k] for k in order.tolist()]))
        spans = spans[np.lexsort((spans["at"], spans["row"]))]
        # factors found here go round with the phrases, so that one shuffle serves both
        out += list(deal(spans, np.full(len(spans), here), FOUND))
        return as_table(out)

    def factor(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        spans, docs = factor_block(*unpack_words([b for k, b in zip(kinds, blobs, strict=True) if k == WORDS]))
        order = np.lexsort((spans["at"], spans["row"]))
        passed = table.select(["bucket", "kind", "blob"]).filter(pa.compute.equal(table.column("kind"), FOUND))
        return as_table([*deal(spans[order], doc_bucket(docs[order], n), FOUND), *passed.cast(as_table([]).schema).to_batches()])

    def last(left, right):
        import numpy as np
        import pyarrow as pa

        spans = unpack(right.column("blob").to_pylist(), SPAN)
        spans = spans[np.argsort(spans["row"], kind="stable")]
        heads = np.flatnonzero(firsts_of(spans["row"])).tolist()
        of = {int(spans["row"][a]): spans[a:b] for a, b in zip(heads, [*heads[1:], len(spans)], strict=False)}
        out = []
        for batch in left.to_batches():
            texts = utf8(batch, "text")
            words = [x.split() for x in texts]
            found = [of.get(row_key(i, t)) if i is not None else None for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            out.append(finish(batch, words, [None if f is None else duplicate_words(len(w), f) for w, f in zip(words, found, strict=True)]))
        return pa.Table.from_batches(out) if out else finish.empty()

    names = rows.columns
    left = rows.withColumn("_deal", bucket_column(n)).groupBy("_deal")
    narrow = lambda f: lambda a, b: f(a.select(names), b)
    told = asked.unionByName(replied.select(*asked.columns)).filter(F.col("kind") == SHARED)
    phrases = left.cogroup(told.groupBy("bucket")).applyInArrow(narrow(give), BLOB)
    spans = phrases.groupBy("bucket").applyInArrow(factor, BLOB)
    return left.cogroup(spans.groupBy("bucket")).applyInArrow(narrow(last), schema)


def _common(replied: DataFrame):
    """Common anchors with over 1 / COMMON of the places of all common anchors: COMMON of them at most, since each has over LEAST_COMMON places too."""
    import numpy as np

    hot = replied.filter(F.col("kind") == HOT)
    total = hot.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first()["n"]
    return np.sort(np.array([r["anchor"] for r in hot.filter(F.col("places") > total // COMMON).select("anchor").collect()], np.int64).view(np.uint64))


class _Digest:
    SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"

    def empty(self):
        import pyarrow as pa

        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "spans": pa.array([], self.kind())})

    def kind(self):
        import pyarrow as pa

        return pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def __call__(self, batch, words, covered):
        import pyarrow as pa

        kept = [w if c is None else [x for x, gone in zip(w, c.tolist(), strict=True) if not gone] for w, c in zip(words, covered, strict=True)]
        digests = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
        removed = [len(w) - len(k) for w, k in zip(words, kept, strict=True)]
        spans = [[] if c is None else runs(c) for c in covered]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, self.kind())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def runs(mask) -> list[dict]:
    """First and last word of each stretch of removed words."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [{"first": a, "last": b - 1} for a, b in edge.reshape(-1, 2).tolist()]


def cut(text: bytes, mask) -> bytes:
    """The text without its masked words; each kept word keeps the white space behind it."""
    places = [m.start() for m in WORD.finditer(text)]
    ends = [*places[1:], len(text)]
    head = text[: places[0]] if places else text
    return (head + b"".join(text[a:b] for a, b, gone in zip(places, ends, mask.tolist(), strict=True) if not gone)).rstrip()


class _Rewrite:
    """Rows with their new text; rows that lose their last word go. _cut: whether the text has changed."""

    def __call__(self, batch, words, covered):
        import pyarrow as pa

        text = [None if c is None else cut(t, c).decode() for t, c in zip(utf8(batch, "text"), covered, strict=True)]
        keep = [c is None or not c.all() for c in covered]
        rows = pa.RecordBatch.from_arrays([batch.column(2), pa.array(text, pa.string()), pa.array([c is not None for c in covered])], names=["_row", "_text", "_cut"])
        return rows.filter(pa.array(keep))

    def empty(self):
        raise AssertionError("a group has rows on one side at least, and blobs only for documents there are")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans), one row per row of docs.

    spans: first and last word of each removed stretch. Null and empty texts have no words; rows without id keep all of
    theirs; rows that repeat an id don't remove each other's words. Other columns are ignored; an empty table gives no rows.
    """
    return find_duplicates(docs, _Digest(), _Digest.SCHEMA)


def cut_duplicates(docs: DataFrame) -> DataFrame:
    """docs with duplicate spans cut out of text, and n_chars, if there is such a column, brought up to date.

    Documents that lose their last word go. Rows without id, null and empty texts and rows without duplicates stay as
    they are, whatever their columns' names and types; rows that repeat an id don't cut each other.
    """
    whole = StructType([StructField("_row", StructType(docs.schema.fields)), StructField("_text", StringType()), StructField("_cut", BooleanType())])
    got = find_duplicates(docs, _Rewrite(), whole, carry=True)

    def column(c: str):
        old = F.col("_row").getField(c)
        new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema[c].dataType)}.get(c)
        return (old if new is None else F.when(F.col("_cut"), new).otherwise(old)).alias(c)

    return got.select(*map(column, docs.columns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses to documents with smaller ids."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES: dict[str, str] = {
    "op9_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL), k AS (SELECT r, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS x FROM p),
f AS (SELECT r, doc_id, pos, min(doc_id) OVER (PARTITION BY x) AS least FROM k), g AS (SELECT DISTINCT r, unnest(range(pos, pos + 13)) AS gone FROM f WHERE least < doc_id),
e AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d), m AS (SELECT e.r, count(g.gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g.gone IS NULL), '')) AS kept_sha256 FROM e LEFT JOIN g ON g.r = e.r AND g.gone = e.i GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN m ON m.r = d.r"""
}
