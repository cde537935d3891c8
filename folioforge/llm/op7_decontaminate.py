"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark item of m bytes that a document holds with at most k edits shares at least m - q + 1 - k*q of its q-grams
with it, on diagonals that differ by at most k. Shared q-grams are counted by item and by overlapping diagonal bands
of width 2k; bands that meet the bound are aligned within the band, and kept if k edits suffice. Items too short for
that are looked up word for word, without edits.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, table, utf8

#: Bytes of a q-gram, edits allowed for each byte of an item, and the smallest item (in bytes) that edits are allowed in.
Q, EDIT_RATE, MIN_ITEM = 10, 0.08, 32
#: Items are broadcast in blocks of at most so many bytes each; documents are read once for each block.
BLOCK_BYTES = 32 << 20
#: q-grams of over so many places in a block of items aren't looked up for items that keep enough others.
COMMON = 64
#: Bytes of text hashed at once.
CHUNK = 1 << 18
#: A-Z to lower case and white space to blanks, byte by byte, so that places in the text stay the same.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if 9 <= b <= 13 else b for b in range(256))
#: Words and single signs of a folded text; bytes from 0x80 on belong to words.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^ 0-9a-z\x80-\xff]")
SCHEMA = "doc_id long, item_id long, start long, end long, edits int, item_bytes int"


def banded_edits(item: bytes, text: bytes, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text among alignments that begin on diagonals low .. low + width, or None beyond budget.

    Rows are the item's bytes, columns the text's; only cells whose diagonal is within budget of the band are filled, a
    row at a time. A cell holds its edits and, below, how far its alignment begins from the end of the text, so of
    alignments of equal edits the one that begins last wins. Insertions along a row are a running minimum.
    """
    import numpy as np

    m, n = len(item), len(text)
    lo, hi = low - budget, low + width + budget
    size, one = hi - lo + 1, 1 << 40
    none = (budget + 1) * one
    raw = np.frombuffer(text, np.uint8)
    step = np.arange(size, dtype=np.int64) * one
    cost = np.full(size, none, np.int64)
    first, last = max(low, 0), min(low + width, n)
    if first <= last:
        cost[first - lo : last - lo + 1] = n - np.arange(first, last + 1)
    for i in range(m):
        new = np.full(size, none, np.int64)
        a, b = max(0, -(i + lo)), min(size, n - i - lo)  # cells whose diagonal step consumes a byte of the text
        if a < b:
            new[a:b] = cost[a:b] + np.where(raw[i + lo + a : i + lo + b] != item[i], one, 0)
        np.minimum(new[:-1], cost[1:] + one, out=new[:-1])  # the item's byte isn't in the text
        if a < b:  # the text's byte isn't in the item; the cell before the text may begin such a run
            c = max(0, a - 1)
            new[c:b] = np.minimum.accumulate(new[c:b] - step[c:b]) + step[c:b]
        new[new >= none] = none
        if (new == none).all():
            return None
        cost = new
    at = int(np.argmin(cost >> 40))
    edits = int(cost[at] >> 40)
    return (edits, n - int(cost[at] & (one - 1)), m + lo + at) if edits <= budget else None


class Filter:
    """q-grams of a block of items, and the search for them in texts."""

    def __init__(self, items: list[tuple[int, bytes]]):
        import numpy as np

        self.np = np
        self.items = [(i, t.translate(FOLD)) for i, t in items if len(t) >= MIN_ITEM]
        self.edits = [min(math.floor(EDIT_RATE * len(t)), (len(t) - Q) // Q) for _, t in self.items]
        self.needed = np.array([len(t) - Q + 1 - k * Q for (_, t), k in zip(self.items, self.edits, strict=True)], np.int64)
        codes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, t) in enumerate(self.items):
            got = self.codes(np.frombuffer(t, np.uint8))
            codes.append(got)
            owner.append(np.full(len(got), k))
            place.append(np.arange(len(got)))
        every, owner, place = np.concatenate(codes), np.concatenate(owner), np.concatenate(place)
        # a q-gram of many items meets them all at each of its places; where an item can spare those, it needs as many less
        _, kind, places = np.unique(every, return_inverse=True, return_counts=True)
        common = places[kind] > COMMON
        spared = np.bincount(owner[common], minlength=len(self.items))
        can = 2 * spared <= self.needed if len(self.items) else np.zeros(0, bool)
        self.needed = self.needed - np.where(can, spared, 0)
        keep = ~(common & can[owner]) if len(every) else np.zeros(0, bool)
        every, owner, place = every[keep], owner[keep], place[keep]
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = min(28, max(16, (64 * max(1, len(self.keys))).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def codes(self, raw):
        np = self.np
        if len(raw) < Q:
            return np.zeros(0, np.uint64)
        a = raw.astype(np.uint64)
        two = (a[:-1] << np.uint64(8)) | a[1:]
        four = (two[:-2] << np.uint64(16)) | two[2:]
        eight = (four[:-4] << np.uint64(32)) | four[4:]
        got = (eight[:-2] ^ (two[8:] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return got ^ (got >> np.uint64(32)) ^ (got << np.uint64(17))

    def hits(self, raw):
        """(places in raw, items, places in them) of all shared q-grams."""
        np = self.np
        code = self.codes(raw)
        at = np.flatnonzero(self.seen[(code >> np.uint64(64 - self.bits)).astype(np.int64)])
        if len(at):
            code = code[at]
            k = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            ok = self.keys[k] == code
            at, k = at[ok], k[ok]
        if not len(at):
            return at, at, at
        n = self.count[k]
        idx = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.owner[idx], self.place[idx]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, bytes of the item) of each place that passes; texts are searched whole, several at a time."""
        np = self.np
        if not self.items:
            return
        budgets = np.maximum(np.array(self.edits, np.int64), 1)
        batch, size = [], 0
        todo = [(i, t) for i, t in enumerate(texts) if len(t) >= MIN_ITEM // 2]
        for n, (i, t) in enumerate(todo):
            batch.append((i, t.translate(FOLD)))
            size += len(t)
            if size < CHUNK and n + 1 < len(todo):
                continue
            starts = np.cumsum([0, *(len(t) + 1 for _, t in batch)])
            joined = np.frombuffer(b"\0".join(t for _, t in batch), np.uint8)
            parts = []
            for a in range(0, len(joined), 4 * CHUNK):  # a very long text is hashed piece by piece
                where, item, place = self.hits(joined[a : a + 4 * CHUNK + Q - 1])
                parts.append((where + a, item, place))
            where, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(where):
                doc = np.searchsorted(starts, where, side="right") - 1
                diagonal = where - starts[doc] - place
                band = np.floor_divide(diagonal, budgets[item])
                found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                shift = 1 << 40
                for step in (0, 1):  # overlapping bands: each diagonal is in two
                    key = np.stack([doc, item, band - step + shift], 1)
                    uniq, n_shared = np.unique(key, axis=0, return_counts=True)
                    for d, k, b in uniq[n_shared >= self.needed[uniq[:, 1]]].tolist():
                        low = (b - shift) * int(budgets[k])
                        got = banded_edits(self.items[k][1], batch[d][1], low, 2 * int(budgets[k]) - 1, self.edits[k])
                        if got:
                            found.setdefault((d, k), []).append((got[1], got[2], got[0]))
                for (d, k), places in sorted(found.items()):
                    kept: list[tuple[int, int, int]] = []
                    for p in sorted(places, key=lambda p: (p[2], p[0])):  # of overlapping places the best
                        at = bisect.bisect(kept, p)
                        if (at == 0 or kept[at - 1][1] <= p[0]) and (at == len(kept) or p[1] <= kept[at][0]):
                            kept.insert(at, p)
                    for start, end, edits in kept:
                        yield batch[d][0], self.items[k][0], start, end, edits, len(self.items[k][1])
            batch, size = [], 0


class ShortItems:
    """Items under MIN_ITEM bytes, found as they are but for folding, without outer blanks and on word boundaries."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.sizes = [len(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.by: dict[bytes, list[tuple[int, bytes, bool]]] = {}  # by the first word: where it starts, the item does
        for k, (_, t) in enumerate(items):
            folded = t.translate(FOLD).strip(b" ")
            tokens = TOKEN.findall(folded)
            if tokens:
                self.by.setdefault(tokens[0], []).append((k, folded, self.in_word(folded[-1:])))

    @staticmethod
    def in_word(byte: bytes) -> bool:
        return byte.isalnum() or byte >= b"\x80"

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, place of the item in the given list, start, end); of overlapping places of an item the first."""
        if not self.by:
            return
        get = self.by.get
        for d, t in enumerate(texts):
            text, free = t.translate(FOLD), {}
            for m in TOKEN.finditer(text):
                for k, item, word in get(m[0], ()):
                    start, end = m.start(), m.start() + len(item)
                    if start >= free.get(k, 0) and text.startswith(item, start) and not (word and self.in_word(text[end : end + 1])):
                        free[k] = end
                        yield d, k, start, end


def item_blocks(benchmark: DataFrame) -> list:
    """Broadcasts of the benchmark's items (id, UTF-8), of about BLOCK_BYTES / 2 each; items without id count as -1, null items are none."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // (BLOCK_BYTES // 2)))
    parts = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() for k in range(blocks))
    return [spark.sparkContext.broadcast(sorted(((r["item_id"] if r["item_id"] is not None else -1), r["text"].encode()) for r in part)) for part in parts]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each place where a document holds a benchmark item within its edit budget; start and end are UTF-8 byte places in the text.

    Null and empty texts hold nothing. Items shorter than MIN_ITEM bytes must be held without edits and on word boundaries;
    null items and those of white space alone are held by nothing. Repeated
    documents and repeated items give repeated rows; of places of one item that overlap, the best, then the first, stays.
    Other columns are ignored. The benchmark is read while this is called, and documents once for each block of items.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for given in item_blocks(benchmark):

        def work(batches: Iterator, given=given) -> Iterator:
            import pyarrow as pa

            found, short = Filter(given.value), ShortItems([x for x in given.value if len(x[1]) < MIN_ITEM])
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), utf8(batch, "text")
                rows = [(ids[d], *place) for d, *place in found.search(texts)]
                rows += [(ids[d], short.ids[k], a, b, 0, short.sizes[k]) for d, k, a, b in short.search(texts)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=["doc_id", "item_id", "start", "end", "edits", "item_bytes"])

        got = rows.mapInArrow(work, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that hold no benchmark item, all columns; a filter on each row alone, so ids don't matter: rows without id and rows that repeat one are judged each by its own text.

    Null and empty texts stay, columns of any name pass. Each block of items is one more filter in the same scan.
    """
    kept = docs
    for given in item_blocks(benchmark):

        def task(given=given):
            import numpy as np
            import pyarrow as pa

            found, short = Filter(given.value), ShortItems([x for x in given.value if len(x[1]) < MIN_ITEM])

            def says(column):
                texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[d for d, *_ in found.search(texts)] + [d for d, *_ in short.search(texts)]] = False
                return keep

            return says

        kept = keep_rows(kept, ["text"], task)
    return kept


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item in every document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
