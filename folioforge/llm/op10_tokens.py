"""Token ids as Parquet list columns: dictionary-coded ids, bounded row groups, page indexes, in ascending document order.

Texts are range-partitioned by id and sorted, so the files follow the order of ids and each file's row groups can be
skipped by their statistics on doc_id. Offsets are prefix sums: within a file while writing, across files from the
files' own totals.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices, table, tokenizer_path
from .wordhash import BYTE_BASES, FIRST_BYTES, mix

END_ID = 2
#: Bytes of a row group and of a page: a reader that wants one document reads a page of ids, not a file.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: Words whose ids a worker remembers.
CACHE = 1_000_000
#: Bytes of texts whose words are looked up together, most bytes of two such texts, and of a word that is looked up.
GROUP, MOST, LONGEST = 1 << 16, 1 << 21, 64
#: Bytes of a word that are compared as numbers.
WIDE = 16
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Signs that end a piece of letters and make one of their own; the apostrophe isn't among them, as it may begin a short form.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Every sign but the blank and the newline that Python or the library's pre-tokenizer takes for white space (fixed values).
ODD_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = "".join(c for c in ODD_SPACE if c.isascii())
#: Texts of one file, aimed at; bounds what one task encodes and what a reader opens, whatever the corpus holds.
FILE_BYTES = 256 << 20
#: Characters of a text that deal out rows of one id, or of none, which may be many.
RANGE_CHARS = 128


class Known:
    """Words with the blank or newline before them, as bytes, and their ids, in arrays: open addressing by a 64-bit hash, and the bytes are compared, the first WIDE as numbers of eight bytes.

    What is asked of a word stands in one row: hash, bytes, ids, place of the ids, the first WIDE bytes. When ``room`` words are held all are forgotten.
    """

    def __init__(self, room: int):
        import numpy as np

        self.np, self.room = np, room
        most = room + MOST // 2
        self.last = (1 << (2 * most).bit_length()) - 1  # under half of the places are taken
        self.place = np.zeros(self.last + 1, np.int32)  # 1 + number of the word
        self.rows = np.zeros((most, 4 + WIDE // 8), np.int64)
        self.start, self.ids_at = np.zeros(most + 1, np.int64), 0
        self.bytes, self.ids = np.zeros(12 * room + 2 * MOST, np.uint8), np.zeros(6 * room + 4 * MOST, np.uint32)
        self.n = 0

    def find(self, hashes):
        """(number of the word with each hash, or -1; its row)."""
        np = self.np
        hashes = hashes.view(np.int64)
        at = hashes & self.last
        got = self.place[at] - 1
        rows = self.rows[got]
        left = np.flatnonzero((got >= 0) & (rows[:, 0] != hashes))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            got[left] = self.place[at[left]] - 1
            rows[left] = self.rows[got[left]]
            left = left[(got[left] >= 0) & (rows[left, 0] != hashes[left])]
        return got, rows

    def full(self, words: int, size: int) -> bool:
        """Whether so many more words of so many bytes ask for a new start."""
        return self.n + words > self.room or self.start[self.n] + size > len(self.bytes) or self.ids_at + 2 * size > len(self.ids)

    def forget(self) -> None:
        self.place[:], self.n, self.ids_at = 0, 0, 0

    def add(self, hashes, heads, words: list[bytes], ids: list[bytes]) -> None:
        """Words with hashes that aren't held yet. heads: eights() of each up to WIDE bytes."""
        np, a, b = self.np, self.n, self.n + len(words)
        sizes, n_ids = np.array(list(map(len, words)), np.int64), np.array([len(x) // 4 for x in ids], np.int64)
        ends = self.ids_at + np.cumsum(n_ids)
        self.rows[a:b] = np.column_stack([hashes.view(np.int64), sizes, n_ids, ends - n_ids, heads.view(np.int64)])
        self.start[a + 1 : b + 1] = self.start[a] + np.cumsum(sizes)
        self.bytes[self.start[a] : self.start[b]] = np.frombuffer(b"".join(words), np.uint8)
        self.ids[self.ids_at : ends[-1]] = np.frombuffer(b"".join(ids), "<u4")
        self.ids_at = int(ends[-1])
        self.n = b
        at, number = (hashes & np.uint64(self.last)).astype(np.int64), np.arange(a + 1, b + 1, dtype=np.int32)
        while len(at):
            free = self.place[at] == 0
            self.place[at[free]] = number[free]
            on = self.place[at] != number
            at, number = (at[on] + 1) & self.last, number[on]


class Signs(dict):
    """Ids of runs of signs behind letters; a bounded number of them is remembered."""

    def __init__(self, owner: WordCoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, run: str) -> bytes:
        if len(self) > 20_000:
            self.clear()
        got = self[run] = self.owner.ask(run)
        return got


class WordCoder:
    """Ids of whole texts, word by word; the tokenizers library is asked once for each word that is remembered.

    The pre-tokenizer starts a new piece at every single blank and at either side of every single newline that
    stand between other characters, and where signs follow letters; a piece's ids depend on nothing else. Texts with
    any other white space, with two white-space signs in a row, or with one at either end are given to the library whole,
    and so are texts that spell one of its added tokens, which it takes for that token wherever it stands.
    """

    def __init__(self, path: str, room: int = CACHE):
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        self.coder = Tokenizer.from_file(path)
        self.coder.no_padding()
        self.coder.no_truncation()

        # one piece goes straight to the library's model, in its alphabet of printable bytes (a fixed rule of byte-level BPE)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.piece = self.coder.model.tokenize
        self.newline = self.ask("\n")
        self.signs = Signs(self)
        self.blank = chr(self.alphabet[32])
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that begin with a blank
        self.leads[[k for t, k in vocabulary.items() if t.startswith(self.blank)]] = True
        self.apart = self.words_stay_apart(vocabulary)
        self.known = Known(room)
        self.sign, self.letter = (np.array([b < 128 and f(chr(b)) for b in range(256)]) for f in (SIGNS.__contains__, str.isalpha))

    def ask(self, text: str) -> bytes:
        return self.np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one_piece(self, text: str) -> bytes:
        return array("I", [t.id for t in self.piece(text.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def words_stay_apart(self, vocabulary: dict[str, int]) -> bool:
        """Whether the model never merges letters with a blank behind them, so that it may be given many words at once."""
        model, back = self.coder.model, {chr(c): b for b, c in self.alphabet.items()}
        if any(getattr(model, x, None) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            return False
        before = [t[:k] for t in vocabulary if self.blank in t[1:] for k in range(1, len(t)) if t[k] == self.blank]
        last = [bytes(back.get(c, 0) for c in t).decode(errors="replace")[-1] for t in before]
        return not any(c.isalpha() or c == "\ufffd" for c in last)  # that sign stands for the end of a letter's bytes

    def pieces(self, words: list[str]) -> list[bytes]:
        """one_piece() of words of letters, each behind a blank, in one call. Each has as its first token the only one that begins with a blank."""
        if not self.apart or not words:
            return [self.one_piece(" " + w) for w in words]
        raw = self.one_piece(" " + " ".join(words))
        bounds = [*(4 * self.np.flatnonzero(self.leads[self.np.frombuffer(raw, "<u4")])).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the blank or newline before it, and of signs that stand behind letters."""
        body = {w: w[1:].rstrip(SIGNS) if not w[1:].isalpha() else w[1:] for w in words}
        alone = list(dict.fromkeys(b for w, b in body.items() if w[0] == " " and b.isalpha()))
        made, out = dict(zip(alone, self.pieces(alone), strict=True)), []
        for w in words:
            b, ahead = body[w], b"" if w[0] == " " else self.newline
            if w[0] in SIGNS:
                out.append(self.signs[w])
            elif b.isalpha():
                end = w[1 + len(b) :]
                out.append(ahead + (self.one_piece(b) if ahead else made[b]) + (self.signs[end] if end else b""))
            else:
                out.append(ahead + self.ask(w[1:] if ahead else w))
        return out

    def plain(self, text: str) -> bool:
        """Whether a text's words can be encoded one by one, if single blanks and newlines stand between them."""
        return not any(c in text for c in (ASCII_SPACE if text.isascii() else ODD_SPACE)) and not any(t in text for t in self.added)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The words of texts of GROUP bytes are looked up together; texts of over MOST bytes are given to the library whole."""
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode() if self.plain(text) else b""
            if not raw or len(raw) > MOST // 2:
                out[k] = self.ask(text)
                continue
            group.append((k, raw))
            size += len(raw) + 1
            if size > GROUP:
                self.encode_group(group, texts, out)
                group, size = [], 0
        self.encode_group(group, texts, out)
        return out

    def encode_group(self, group: list[tuple[int, bytes]], texts: list[str], out: list[bytes]) -> None:
        if not group:
            return
        np, known = self.np, self.known
        whole = b"\n" + b"\n".join(x for _, x in group)  # so a blank or newline stands before each word
        raw = np.frombuffer(whole, np.uint8)
        starts = np.flatnonzero((raw == 32) | (raw == 10))
        # signs at a word's end, behind a letter of ASCII, are a piece and so a word of their own
        ends = np.append(starts[1:], len(raw))
        behind = ends.copy()
        left = np.flatnonzero(self.sign[raw[behind - 1]])
        for _ in range(LONGEST):  # a word of more signs isn't looked up
            if not len(left):
                break
            behind[left] -= 1
            left = left[self.sign[raw[behind[left] - 1]]]
        cut = np.flatnonzero((behind < ends) & self.letter[raw[behind - 1]])
        starts = np.insert(starts, cut + 1, behind[cut])
        sizes = np.diff(np.append(starts, len(raw)))
        heads, hashes = eights(whole, starts, sizes)
        short = (sizes <= LONGEST) & ((sizes > 1) | self.sign[raw[starts]])
        got, rows = known.find(hashes)
        got[~short] = -1
        if ((got < 0) & short).any() and known.full(len(starts), len(raw)):
            known.forget()
            got[:] = -1
        new = np.flatnonzero((got < 0) & short)
        if len(new):
            one, at, to = np.unique(hashes[new], return_index=True, return_inverse=True)
            words = [whole[a:b] for a, b in zip(starts[new[at]].tolist(), (starts + sizes)[new[at]].tolist(), strict=True)]
            got[new] = known.n + to
            known.add(one, heads[new[at]], words, self.learn([w.decode() for w in words]))
            rows[new] = known.rows[got[new]]
        right = short & (rows[:, 1] == sizes)
        for k in range(WIDE // 8):
            right &= rows[:, 4 + k] == heads[:, k].view(np.int64)
        same = np.flatnonzero(right & (sizes > WIDE))
        if len(same):
            differ = known.bytes[spread(known.start[got[same]], sizes[same])] != raw[spread(starts[same], sizes[same])]
            right[same] = ~np.logical_or.reduceat(differ, np.cumsum(sizes[same]) - sizes[same])
        counts = np.where(right, rows[:, 2], 0)
        ids = known.ids[spread(rows[:, 3], counts)].astype("<u4").tobytes()
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for _, x in group)]))
        ends, wrong = np.append(0, np.cumsum(counts))[first].tolist(), np.append(0, np.cumsum(~right))[first].tolist()
        for j, (k, _) in enumerate(group):  # a long word, two white-space signs in a row or one at an end, or two words of one hash: the library has the whole text
            out[k] = self.ask(texts[k]) if wrong[j + 1] > wrong[j] else ids[4 * ends[j] + len(self.newline) : 4 * ends[j + 1]]


def eights(whole: bytes, starts, sizes):
    """(the first WIDE bytes of each word as numbers of eight bytes, zeros behind its end; hash of its size and first LONGEST bytes)."""
    import numpy as np

    at = np.ndarray(len(whole), "<u8", whole + bytes(8), strides=(1,))  # the eight bytes from each place on
    heads, hashes = np.zeros((len(starts), WIDE // 8), np.uint64), sizes.astype(np.uint64) * BYTE_BASES[0]
    some = np.arange(len(starts))
    for k in range(LONGEST // 8):
        some = some[sizes[some] > 8 * k]
        if not len(some):
            break
        eight = at[starts[some] + 8 * k] & FIRST_BYTES[np.minimum(sizes[some] - 8 * k, 8)]
        if k < WIDE // 8:
            heads[some, k] = eight
        hashes[some] = mix(hashes[some] ^ eight) * BYTE_BASES[1]
    return heads, hashes ^ (hashes >> np.uint64(32))


def spread(starts, sizes):
    """All places of ranges that start and are as long as said, end to end."""
    import numpy as np

    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder for a worker process, kept from task to task."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write (doc_id, part, local_start, n_tokens, ids) in ascending order of doc_id, null ids first, equal ids by text.

    Ids are those of the library as it is, with add_special_tokens off: a text that spells an added token has that token.
    Null texts count as empty: they hold the end id alone. Rows that repeat an id stay, each with its own ids; an empty
    table gives files without rows; other columns of docs are left out. Ids are held for one slice of rows at a time.
    Files are as many as the texts' bytes ask for (FILE_BYTES), and the shuffle setting at least.
    """
    tokens = tokenizer or tokenizer_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // FILE_BYTES))
    placed = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, start, end = coder(tokens), 0, np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 200):
            coded = words.encode_all(batch.column(1).to_pylist())
            sizes = np.array([len(x) // 4 + 1 for x in coded], np.int64)
            flat = np.frombuffer(b"".join(x for c in coded for x in (c, end)), "<i4")
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(start + bounds[:-1]), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(bounds[-1])

    (
        placed.select("doc_id", "text", "part").mapInArrow(work, FILE_SCHEMA).write
        .option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.page.write-checksum.enabled", "true").parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens() wrote; metadata columns alone don't touch the ids."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): tokens before each file, from metadata columns alone. One row for each file."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            bounds, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes = np.diff(bounds).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "local_start", "ids").mapInArrow(work, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    index = token_index(spark, path)  # as many rows as files
    return rows.join(F.broadcast(index), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written while this query is built and digested from the files."""
    path = scratch(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digest_tokens(spark, path)


QUERIES = {"op10_token_ids": op10_token_ids}
ORACLES: dict[str, str] = {}
