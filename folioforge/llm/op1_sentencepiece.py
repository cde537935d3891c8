"""SentencePiece encoding and decoding over a relational lattice.

Text is cut into units: a run of blanks with the word behind it, or a line end. No piece of the model crosses such a
cut (``Model`` checks that), so a unit's ids depend on the unit alone. The lattice of a unit is relational: substrings
of bounded length are exploded, joined to the piece table, and grouped by unit as edges. Spark's higher-order
``aggregate`` then folds the edges: Viterbi by score for a unigram model, and for a BPE model (the public one is BPE,
where the best path is not the right answer) the merges in order of rank, on a bit set of boundaries.

Units are counted over all documents; the lattice encodes the ``LATTICE_UNITS`` most frequent ones, a bounded number,
and its result is broadcast. A worker that meets another unit folds that unit's lattice by the same rule.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import warnings
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, tokenizer_path, trim

BLANK = "\u2581"
#: Units the relational lattice encodes, and characters of a unit that it takes (boundaries are the bits of a long).
LATTICE_UNITS, LATTICE_CHARS = 250_000, 60
#: Units a worker counts before it hands its counts on, and units whose ids it remembers.
COUNTED, REMEMBERED = 300_000, 200_000
#: Signs that are cut off behind a letter, if no piece of the model has a letter and then the sign.
SIGNS = ".,;:!?"
_UNIT = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


@dataclass
class Model:
    """Pieces and scores of a SentencePiece model file, without a dependence on how it was trained."""

    pieces: list[str]
    scores: list[float]
    kind: str  # bpe or unigram
    unknown: int
    first_byte: int | None
    text: dict[str, int] = field(default_factory=dict)
    rank: dict[str, int] = field(default_factory=dict)
    longest: int = 1
    signs: str = ""

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        p = sp.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = p.get_piece_size()
        bytes_at = [i for i in range(n) if p.is_byte(i)]
        model = cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type], p.unk_id(), bytes_at[0] if bytes_at else None)
        model.text = {model.pieces[i]: i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
        order = {s: k for k, s in enumerate(sorted({model.scores[i] for i in model.text.values()}, reverse=True))}
        model.rank = {t: order[model.scores[i]] for t, i in model.text.items()}
        model.longest = max(map(len, model.text))
        model.signs = "".join(c for c in SIGNS if not any(b == c and a.isalpha() for t in model.text for a, b in zip(t, t[1:], strict=False)))
        if any(BLANK in t.lstrip(BLANK) or "\n" in t for t in model.text):
            raise ValueError("a piece of this model crosses the units' boundaries")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that leave the text as it is and put a blank before it are supported")
        return model


def units(text: str) -> list[str]:
    """The units of a text, blanks as BLANK, with the blank that the model puts before a text."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text or "\0" in text:
        return _UNIT.findall(BLANK + text.replace(" ", BLANK))
    return [u for u in (BLANK + text.replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")).split("\0") if u]


def cut_sign(unit: str, model: Model) -> tuple[str, str] | None:
    """The unit without its last sign, and the sign, if the model has no piece across that cut."""
    return (unit[:-1], unit[-1]) if len(unit) > 1 and unit[-1] in model.signs and unit[-2].isalpha() else None


def count_units(docs: DataFrame, model: Model) -> DataFrame:
    """(unit, n) over all documents, units without the signs behind them; tasks add up before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()

        def out():
            for u in [u for u in seen if u[-1] in SIGNS]:
                cut = cut_sign(u, shared.value)
                if cut:
                    n = seen.pop(u)
                    seen[cut[0]] += n
                    seen[cut[1]] += n
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])
            seen.clear()
            return got

        for batch in slices(batches, 500):
            for t in batch.column(0).to_pylist():
                seen.update(units(t or ""))
            if len(seen) > COUNTED:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(work, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(counts: DataFrame, most: int = LATTICE_UNITS) -> DataFrame:
    """The units of the highest counts, as many whole counts as fit into ``most``; found from the counts' own frequencies."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("units")).orderBy(F.desc("n")).limit(most).collect()  # each count has a unit at least
    least, total = None, 0
    for r in sizes:
        if total + r["units"] > most:
            break
        least, total = r["n"], total + r["units"]
    if least is None and sizes:
        warnings.warn(f"{sizes[0]['units']} units share the highest count, over {most}: none goes through the lattice", stacklevel=2)
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least).select("unit")


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(unit, n, edges): for each unit of up to LATTICE_CHARS characters its edges, sorted by rank and place.

    An edge is a substring that is a piece, or a single character that isn't (id null).
    """
    spark = words.sparkSession
    pieces = spark.createDataFrame([(t, i, model.rank[t], float(model.scores[i])) for t, i in model.text.items()], "piece string, id int, rank int, score double")
    # ends and inner boundaries of an edge as bits; a unit's boundary i is bit i
    spans = words.select("unit", F.length("unit").alias("n")).filter(F.col("n") <= LATTICE_CHARS)
    spans = spans.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = spans.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("s")))))
    spans = spans.withColumn("piece", F.expr("substring(unit, s + 1, l)"))
    found = spans.join(F.broadcast(pieces), "piece", "left").filter("id is not null or l = 1")  # the piece table is the model's own vocabulary
    ends = F.expr("shiftleft(1L, s) | shiftleft(1L, s + l)")
    inner = F.expr("(shiftleft(1L, s + l) - 1L) & ~(shiftleft(1L, s + 1) - 1L)")
    edge = F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), F.col("s").alias("s"), F.col("l").alias("l"), "id", "score", ends.alias("ends"), inner.alias("inner"), F.when(F.col("id").isNull(), F.col("piece")).alias("odd"))
    return found.groupBy("unit").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(edge)).alias("edges"))


def _spell(model: Model) -> str:
    """SQL: the ids of edge e; a character without a piece falls back to its bytes, or is unknown."""
    if model.first_byte is None:
        return f"array(coalesce(e.id, {model.unknown}))"
    return (
        "case when e.id is not null then array(e.id) else transform(sequence(0, octet_length(e.odd) - 1), "
        f"b -> cast({model.first_byte} + cast(conv(substring(hex(encode(e.odd, 'utf-8')), 2 * b + 1, 2), 16, 10) as int) as int)) end"
    )


def fold_merges(edges: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of BPE: start with a boundary at each character; again and again the first edge in rank order that has exactly one boundary inside loses it."""
    free = "(b & e.ends) = e.ends"
    step = f"coalesce(b & ~get(filter(m, e -> {free} and bit_count(b & e.inner) = 1), 0).inner, b)"
    cut = f"aggregate(sequence(1, n), shiftleft(1L, n + 1) - 1L, (b, k) -> {step})"
    path = f"filter(edges, e -> {free} and (b & e.inner) = 0L)"
    ordered = f"array_sort({path}, (x, y) -> x.s - y.s)"
    merges = edges.withColumn("m", F.expr("filter(edges, e -> e.l > 1)"))
    return merges.withColumn("b", F.expr(cut)).select("unit", F.expr(f"flatten(transform({ordered}, e -> {_spell(model)}))").alias("ids"))


def fold_viterbi(edges: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of a unigram model: the path of the largest sum of scores.

    One fold over edges by end keeps, for each place, the best score and the edge that reaches it; a second walks back.
    Unknown characters cost what the model's worst piece does, less 10.
    """
    worst = min(model.scores[i] for i in model.text.values()) - 10.0
    by_end = "array_sort(edges, (x, y) -> case when x.s + x.l <> y.s + y.l then x.s + x.l - y.s - y.l else x.s - y.s end)"
    empty = "named_struct('v', if(i = 0, 0D, -1e300D), 'e', -1)"
    value = f"(t[e.s].v + coalesce(e.score, {worst}D))"
    best = f"aggregate({by_end}, transform(sequence(0, n), i -> {empty}), (t, e) -> transform(t, (x, i) -> if(i = e.s + e.l and {value} > x.v, named_struct('v', {value}, 'e', e.s), x)))"
    walked = edges.withColumn("t", F.expr(best))
    back = "aggregate(sequence(1, n), array(n), (p, k) -> if(p[0] = 0, p, concat(array(t[p[0]].e), p)))"
    walked = walked.withColumn("p", F.expr(back))
    path = "transform(slice(p, 1, size(p) - 1), (s, i) -> filter(edges, e -> e.s = s and e.s + e.l = p[i + 1])[0])"
    return walked.select("unit", F.expr(f"flatten(transform({path}, e -> {_spell(model)}))").alias("ids"))


def encode_units(words: DataFrame, model: Model) -> DataFrame:
    edges = lattice(words, model)
    return fold_merges(edges, model) if model.kind == "bpe" else fold_viterbi(edges, model)


def _bytes_of(ch: str, model: Model) -> list[int]:
    return [model.unknown] if model.first_byte is None else [model.first_byte + b for b in ch.encode()]


def merge_unit(unit: str, model: Model) -> list[int]:
    """The ids of one unit by the rule of fold_merges(), for units of any length; long ones with a heap."""
    rank = model.rank
    n = len(unit)
    if n <= LATTICE_CHARS:
        symbols, none = list(unit), len(rank) + 1
        get = rank.get
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], none)
        out = []
        for t in symbols:
            if t in model.text:
                out.append(model.text[t])
            else:
                out += _bytes_of(t, model)
        return out
    ends = list(range(1, n + 1))  # where the symbol that begins here ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank.get(unit[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if ends[i] != j or j >= n or ends[j] != k:
            continue
        ends[i], ends[j] = k, 0
        if k < n:
            before[k] = i
            r = rank.get(unit[i : ends[k]]) if ends[k] - i <= model.longest else None
            if r is not None:
                heapq.heappush(heap, (r, i, k, ends[k]))
        h = before[i]
        if h >= 0:
            r = rank.get(unit[h:k]) if k - h <= model.longest else None
            if r is not None:
                heapq.heappush(heap, (r, h, i, k))
    out, i = [], 0
    while i < n:
        t = unit[i : ends[i]]
        out += [model.text[t]] if t in model.text else _bytes_of(t, model)
        i = ends[i]
    return out


def best_path(unit: str, model: Model) -> list[int]:
    """The ids of one unit by the rule of fold_viterbi()."""
    n = len(unit)
    worst = min(model.scores[i] for i in model.text.values()) - 10.0
    best = [0.0] + [float("-inf")] * n
    back = [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - model.longest), e):
            i = model.text.get(unit[s:e])
            if i is None and e - s > 1:
                continue
            v = best[s] + (worst if i is None else model.scores[i])
            if v > best[e]:
                best[e], back[e] = v, s
    out, e = [], n
    while e:
        t = unit[back[e] : e]
        out[:0] = [model.text[t]] if t in model.text else _bytes_of(t, model)
        e = back[e]
    return out


def known_units(docs: DataFrame, model: Model, most: int = LATTICE_UNITS) -> dict[str, bytes]:
    """unit -> ids as little-endian uint32 bytes, from the relational lattice: at most ``most`` units."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_units(materialise(count_units(docs, model)), most).repartition(parts, "unit")  # few bytes, much work: not to be coalesced
    return {r["unit"]: array("I", r["ids"]).tobytes() for r in encode_units(frequent, model).toLocalIterator()}


class _Units(dict):
    """unit -> ids as bytes: from the lattice, else folded here and remembered."""

    def __init__(self, known: dict[str, bytes], model: Model):
        super().__init__(known)
        self.known, self.model, self.fold = known, model, merge_unit if model.kind == "bpe" else best_path

    def __missing__(self, unit: str) -> bytes:
        cut = cut_sign(unit, self.model)
        got = self[cut[0]] + self[cut[1]] if cut else array("I", self.fold(unit, self.model)).tobytes()
        if len(unit) <= LATTICE_CHARS:
            if len(self) >= len(self.known) + REMEMBERED:
                self.clear()
                self.update(self.known)
            self[unit] = got
        return got


class Lattice:
    """What is broadcast of a lattice. A worker's units hang on it, so they last from task to task and go when Spark takes the broadcast from the worker."""

    def __init__(self, known: dict[str, bytes], model: Model):
        self.known, self.model, self.held = known, model, None

    def units(self) -> _Units:
        if self.held is None:
            self.held = _Units(self.known, self.model)
        return self.held


def _encoded(docs: DataFrame, model_path: str | None, most: int, finish, schema: str) -> DataFrame:
    """Rows made by finish(batch, coded, model): coded are the ids of each text as bytes. One pass over the documents."""
    model = Model.load(model_path or tokenizer_path("piece_bpe_32k.model"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = rows.sparkSession.sparkContext.broadcast(Lattice(known_units(rows, model, most), model))

    def work(batches: Iterator) -> Iterator:
        trim()
        held = given.value.units()
        for batch in slices(batches, 200):
            yield finish(batch, [b"".join(map(held.__getitem__, units(t or ""))) for t in batch.column(1).to_pylist()], given.value.model)

    return rows.mapInArrow(work, schema)


def id_lists(coded: list[bytes]):
    """Ids as bytes to an Arrow list column."""
    import numpy as np
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(docs: DataFrame, model_path: str | None = None, most: int = LATTICE_UNITS) -> DataFrame:
    """(doc_id, ids, text) for every row of docs; null and empty texts have no ids. Other columns are ignored."""

    def finish(batch, coded, model):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([batch.column(0), id_lists(coded), batch.column(1)], names=["doc_id", "ids", "text"])

    return _encoded(docs, model_path, most, finish, "doc_id long, ids array<int>, text string")


def decoder(model: Model):
    """ids (list) -> text."""
    first = model.first_byte if model.first_byte is not None else -1
    table = [p.replace(BLANK, " ").encode() for p in model.pieces]
    if first >= 0:
        table[first : first + 256] = [bytes([b]) for b in range(256)]
    table[model.unknown] = " \u2047 ".encode()

    find = table.__getitem__

    def decode(ids) -> str:
        text = b"".join(map(find, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    return decode


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, text, decoded): the text that the ids stand for, beside what encode() gave."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model.load(model_path or tokenizer_path("piece_bpe_32k.model")))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        back = decoder(shared.value)
        for batch in slices(batches, 300):
            texts = [back(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text", "decoded"])

    return encoded.select("doc_id", "ids", "text").mapInArrow(work, "doc_id long, ids array<int>, text string, decoded string")


def sentencepiece_round_trip(docs: DataFrame, model_path: str | None = None, most: int = LATTICE_UNITS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, lossless), one row per document; null texts count as empty.

    Encoding and decoding share a pass, so a task needs one worker with one copy of the lattice's result.
    """

    def finish(batch, coded, model):
        import pyarrow as pa

        back = decoder(model)
        ids = [array("I", x) for x in coded]
        texts = [back(x) for x in ids]
        given = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(map(len, ids), pa.int32()), id_lists(coded), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                pa.array([t == (g or "") for t, g in zip(texts, given, strict=True)], pa.bool_()),
            ],
            names=["doc_id", "n_tokens", "ids", "decoded_sha256", "lossless"],
        )

    return _encoded(docs, model_path, most, finish, "doc_id long, n_tokens int, ids array<int>, decoded_sha256 string, lossless boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to it."""
    return sentencepiece_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
