"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are all words of the examples, lower-cased, and those beginnings of words that tell the labels apart (insults are
inflected; words of clean examples have no beginnings). A term's weight in a text is its damped share of the text times
its inverse document frequency over all documents, times RELEVANT for the words and beginnings that tell the labels
apart. Words that no example has count in a text's norm, as unseen ones. The examples are a bounded sample of labelled
rows; they count whole, like scored texts. The index keeps postings by term and block of examples, and each block's
largest weight of the term; blocks that can't improve the k nearest are passed over. Votes weighted by distance are
calibrated by isotonic regression on left-out examples; no document is its own neighbour.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, fold_bucket, keep_rows, materialise, slices, table

#: Bounds: examples of each label, terms that tell the labels apart, neighbours, examples a block.
EXAMPLES, TERMS, NEIGHBOURS, BLOCK = 2000, 512, 8, 128
#: Texts whose scores are begun by one matrix product.
TOGETHER = 32
#: Commonest terms whose postings lie in a table, if a share of the examples holds them.
DENSE, DENSE_SHARE = 512, 1 / 64
#: Lengths of beginnings; least examples of a term that tells the labels apart, and how many times commoner it is in label 1.
PREFIXES, LEAST_EXAMPLES, LEAST_RATIO = (4, 5, 6, 7), 3, 6.0
#: Weight of the base rate in a vote, in units of one perfect neighbour.
PRIOR = 0.3
#: How much more than other terms those count that tell the labels apart.
RELEVANT = 10.0
#: Keys of counted(): words of the text, and sum of squares of the damped shares of words that are no terms.
ALL, OTHER = -1, -2
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: The bytes of UTF-8 with a blank for each ASCII sign that WORD doesn't take.
BLANKS = bytes(b if b > 127 or WORD.match(chr(b)) else 32 for b in range(256))
CACHE = 100_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,label:int,cosine:double>>"


def terms_of(word: str, clean: set[str] | frozenset[str] = frozenset()) -> tuple[str, ...]:
    return (word,) if word in clean else (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def words_of(text: str) -> list[str]:
    """WORD.findall() of the text in lower case. ASCII signs become blanks in one step, and only pieces that hold other signs are searched for words."""
    pieces = text.lower().encode("utf-8", "surrogatepass").translate(BLANKS).decode("utf-8", "surrogatepass").split()
    if "".join(pieces).replace("_", "").isalnum():
        return pieces
    return [w for piece in pieces for w in ((piece,) if piece.isalnum() else WORD.findall(piece))]


class Vectors:
    """Sparse vectors end to end, from dicts term -> weight or arrays of both; each is read as a dict."""

    def __init__(self, rows: list):
        import numpy as np

        pairs = [v if isinstance(v, tuple) else (np.fromiter(v, np.int32, len(v)), np.fromiter(v.values(), np.float64, len(v))) for v in rows]
        self.ends = np.cumsum([len(t) for t, _ in pairs], dtype=np.int64)
        self.terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in pairs)]).astype(np.int32)
        self.weights = np.concatenate([np.zeros(0), *(w for _, w in pairs)])

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> dict[int, float]:
        if not 0 <= i < len(self.ends):
            raise IndexError(i)
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        return dict(zip(self.terms[a:b].tolist(), self.weights[a:b].tolist(), strict=True))


@dataclass
class Model:
    terms: dict[str, int]
    clean: set[str]
    idf: list[float]  # weight of each term, at the end that of a word which is none
    ids: list[int]
    labels: list[int]
    vectors: Vectors
    prior: float
    knots: list[tuple[float, float]]


def sample_examples(texts: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, list[tuple[int, int, int]]]:
    """(features, examples): at most EXAMPLES rows of (doc_id, hash of the text, label) for each label, drawn from the labels by a hash of the id; equal texts count once for a label.

    Only ids are drawn, so texts are never shuffled: the drawn ids, bounded by EXAMPLES, are broadcast to the documents.
    Features hold the word counts and shingles of whole texts; they are made where the texts are and stay with the executors.
    """
    rows = labels.filter("doc_id is not null and label in (0, 1)").distinct()
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None, []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * EXAMPLES / n))])
    chosen = rows.filter(drawn(F.xxhash64("doc_id"), share[F.col("label")]))
    found = texts.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), "text")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 50):
            words, sizes, shingles = [], [], []
            for text in batch.column(3).to_pylist():
                got = Counter(words_of(text))
                words.append(list(got))
                sizes.append(list(got.values()))
                shingles.append(shingles_of(text))
            made = (pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32())), pa.array(shingles, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "label", "h", "words", "sizes", "shingles"])

    features = materialise(found.mapInArrow(work, "doc_id long, label int, h long, words array<string>, sizes array<int>, shingles array<long>"))
    by: dict[int, list] = {}
    for r in features.groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")).collect():
        by.setdefault(r["label"], []).append((r["h"], r["doc_id"]))
    return features, [(i, h, k) for k in sorted(by) for h, i in sorted(by[k])[:EXAMPLES]]


def shingles_of(text: str) -> list[int]:
    """Hashes of a quarter of a whole text's five-word shingles, chosen by hash."""
    words = text.split()
    hashes = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
    return sorted({h for h in hashes if h % 4 == 0} or hashes)


def at_places(features: DataFrame, examples: list[tuple[int, int, int]], **more: list[bool]) -> DataFrame:
    """Features of the examples with their position, and further columns by position. Repeated rows stay: what is made of them may not depend on their number."""
    rows = [(*e, k, *(x[k] for x in more.values())) for k, e in enumerate(examples)]
    kind = "doc_id long, h long, label int, place int" + "".join(f", {name} boolean" for name in more)
    return features.join(F.broadcast(features.sparkSession.createDataFrame(rows, kind)), ["doc_id", "h", "label"])


def counted(text: str, terms: dict[str, int], clean: set[str], cache: dict) -> dict[int, float]:
    """Frequencies of terms in a whole text, at ALL its number of words, at OTHER what its other words add to the norm. cache: word -> its terms, bounded."""
    return counted_words(Counter(words_of(text)), terms, clean, cache)


def counted_words(words: Counter, terms: dict[str, int], clean: set[str], cache: dict) -> dict[int, float]:
    total = words.total()
    got: dict[int, float] = {ALL: total}
    others: list[int] = []  # frequencies of words that are no terms
    get = cache.get
    for word, n in words.items():
        known = get(word)
        if known is None:
            known = tuple(terms[x] for x in terms_of(word, clean) if x in terms)
            if word not in terms:
                known = (OTHER, *known)
            if len(known) == 1:  # most words are one term or none
                known = known[0]
            if len(cache) < CACHE and len(word) < 64:
                cache[word] = known
        if known.__class__ is int:
            if known >= 0:
                got[known] = got.get(known, 0) + n
            else:
                others.append(n)
            continue
        for x in known:
            if x == OTHER:
                others.append(n)
            else:
                got[x] = got.get(x, 0) + n
    got[OTHER] = sum(m * math.log1p(100 * n / total) ** 2 for n, m in Counter(others).items())
    return got


class WordCodes:
    """The terms of texts' words, looked up for some texts at once in arrays: a table of the terms' 64-bit hashes with open addressing.

    Of two words with one hash, the later would pass for the earlier; for a million words and as many terms that is met once in ten million such corpora.
    Only words that begin like one of the beginnings among the terms, which are TERMS at most, are looked at one by one; a bounded number of them is remembered.
    """

    def __init__(self, terms: dict[str, int], clean: set[str]):
        import numpy as np

        self.terms, self.clean, self.known = terms, clean, {}
        self.starts = {t[: PREFIXES[0]] for t in terms if t.endswith("*")}
        self.begins = np.zeros(len(terms) - OTHER, bool)  # of each term, whether it begins like that; the last ones stand for codes under 0
        self.begins[[k for w, k in terms.items() if w[: PREFIXES[0]] in self.starts]] = True
        self.begins[OTHER] = bool(self.starts)
        self.last = (1 << (2 * len(terms)).bit_length()) - 1  # under half of the places are taken
        self.keys, self.codes_at = np.zeros(self.last + 1, np.int64), np.full(self.last + 1, OTHER, np.int32)
        keys, codes = np.fromiter(map(hash, terms), np.int64, len(terms)), np.fromiter(terms.values(), np.int32, len(terms))
        at = keys & self.last
        while len(at):
            free = self.codes_at[at] == OTHER
            self.keys[at[free]], self.codes_at[at[free]] = keys[free], codes[free]
            left = self.codes_at[at] != codes
            keys, codes, at = keys[left], codes[left], (at[left] + 1) & self.last

    def terms_of(self, word: str) -> list[int]:
        known = self.known.get(word)
        if known is None:
            known = [self.terms[x] for x in terms_of(word, self.clean) if x in self.terms]
            if word not in self.terms:
                known.insert(0, OTHER)
            if len(self.known) < CACHE and len(word) < 64:
                self.known[word] = known
        return known

    def codes(self, words: list[str]):
        """(code of each word, [(place, its terms)] of words of several terms): its term, or OTHER for a word that is none, or OTHER - 1 for a word of several, which may hold OTHER too."""
        import numpy as np

        keys = np.fromiter(map(hash, words), np.int64, len(words))
        at = keys & self.last
        codes = self.codes_at[at]
        left = np.flatnonzero((self.keys[at] != keys) & (codes != OTHER))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            codes[left] = self.codes_at[at[left]]
            left = left[(self.keys[at[left]] != keys[left]) & (codes[left] != OTHER)]
        several = []
        for k in np.flatnonzero(self.begins[codes]).tolist():
            if words[k][: PREFIXES[0]] in self.starts and len(known := self.terms_of(words[k])) > 1:
                several.append((k, known))
        codes[[k for k, _ in several]] = OTHER - 1
        return codes, several

    def queries(self, texts: list[str], idf) -> list[tuple]:
        """weighed(counted()) of whole texts, most of it without a loop."""
        import numpy as np

        counts = [Counter(words_of(t)) for t in texts]
        codes_of, several_of = self.codes(list(chain.from_iterable(counts)))
        sizes_of = np.fromiter(chain.from_iterable(c.values() for c in counts), float, len(codes_of))
        out, begin, at = [], 0, 0
        for words in counts:
            end, total = begin + len(words), words.total()
            codes, sizes = codes_of[begin:end], sizes_of[begin:end]
            others = float((np.log1p(100 * sizes[codes == OTHER] / max(1, total)) ** 2).sum())
            alone = codes >= 0
            terms, n = codes[alone].astype(np.int64), sizes[alone]
            more: dict[int, float] = {}
            while at < len(several_of) and several_of[at][0] < end:
                k, known = several_of[at]
                for x in known:
                    if x == OTHER:
                        others += math.log1p(100 * float(sizes_of[k]) / total) ** 2
                    else:
                        more[x] = more.get(x, 0.0) + float(sizes_of[k])
                at += 1
            begin = end
            if more:
                terms, n = np.append(terms, list(more)), np.append(n, list(more.values()))
            if len(terms):
                weights = np.log1p(100 * n / total) * idf[terms]
                n = weights / math.sqrt(float(weights @ weights) + others * float(idf[-1]) ** 2)
            out.append((terms, n))
        return out

    def held(self, texts: list[str]):
        """The distinct terms of each of some whole texts, end to end."""
        import numpy as np

        words = [set(words_of(t)) for t in texts]
        codes, several = self.codes(list(chain.from_iterable(words)))
        text = np.searchsorted(np.cumsum(list(map(len, words))), [k for k, _ in several], side="right").tolist()
        more = {(i, x) for i, (_, known) in zip(text, several, strict=True) for x in known if x != OTHER}
        return np.append(codes[codes >= 0], np.fromiter((x for _, x in more), np.int64, len(more)))


def weighed(counts: dict[int, float], idf):
    """vector() as arrays (terms, weights); idf as an array."""
    import numpy as np

    n = len(counts)
    terms, sizes = np.fromiter(counts, np.int64, n), np.fromiter(counts.values(), float, n)
    keep = terms >= 0
    terms, sizes = terms[keep], sizes[keep]
    if not len(terms):
        return terms, sizes
    weights = np.log1p(100 * sizes / counts[ALL]) * idf[terms]
    return terms, weights / math.sqrt(float(weights @ weights) + counts[OTHER] * float(idf[-1]) ** 2)


def vector(counts: dict[int, float], idf: list[float]) -> dict[int, float]:
    """Unit TF-IDF vector of a text, frequencies as damped shares of it; empty if it has no term. What isn't a term lengthens the vector before it is made one long."""
    total = counts[ALL]
    share = {n: math.log1p(100 * n / total) for n in {n for k, n in counts.items() if k >= 0}}
    got = {k: share[n] * idf[k] for k, n in counts.items() if k >= 0}
    if not got:
        return {}
    norm = math.sqrt(sum(x * x for x in got.values()) + counts[OTHER] * idf[-1] ** 2)
    return {k: x / norm for k, x in got.items()}


def distinct_examples(features: DataFrame, examples: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without near copies: an example goes if earlier ones hold over half of its shingles, i.e. if fewer than half appear in it first."""
    if not examples:
        return []
    placed = at_places(features, examples)
    sizes = {r["place"]: r["n"] for r in placed.select("place", F.size("shingles").alias("n")).distinct().collect()}
    first = placed.select("place", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("place").alias("place"))
    fresh = {r["place"]: r["n"] for r in first.groupBy("place").agg(F.count("*").alias("n")).collect()}
    return [e for k, e in enumerate(examples) if 2 * (sizes[k] - fresh.get(k, 0)) <= sizes[k]]


def choose_terms(features: DataFrame | None, examples: list[tuple[int, int, int]]) -> tuple[dict[str, int], int, set[str], list[int]]:
    """(terms, how many tell the labels apart, clean words, positions of the examples that were measured).

    First come the TERMS words and beginnings with the largest chi-square among those of label 1, then all other words of
    the examples by the alphabet. Half of the clean examples say which words are clean; beginnings are measured on the
    other half, where words are as new as in any text.
    """
    clean_at = [i for i, e in enumerate(examples) if e[2] == 0]
    told = set(clean_at[::2])
    measured = [i for i in range(len(examples)) if i not in told]
    sizes = [sum(examples[i][2] == k for i in measured) for k in (0, 1)]
    if not sizes[1]:
        return {}, 0, set(), measured
    placed = at_places(features, examples, told=[i in told for i in range(len(examples))])
    words = placed.select("place", "label", "told", F.explode("words").alias("word"))
    clean = words.filter("told").select("word").distinct()
    starts = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    made = F.when(F.col("_clean"), F.array("word")).otherwise(F.array_compact(F.array("word", *starts)))
    rows = words.filter("not told").join(clean.withColumn("_clean", F.lit(True)), "word", "left")
    seen = rows.select("place", "label", F.explode(made).alias("term")).distinct().groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    seen = seen.filter((F.col("a") >= LEAST_EXAMPLES) & (F.col("a") * sizes[0] >= LEAST_RATIO * (F.col("b") + 0.5) * sizes[1]))
    a, b, c, d = F.col("a"), F.col("b"), sizes[1] - F.col("a"), sizes[0] - F.col("b")
    chi = F.lit(sum(sizes)) * (a * d - b * c) * (a * d - b * c) / F.greatest(F.lit(1), (a + b) * (c + d) * sizes[0] * sizes[1])
    terms = {r["term"]: i for i, r in enumerate(seen.orderBy(F.desc(chi), "term").limit(TERMS).collect())}
    apart = len(terms)
    known = [t[:-1] for t in terms if t.endswith("*")]
    like = [F.substring("word", 1, n).isin(known) for n in PREFIXES]
    clean_words = {r["word"] for r in clean.filter(like[0] | like[1] | like[2] | like[3]).collect()} if known else set()
    every = words.select("word").distinct()
    for word in sorted(w for batch in every.toArrow().column("word").chunks for w in batch.to_pylist() if w not in terms):
        terms[word] = len(terms)
    return terms, apart, clean_words, measured


def example_counts(features: DataFrame, examples: list[tuple[int, int, int]], terms: dict[str, int], clean: set[str]) -> list[tuple]:
    """counted() of each example's whole text, as arrays of keys and values."""
    given = features.sparkSession.sparkContext.broadcast((terms, clean))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache: dict = {}
        for batch in slices(batches, 50):
            got = [counted_words(Counter(dict(zip(w, n, strict=True))), *given.value, cache) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            lists = [pa.array([np.fromiter(f(g), t).tobytes() for g in got], pa.binary()) for f, t in ((dict.keys, np.int32), (dict.values, np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["place", "terms", "n"])

    import numpy as np

    rows = at_places(features, examples).select("place", "words", "sizes").mapInArrow(work, "place int, terms binary, n binary").toArrow()
    by = {p: (t, n) for p, t, n in zip(*(rows.column(c).to_pylist() for c in ("place", "terms", "n")), strict=True)}
    return [(np.frombuffer(by[k][0], np.int32), np.frombuffer(by[k][1], np.float64)) for k in range(len(examples))]


def document_frequencies(docs: DataFrame, terms: dict[str, int], clean: set[str]) -> tuple[int, list[int]]:
    """Number of documents and, for each term, of those that hold it; over all documents, summed in each task before the shuffle."""
    given = docs.sparkSession.sparkContext.broadcast((terms, clean))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, clean = given.value
        df, n, codes = np.zeros(len(known), np.int64), 0, WordCodes(known, clean)
        for batch in slices(batches, 4 * TOGETHER):
            n += batch.num_rows
            df += np.bincount(codes.held([t or "" for t in batch.column(0).to_pylist()]), minlength=len(known))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return got.get(-1, 0), [got.get(i, 0) for i in range(len(terms))]


def spread(starts, sizes):
    """All places of ranges that start and are as long as said, end to end."""
    import numpy as np

    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class BlockMaxIndex:
    """Postings (example, weight) by term, in blocks of BLOCK examples; of each term and block the largest weight. search() is exact.

    The postings of the commonest terms lie in a table, those of all others in lists. What the table gives an example is
    a lower bound of its score; blocks whose upper bound is under the k-th largest lower bound are passed over.
    """

    def __init__(self, vectors, n_terms: int):
        import numpy as np

        vectors = vectors if isinstance(vectors, Vectors) else Vectors(list(vectors))
        self.np, self.n = np, len(vectors)
        self.blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n), np.diff(vectors.ends, prepend=0)) if self.n else np.zeros(0, np.int64)
        held = np.bincount(vectors.terms, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:DENSE]
        common = common[held[common] >= max(1, DENSE_SHARE * self.n)]
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[vectors.terms] >= 0
        self.table = np.zeros((len(common), self.blocks * BLOCK))
        self.table[self.row[vectors.terms[dense]], example[dense]] = vectors.weights[dense]
        self.table_most = self.table.reshape(len(common), self.blocks, BLOCK).max(axis=2, initial=0.0)
        order = np.flatnonzero(~dense)  # by example already
        order = order[np.argsort(vectors.terms[order], kind="stable")]
        self.example, self.weight, term = example[order].astype(np.int32), vectors.weights[order], vectors.terms[order]
        block = self.example // BLOCK
        new = np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])] if len(term) else np.zeros(0, bool)
        self.first = np.flatnonzero(new).astype(np.int32)  # of each term and block, its first posting
        self.size = np.diff(np.append(self.first, len(term))).astype(np.int32)
        self.block = block[self.first].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, self.first) if len(term) else np.zeros(0)
        self.of_term = np.searchsorted(term[self.first], np.arange(n_terms + 1))

    def arrays(self, query):
        return query if isinstance(query, tuple) else (self.np.fromiter(query, self.np.int64, len(query)), self.np.fromiter(query.values(), float, len(query)))

    def from_table(self, queries: list):
        """(lower bounds of all examples' scores, upper bounds of the table's part by block), a row a query: one matrix product for many."""
        np = self.np
        whole = np.zeros((len(queries), len(self.table)))
        for at, query in enumerate(queries):
            terms, weights = self.arrays(query)
            row = self.row[terms]
            whole[at, row[row >= 0]] = weights[row >= 0]
        return whole @ self.table, whole @ self.table_most

    def search(self, query: dict[int, float] | tuple, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine over 0, ties by position. query: term -> weight, or arrays of both. skip: an example to leave out."""
        return self.search_many([query], k, [skip])[0]

    def search_many(self, queries: list, k: int, skips: list[int]) -> list[list[tuple[float, int]]]:
        """search() for some queries at once: bounds, blocks and scores are arrays over all of them."""
        np, n, blocks = self.np, self.n, self.blocks
        if not n or not queries:
            return [[] for _ in queries]
        m = len(queries)
        base, most = self.from_table(queries)
        scores = np.ascontiguousarray(base[:, :n])
        for q, skip in enumerate(skips):
            if 0 <= skip < n:
                scores[q, skip] = -1.0
        pairs = [self.arrays(q) for q in queries]
        of = np.repeat(np.arange(m), [len(t) for t, _ in pairs])
        terms, weights = np.concatenate([t for t, _ in pairs]).astype(np.int64), np.concatenate([w for _, w in pairs])
        rare = self.row[terms] < 0
        of, terms, weights = of[rare], terms[rare], weights[rare]
        begin = self.of_term[terms]
        held = self.of_term[terms + 1] - begin
        at, by, of = spread(begin, held), np.repeat(weights, held), np.repeat(of, held)
        cell = of * blocks + self.block[at]
        bounds = np.bincount(cell, by * self.most[at], m * blocks).reshape(m, blocks) + most
        least = np.maximum(1e-12, np.partition(scores, -k, axis=1)[:, -k] - 1e-9) if n > k else np.full(m, 1e-12)
        wanted = bounds >= least[:, None]
        use = np.flatnonzero(wanted.ravel()[cell])
        at, by, of = at[use], by[use], of[use]
        size = self.size[at]
        places = spread(self.first[at], size)
        found = np.bincount(np.repeat(of * n, size) + self.example[places], self.weight[places] * np.repeat(by, size), m * n)
        scores = np.round(scores + found.reshape(m, n), 12)
        scores[~np.repeat(wanted, BLOCK, axis=1)[:, :n]] = 0.0
        for q, skip in enumerate(skips):
            if 0 <= skip < n:
                scores[q, skip] = 0.0
        least = np.maximum(1e-12, np.partition(scores, -k, axis=1)[:, -k]) if n > k else np.full(m, 1e-12)
        where, example = np.nonzero(scores >= least[:, None])
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        for q, s, i in zip(where.tolist(), scores[where, example].tolist(), example.tolist(), strict=True):
            out[q].append((-s, i))
        return [[(-s, i) for s, i in sorted(x)[:k]] for x in out]


def vote(found: list[tuple[float, int]], labels: list[int], prior: float) -> float:
    weights = [(c**2, labels[i]) for c, i in found]
    return (PRIOR * prior + sum(w * y for w, y in weights)) / (PRIOR + sum(w for w, _ in weights))


def isotonic(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Pool adjacent violators: knots (vote, share of label 1), rising in both."""
    pools: list[list[float]] = []
    for x in sorted({p[0] for p in points}):
        ys = [y for v, y in points if v == x]
        pools.append([x, x, sum(ys), len(ys)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            top = pools.pop()
            pools[-1] = [pools[-1][0], top[1], pools[-1][2] + top[2], pools[-1][3] + top[3]]
    return [k for a, b, y, n in pools for k in ((a, (y + 0.5 * a) / (n + 0.5)), (b, (y + 0.5 * b) / (n + 0.5)))]


def calibrate(x: float, knots: list[tuple[float, float]]) -> float:
    if not knots:
        return x
    import bisect

    at = bisect.bisect_left(knots, (x, -1.0))
    if at == 0:
        return knots[0][1]
    if at == len(knots):
        return knots[-1][1]
    (x0, y0), (x1, y1) = knots[at - 1], knots[at]
    return y0 if x1 == x0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", label: str = "toxic") -> Model:
    """Labels are taken only from rows where ``learn`` holds (over the column doc_id). Repeated label rows count once each; null labels never.

    Document frequencies are counted over all docs. Jobs run while this is called; without an example of label 1 the model scores everything alike.
    """
    import numpy as np

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    if learn is not None:
        given = given.filter(learn)
    features, examples = sample_examples(texts, given)
    prior = sum(e[2] for e in examples) / len(examples) if examples else 0.0
    examples = distinct_examples(features, examples)
    terms, apart, clean, measured = choose_terms(features, examples)
    if not apart:
        return Model({}, set(), [], [], [], Vectors([]), prior, [])
    n, df = document_frequencies(texts, terms, clean)
    idf = [(math.log((1 + n) / (1 + x)) + 1) * (RELEVANT if k < apart else 1.0) for k, x in enumerate(df)] + [math.log(1 + n) + 1]
    made = []  # as arrays: a dict for every example at once would be the most that the driver holds
    for keys, values in example_counts(features, examples, terms, clean):
        v = vector(dict(zip(keys.tolist(), values.tolist(), strict=True)), idf)
        made.append((np.fromiter(v, np.int32, len(v)), np.fromiter(v.values(), np.float64, len(v))))
    position = {k: j for j, k in enumerate(k for k, v in enumerate(made) if len(v[0]))}
    ids, ys = [examples[k][0] for k in position], [examples[k][2] for k in position]
    vectors = Vectors([made[k] for k in position])
    index, points = BlockMaxIndex(vectors, len(terms)), []
    for at in range(0, len(measured), TOGETHER):
        some = measured[at : at + TOGETHER]
        found = index.search_many([made[k] for k in some], NEIGHBOURS, [position.get(k, -1) for k in some])
        points += [(vote(f, ys, prior), examples[k][2]) for k, f in zip(some, found, strict=True)]
    return Model(terms, clean, idf, ids, ys, vectors, prior, isotonic(points))


def judge_of(m: Model):
    """(texts, ids) -> [(score, neighbours)]; an example isn't its own neighbour."""
    import numpy as np

    index, codes, idf = BlockMaxIndex(m.vectors, len(m.terms)), WordCodes(m.terms, m.clean), np.array(m.idf)
    own = {i: k for k, i in enumerate(m.ids)}

    def judge(texts: list, ids: list) -> list[tuple[float, list[tuple[float, int]]]]:
        out = []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            if not m.terms:
                out += [(min(1.0, max(0.0, calibrate(vote([], m.labels, m.prior), m.knots))), [])] * len(some)
                continue
            queries = codes.queries([t or "" for t in some], idf)
            for found in index.search_many(queries, NEIGHBOURS, [own.get(i, -1) for i in ids[at : at + TOGETHER]]):
                out.append((min(1.0, max(0.0, calibrate(vote(found, m.labels, m.prior), m.knots))), found))
        return out

    return judge


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document, repeated rows included. Texts without a known term, empty and null ones too, get the calibrated base vote and no evidence.

    An example is judged by the others. Rows without id have no fold of their own (that of the text ''). Other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES and their words

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = given.value
        judge = judge_of(m)
        evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in slices(batches, 2000):
            scores, proof = [], []
            for value, found in judge(batch.column(2).to_pylist(), batch.column(0).to_pylist()):
                scores.append(value)
                proof.append([{"doc_id": m.ids[i], "label": m.labels[i], "cosine": c} for c, i in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(proof, evidence)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_bucket(doc_id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that aren't predicted toxic; a filter on each row alone, without a join. Null texts and ids, repeated rows and columns of any name pass through it."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        judge = judge_of(given.value)
        return lambda texts, ids: [value < THRESHOLD for value, _ in judge(texts.to_pylist(), ids.to_pylist())]

    return keep_rows(docs, [text, doc_id], task)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), fold_bucket("doc_id", 3) != 1))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
