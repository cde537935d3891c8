"""Language id by compression: the language whose dictionary makes a text smallest is its language.

One raw-content zstandard dictionary per language is cut from a bounded sample of labelled documents. A text is
encoded, in blocks of ``BLOCK`` bytes so that it can't learn from itself, against every dictionary; the sizes
are summed over the whole text. The margin between the best two decides the score, and a narrow one sets ``rejected``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, fold_bucket, slices, table, utf8

#: Bound of the training sample: so many slices of so many characters for each language, and so many languages.
SAMPLE_SLICES, SLICE_CHARS, LABELS = 192, 600, 1024
BLOCK, SHORT = 512, 160
#: A margin under this share of the second-best size is called narrow.
NARROW = 0.01
UNKNOWN = "und"
#: Letters, and a few number signs that isalpha() then tells apart.
LETTER = re.compile(r"[^\W\d_]")
#: ASCII signs and digits say nothing of a language: runs of them become one blank.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))
BLANKS = re.compile(rb"  +")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, margin double"


def fit_dictionaries(docs: DataFrame, text: str = "text", label: str = "lang", eligible: Column | None = None) -> dict[str, bytes]:
    """Label -> dictionary, from at most SAMPLE_SLICES distinct texts, one slice of each, for each of the LABELS labels with most rows.

    Texts are drawn by a hash of themselves, so equal texts of a label are drawn once and nothing depends on order; the
    share that is drawn follows from the number of distinct texts (estimated over all eligible rows), so a label with
    fewer than SAMPLE_SLICES of them gives them all, however often they repeat. Null labels, null texts and texts
    without a letter teach nothing. Two jobs run while this is called.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(label).alias("l"), (eligible if eligible is not None else F.lit(True)).alias("ok"))
    rows = rows.filter("ok and l is not null and t is not null").filter(F.col("t").rlike(r"\p{L}")).withColumn("n", F.length("t")).withColumn("h", F.xxhash64("t"))
    most = rows.groupBy("l").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("n")).orderBy(F.desc("rows"), "l").limit(LABELS)
    counts = {r["l"]: r["n"] for r in most.collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * SAMPLE_SLICES / n))])
    chosen = rows.filter(drawn(F.col("h"), share[F.col("l")]))
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.col("n") - SLICE_CHARS)).cast("int") + 1
    cut = chosen.select("l", "h", F.substring("t", start, F.lit(SLICE_CHARS)).alias("s")).groupBy("l", "h").agg(F.max("s").alias("s"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in cut.collect():
        found.setdefault(r["l"], []).append((r["h"], r["s"]))
    return {k: "\n".join(s for _, s in sorted(v)[:SAMPLE_SLICES]).encode() for k, v in sorted(found.items())}


def folded(raw: bytes) -> bytes:
    return BLANKS.sub(b" ", raw.decode("utf-8", "replace").lower().encode().translate(FOLD))


def classifier(dictionaries: dict[str, bytes]):
    """text bytes -> (label, score, rejected, margin)."""
    import zstandard as zs

    labels = sorted(dictionaries)
    coders = []
    # matches of three bytes on: words are built from syllables
    how = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_GREEDY, min_match=3, window_log=18, hash_log=16, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    for k in labels:
        d = zs.ZstdCompressionDict(folded(dictionaries[k]), dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        coders.append(zs.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def classify(raw: bytes) -> tuple[str, float, bool, float]:
        if not labels or not any(m[0].isalpha() for m in LETTER.finditer(raw.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0, True, 0.0
        raw = folded(raw)
        if len(raw) < SHORT:  # the coder doesn't store small savings of small blocks; repeats make them visible
            raw *= -(-SHORT // len(raw))
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in coders]
        best = min(range(len(labels)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / max(1, second)
        # bits saved against each other language, tempered as neighbouring blocks aren't independent
        weights = sum(math.exp(-min(60.0, (s - sizes[best]) * 8 * 0.1)) for s in sizes)
        return labels[best], 1.0 / weights, margin < NARROW, margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document. Null texts and texts without a letter: 'und', score 0, rejected; so is every text if nothing could be learned.

    Ties go to the alphabetically first label; equal texts get equal answers; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: labels x SAMPLE_SLICES x SLICE_CHARS

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classify = classifier(given.value)
        for batch in slices(batches, 2000):
            got = [classify(x) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64())))],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected", "margin"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_bucket(doc_id, folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_dictionaries(docs, eligible=fold_bucket("doc_id", 4) != 2))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
