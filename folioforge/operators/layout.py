"""Layout: header and footer filters, table zones and their anti-joins, columns, paragraphs, OCR plans.

Blocks have doc_id, page, block_idx, type, x0, y0, x1, y1, text, page_width, page_height; zones doc_id, page, x0, y0, x1, y1.
Everything is keyed by (doc_id, page), so a page's rows meet in one task and no task holds more than pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import geometry as G
from ..functions import text as X

PAGE = ["doc_id", "page"]
# Thresholds of zones, and the words that titles and captions of tables begin with or hold.
#: Share of a block that a zone may cover before the block is dropped; titles and captions may overlap more.
OVERLAP, OVERLAP_TITLE = 0.15, 0.5
#: A block this large or long is kept although it lies in a zone.
LARGE_AREA, LONG_TEXT = 5000, 100
TITLE_WORDS = ["Tabel", "Table", "Figure", "Gambar", "Chart", "Grafik"]
CAPTION_WORDS = ["source:", "sumber:", "note:", "catatan:", "*", "keterangan:"]


def margin_filter(blocks: DataFrame, header_y: float, footer_y: float) -> DataFrame:
    centre = (F.col("y0") + F.col("y1")) / 2
    return blocks.filter((centre > header_y) & (centre < footer_y))


def edge_filter(blocks: DataFrame, edge: float = 50.0) -> DataFrame:
    """Text that begins within ``edge`` of a page's top or bottom stays only if it looks like content."""
    extreme = (F.col("y0") < edge) | (F.col("y0") > F.col("page_height") - edge)
    keep = X.important_header(F.trim("text"), F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("page_width"))
    return blocks.filter((F.col("type") != "text") | ~extreme | keep)


def zones(tables: DataFrame, margin: float = 5.0) -> DataFrame:
    z = G.padded(G.box(), F.col("page_width"), F.col("page_height"), margin)
    return tables.select(*PAGE, *(c.alias(n) for c, n in zip(z, ("x0", "y0", "x1", "y1"), strict=True)))


def is_table_title(text: Column, y1: Column, zone_top: Column) -> Column:
    starts = F.lit(False)
    for w in TITLE_WORDS:
        starts = starts | text.startswith(w)
    return (y1 <= zone_top + 5) & (F.length(text) < 150) & (X.is_upper(text) | X.is_title(text) | text.contains(":") | starts)


def is_table_caption(text: Column, y0: Column, zone_bottom: Column) -> Column:
    says = F.lit(False)
    for w in CAPTION_WORDS:
        says = says | F.lower(text).contains(w)
    return (F.length(text) > 0) & (y0 >= zone_bottom - 5) & ((F.length(text) < 200) | says)


def zone_verdicts(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks with _drop (some zone of the page covers too much), _inside (some zone holds it) and _alone (the page would lose every block)."""
    z = areas.select(*PAGE, *(F.col(c).alias(f"z_{c}") for c in ("x0", "y0", "x1", "y1")), F.lit(True).alias("_zone"))
    mine, zone = G.box(), G.box("z_")
    covered = G.overlap_ratio(mine, zone)
    text = F.coalesce(F.col("text"), F.lit(""))
    labelled = is_table_title(text, F.col("y1"), F.col("z_y0")) | is_table_caption(text, F.col("y0"), F.col("z_y1"))
    large = (G.area(mine) > LARGE_AREA) | (F.length(text) > LONG_TEXT)
    # a page without zones has a row without one, which covers nothing
    dropped = F.col("_zone") & (covered > F.when(labelled, OVERLAP_TITLE).otherwise(OVERLAP)) & ~large
    # one pass over (block, zone) pairs of a page gives both verdicts
    marked = blocks.join(z, PAGE, "left").groupBy(*blocks.columns).agg(
        F.bool_or(F.coalesce(dropped, F.lit(False))).alias("_drop"), F.bool_or(F.coalesce(G.contains(zone, mine), F.lit(False))).alias("_inside")
    )
    alone = F.min(F.col("_drop").cast("int")).over(Window.partitionBy(*PAGE)) == 1
    return marked.withColumn("_alone", alone)


def outside_zones(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks that no zone of their page covers too much; pages that would lose everything only lose blocks inside a zone. Repeated rows count once."""
    return zone_verdicts(blocks, areas).filter(F.when(F.col("_alone"), ~F.col("_inside")).otherwise(~F.col("_drop"))).select(*blocks.columns)


def detect_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, layout, boundary): two columns if over three blocks lie on either side of the middle with a gap of a twentieth of the width."""
    x = (F.col("x0") + F.col("x1")) / 2
    middle = F.col("page_width") / 2
    per = blocks.filter("type = 'text'").groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.count_if(x < middle).alias("n_left"), F.count_if(x >= middle).alias("n_right"),
        F.max(F.when(x < middle, x)).alias("left_max"), F.min(F.when(x >= middle, x)).alias("right_min"), F.max("page_width").alias("width"),
    )
    two = (F.col("n") >= 5) & (F.col("n_left") > 3) & (F.col("n_right") > 3) & (F.col("right_min") - F.col("left_max") > 0.05 * F.col("width"))
    two = F.coalesce(two, F.lit(False))
    return per.select(*PAGE, F.when(two, "two_column").otherwise("single").alias("layout"), F.when(two, F.col("width") / 2).alias("boundary"))


def detect_columns_kmeans(blocks: DataFrame, least_blocks: int = 10, least_std: float = 50.0, rounds: int = 10) -> DataFrame:
    """One-dimensional 2-means on x centres for each page, as a fold over sorted centres: the best of all cuts, which is what 2-means aims at."""
    x = ((F.col("x0") + F.col("x1")) / 2).alias("x")
    w = Window.partitionBy(*PAGE).orderBy("x")
    whole = Window.partitionBy(*PAGE)
    cut = blocks.filter("type = 'text'").select(*PAGE, x).select(
        *PAGE, "x", F.row_number().over(w).alias("k"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.count("*").over(whole).alias("n"), F.sum("x").over(whole).alias("t"), F.stddev_pop("x").over(whole).alias("sd"), F.lead("x").over(w).alias("next")
    )
    gain = F.col("s") * F.col("s") / F.col("k") + (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - F.col("k"))
    best = cut.filter("k < n").groupBy(*PAGE).agg(F.max_by((F.col("x") + F.col("next")) / 2, gain).alias("at"), F.max("n").alias("n"), F.max("sd").alias("sd"))
    two = (F.col("n") >= least_blocks) & (F.col("sd") >= least_std)
    return best.select(*PAGE, F.when(two, "two_column").otherwise("single").alias("layout"), F.when(two, F.col("at")).alias("boundary"))


def assign_columns(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks with ``column``: single, left or right."""
    centre = (F.col("x0") + F.col("x1")) / 2
    side = F.when(F.coalesce(F.col("layout"), F.lit("single")) == "single", "single").when(centre < F.col("boundary"), "left").otherwise("right")
    return blocks.join(columns, PAGE, "left").withColumn("column", side).drop("layout", "boundary")


def number_units(blocks: DataFrame) -> DataFrame:
    """unit_id and anchor from document, page, column and place in it."""
    k = F.row_number().over(Window.partitionBy(*PAGE, "column").orderBy("y0", "x0", "block_idx")) - 1
    tag = F.concat_ws("_", "doc_id", F.concat(F.lit("p"), "page"), "column", k.cast("string"))
    return blocks.withColumn("ordinal", k).withColumn("unit_id", tag).withColumn("anchor", F.concat(F.lit("#"), tag))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, column, paragraph, text, x0, y0, x1, y1): blocks of a column merged downwards.

    A true fold: what a block is compared with is the box that has grown so far. Merged if the gap is under 20, over
    seven tenths of the common width overlap, heights differ by less than half their mean, unless the text so far
    ends a sentence and the gap exceeds three tenths of it. Blocks come sorted, one by one, and only the open paragraph is
    held, so a column's time grows with its blocks. A block with a null in its box merges with nothing; a null text makes
    its paragraph's text null.
    """
    key, box = [*PAGE, "column"], ["y0", "x0", "block_idx", "x1", "y1", "text"]
    rows = blocks.select(*key, "y0", "x0", "block_idx", F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), "text").withColumn("y0", F.col("y0").cast("double")).withColumn("x0", F.col("x0").cast("double"))
    schema = StructType([*(rows.schema[c] for c in key), StructField("paragraph", IntegerType()), StructField("text", StringType()), *(StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1"))])
    ordered = rows.repartition(*key).sortWithinPartitions(*key, *(F.asc_nulls_first(c) for c in box))

    def joins(p: list, b: tuple) -> bool:
        """Whether block (y0, x0, x1, y1, text) goes on paragraph [text, x0, y0, x1, y1]."""
        if None in p[1:] or None in b[:4]:
            return False
        text, px0, py0, px1, py1 = p
        y0, x0, x1, y1, _ = b
        gap, mean = y0 - py1, ((py1 - py0) + (y1 - y0)) / 2
        width = max(px1, x1) - min(px0, x0)
        if not (gap < 20 and width and (min(px1, x1) - max(px0, x0)) / width > 0.7 and abs((y1 - y0) - (py1 - py0)) < mean * 0.5):
            return False
        return not gap > mean * 0.3 or text is not None and re.search(r"[.!?](?:\r\n|[\n\r\u0085\u2028\u2029])?\Z", text.strip(" ")) is None

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema]
        place, number, held = None, 0, None
        for batch in batches:
            out = []
            for *where, y0, x0, _, x1, y1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = (y0, x0, x1, y1, text)
                if where == place and joins(held, b):
                    held = [None if held[0] is None or text is None else f"{held[0]} {text}", min(held[1], x0), min(held[2], y0), max(held[3], x1), max(held[4], y1)]
                    continue
                if held is not None:
                    out.append((*place, number, *held))
                number = number + 1 if where == place else 0
                place, held = where, [text, x0, y0, x1, y1]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in enumerate(kinds)], names=schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*place, number, *held), kinds, strict=True)], names=schema.names)

    return ordered.mapInArrow(work, schema)


def scanned_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, scanned): images cover over 70 % of the page, or two figures and under three texts."""
    share = F.sum(F.when(F.col("type") == "figure", G.area(G.box())).otherwise(0.0)) / F.max(F.col("page_width") * F.col("page_height"))
    texts, figures = F.count_if(F.col("type") == "text"), F.count_if(F.col("type") == "figure")
    return blocks.groupBy(*PAGE).agg(((share > 0.7) | ((texts < 3) & (figures >= 2))).alias("scanned"))


def ocr_eligible(y_centre: Column, height: Column, area_ratio: Column) -> Column:
    """Figures worth reading: in the top fifth, or small ones in the middle."""
    y = y_centre / height
    return (y < 0.2) | ((y > 0.1) & (y < 0.9) & (area_ratio < 0.3))


def ocr_plan(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ocr_plan) from (doc_id, page, n_text, n_tables, simple_chars, scanned): one plan a page, full scans first."""
    plan = F.when(F.col("scanned"), "full_scan").when((F.col("n_text") < 2) & (F.col("n_tables") > 0) & (F.col("simple_chars") > 500), "backup").when((F.col("n_text") == 0) & (F.col("n_tables") == 0), "page").otherwise("none")
    return pages.select(*PAGE, plan.alias("ocr_plan"))


def best_reading(readings: DataFrame) -> DataFrame:
    """Of several OCR readings of a figure the longest text; ties by mode."""
    return readings.groupBy("doc_id", "page", "figure").agg(F.max_by("text", F.struct(F.length("text"), F.col("mode"))).alias("text"))


def filter_ocr_lines(text: Column) -> Column:
    """Lines of an OCR reading, trimmed, of over 20 characters that don't look like a table's."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & ~X.likely_table_text(x))
    return F.array_join(lines, "\n")


def read_figures(figures: DataFrame, ocr: Callable[[bytes, int], str], modes: tuple[int, ...] = (6, 3, 11, 4), keep_lines: bool = True) -> DataFrame:
    """(doc_id, page, figure, text, mode): an OCR hook's longest reading of each crop (doc_id, page, figure, image) over its modes, lines that look like a table's left out.

    A mode that fails counts as an empty reading; a figure that no mode reads has an empty text and mode null.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, used = [], []
            for image in batch.column(3).to_pylist():
                best = ("", None)
                for mode in modes:
                    try:
                        got = ocr(image or b"", mode) or ""
                    except Exception:  # a hook may fail in any way; another mode may not
                        got = ""
                    if len(got) > len(best[0]):
                        best = (got, mode)
                texts.append(best[0])
                used.append(best[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(used, pa.int32())], names=["doc_id", "page", "figure", "text", "mode"])

    rows = figures.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("figure").cast("int").alias("figure"), F.col("image").cast("binary").alias("image"))
    read = rows.mapInArrow(work, "doc_id string, page int, figure int, text string, mode int")
    return read.withColumn("text", filter_ocr_lines(F.col("text"))) if keep_lines else read


def figure_crops(figures: DataFrame, most: int = 12) -> DataFrame:
    """The first 12 figures of a page, a limit of the operator itself."""
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_idx"))
    return figures.withColumn("crop", k).filter(F.col("crop") <= most)
