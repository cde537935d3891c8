"""Assembly: reading order, page separators, Markdown with front matter and footer, document properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

COLUMN_RANK = {"left": 0, "single": 1, "full": 1, "right": 2}


def column_rank(column: Column) -> Column:
    return F.when(column == "left", 0).when(column == "right", 2).otherwise(1)


def reading_order(units: DataFrame, legacy: bool = False) -> DataFrame:
    """``place`` in the document: page, column, top, left; legacy: page, vertical centre, column, left (columns interleave)."""
    keys = ["page", (F.col("y0") + F.col("y1")) / 2, column_rank(F.col("column")), "x0"] if legacy else ["page", column_rank(F.col("column")), "y0", "x0"]
    return units.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys, "unit_id")))


def order_warnings(units: DataFrame) -> DataFrame:
    """Units that stand above their predecessor by more than 10 on the same page."""
    w = Window.partitionBy("doc_id").orderBy("place")
    return units.withColumn("_y", F.lag("y0").over(w)).withColumn("_p", F.lag("page").over(w)).filter((F.col("_p") == F.col("page")) & (F.col("_y") > F.col("y0") + 10)).drop("_y", "_p")


def assemble(units: DataFrame) -> DataFrame:
    """(doc_id, markdown): units (doc_id, place, page, unit_type, content) in order, a rule between pages, headings marked."""
    w = Window.partitionBy("doc_id").orderBy("place")
    line = F.when((F.col("unit_type") == "paragraph") & X.is_heading(F.col("content")), F.concat(F.lit("### "), "content")).otherwise(F.col("content"))
    turned = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False))
    rows = units.filter(F.coalesce(F.col("content"), F.lit("")) != "").withColumn("line", F.concat(F.when(turned, F.concat(F.lit("---\n\n## Page "), F.col("page").cast("string"), F.lit("\n\n"))).otherwise(""), line))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def properties(documents: DataFrame) -> DataFrame:
    """(doc_id, dates, temporal_references, numbers, urls, emails, document_type, language) of each text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", X.dates(t).alias("dates"), X.temporal_references(t).alias("temporal_references"), X.numbers(t).alias("numbers"), X.urls(t).alias("urls"), X.emails(t).alias("emails"), X.document_type(t).alias("document_type"), X.language(t).alias("language"))


def front_matter(title: Column, kind: Column, language: Column, pages: Column, has_tables: Column, has_images: Column, dates: Column, temporal: Column | None = None) -> Column:
    """YAML head: up to five dates and three temporal references, each list left out if it is empty."""
    quoted = F.concat(F.lit('"'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"'))
    section = lambda name, values, most: F.when(F.size(values) > 0, F.concat(F.lit(f"\n{name}:\n"), F.array_join(F.transform(F.slice(values, 1, most), lambda d: F.concat(F.lit("- "), d)), "\n"))).otherwise("")
    listed = section("dates", dates, 5)
    if temporal is not None:
        listed = F.concat(listed, section("temporal_references", temporal, 3))
    return F.concat(
        F.lit("---\ntitle: "), quoted, F.lit("\ndocument_type: "), kind, F.lit("\nlanguage: "), language, F.lit("\ntotal_pages: "), pages.cast("string"),
        F.lit("\nhas_tables: "), has_tables.cast("string"), F.lit("\nhas_images: "), has_images.cast("string"), listed, F.lit("\n---\n"),
    )


def paragraph_text(units: DataFrame) -> DataFrame:
    """(doc_id, text): all paragraphs of a document by place, a blank line between them; what properties are taken from."""
    rows = units.filter((F.col("unit_type") == "paragraph") & (F.coalesce(F.col("content"), F.lit("")) != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def footer(n_units: Column, n_tables: Column, n_pages: Column) -> Column:
    return F.concat(F.lit("\n\n---\n\n*End of document: "), n_pages.cast("string"), F.lit(" pages, "), n_units.cast("string"), F.lit(" units, "), n_tables.cast("string"), F.lit(" tables*\n"))


def unit_metrics(units: DataFrame) -> DataFrame:
    return units.groupBy("doc_id").agg(
        F.count("*").alias("total_units"), F.count_if(F.col("unit_type") == "paragraph").alias("text_units"), F.count_if(F.col("unit_type") == "table").alias("table_units"),
        F.count_if(F.col("source").contains("ocr")).alias("ocr_units"), F.bool_or(F.col("unit_type") == "table").alias("has_tables"), F.bool_or(F.col("source").startswith("ocr")).alias("has_images"),
    )


def resolve_version(paths: DataFrame) -> DataFrame:
    """Where a version's Markdown lies: the recorded path, else the version's file name, else the legacy name."""
    base = X.safe_name(F.col("base_name"))
    named = F.concat(base, F.when(F.col("version") == "v2", "_enhanced.md").otherwise(".md"))
    return paths.withColumn("file", F.coalesce(F.nullif(F.col("recorded"), F.lit("")), F.when(F.col("exists_named"), named), F.concat(F.lit("markdown_"), "version", F.lit(".md"))))
