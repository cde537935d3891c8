"""Raw tables of a parser, cleaned: cells apart, headers named, empty columns dropped, boxes found, Markdown written.

One row is one table, so everything here is a Column expression over arrays and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as G
from . import config


def clean_tables(raw: DataFrame, bottom_up: bool = False) -> DataFrame:
    """(doc_id, page, ordinal, table_id, headers, rows, n_fixed, x0, y0, x1, y1, provenance) of raw tables (see sources.tables.RAW_TABLES).

    Tables of under two rows go. The first row is the header; null cells are empty, and columns without any text go.
    n_fixed counts the cells that were changed because values had run together. A box that the parser found is turned
    upright and narrowed to its columns if it spans the page; without one a box is estimated from the table's place.
    """
    text = F.transform("cells", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    rows = raw.withColumn("_t", C.table_or_none(text)).filter("_t is not null")
    rows = rows.withColumn("_split", C.split_rows(F.col("_t.rows"))).withColumn("_keep", C.filled_columns(F.col("_split")))
    changed = F.size(F.filter(F.zip_with(F.flatten("_t.rows"), F.flatten("_split"), lambda a, b: a != b), lambda x: x))
    names = C.headers(F.col("_t.headers"))
    rows = rows.withColumn("n_fixed", changed).withColumn("headers", C.keep_columns(names, F.col("_keep"))).withColumn("rows", F.transform("_split", lambda r: C.keep_columns(r, F.col("_keep"))))
    width = F.col("page_width")
    upright = G.normalise(G.box(), width, F.col("page_height"), F.coalesce("rotation", F.lit(0)), F.lit(bottom_up))
    n_columns = F.size("headers")
    left, right = config.narrow_table(upright[0], upright[2], n_columns, F.array_join("headers", " "), width)
    found = (left, upright[1], right, upright[3])
    guessed = config.estimated_table(F.col("ordinal"), n_columns, F.size("rows"), width)
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    box = [F.when(known, f).otherwise(g) for f, g in zip(found, guessed, strict=True)]
    ident = F.concat_ws("_", F.lit("t"), "doc_id", F.concat(F.lit("p"), "page"), F.col("ordinal").cast("string"))
    return rows.select("doc_id", "page", "ordinal", ident.alias("table_id"), "headers", "rows", "n_fixed", *(b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)), F.lit("parser").alias("provenance"))


def table_units(tables: DataFrame) -> DataFrame:
    """Units (unit_id, doc_id, page, unit_type, column, x0, y0, x1, y1, source, anchor, content) of cleaned tables, content as Markdown."""
    ident = F.concat(F.lit("u_"), "table_id")
    return tables.select(
        ident.alias("unit_id"), "doc_id", "page", F.lit("table").alias("unit_type"), F.lit("full").alias("column"), "x0", "y0", "x1", "y1", F.col("provenance").alias("source"),
        F.concat(F.lit("#"), ident).alias("anchor"), C.markdown_table(F.col("headers"), F.col("rows")).alias("content"),
    )


def more_accurate(tables: DataFrame, first: str = "lattice", order: tuple[str, ...] = ()) -> DataFrame:
    """Of a page's tables by ``flavour`` those of the flavour with the larger mean accuracy (missing ones count 0), ``first`` among equals, then by name.

    Floats add up to slightly different sums in different orders, which decides between means that are nearly equal:
    with columns ``order`` a page's accuracies are added in that order, however the rows are dealt.
    """
    accuracy = F.coalesce("accuracy", F.lit(0.0))
    in_order = F.array_sort(F.collect_list(F.struct(*order, accuracy.alias("_accuracy"))))
    mean = F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["_accuracy"].cast("double")) / F.size(in_order) if order else F.avg(accuracy)
    per = tables.groupBy("doc_id", "page", "flavour").agg(mean.alias("_mean"))
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("_mean"), F.desc(F.col("flavour") == first), "flavour")
    best = per.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc_id", "page", "flavour")
    return tables.join(best, ["doc_id", "page", "flavour"], "left_semi")
