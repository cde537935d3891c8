"""Zones and blocks met by cells of the page, so that a page of any size is many small joins.

A box lies in every cell that it touches; a block and a zone that meet are found in each cell they share and kept in one:
the cell of their common area's smallest corner. Only boxes and three truths about a text travel through the join, never
the text. Boxes have their corners in order, as geometry.normalise() gives them; a block or zone with a null corner meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .layout import LARGE_AREA, LONG_TEXT, OVERLAP, OVERLAP_TITLE, PAGE, is_table_caption, is_table_title

#: Sides of a cell: some lines of text high, a third of a column wide.
CELL = 96.0
BOX = ["x0", "y0", "x1", "y1"]
FLAGS = ["_titled", "_captioned", "_large"]


def cell_of(c: Column, size: float) -> Column:
    return F.floor(c / size)


def in_cells(boxes: DataFrame, size: float, prefix: str = "") -> DataFrame:
    """A row for each cell that a box touches."""
    span = lambda a, b: F.explode(F.sequence(cell_of(F.col(prefix + a), size), cell_of(F.col(prefix + b), size)))
    there = boxes.filter((F.col(f"{prefix}x0") <= F.col(f"{prefix}x1")) & (F.col(f"{prefix}y0") <= F.col(f"{prefix}y1")))
    return there.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))


def meeting_pairs(blocks: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of rows of blocks (page, box, other columns) and areas (page, box as z_...) whose boxes meet, each once."""
    z = areas.select(*PAGE, *(F.col(c).alias(f"z_{c}") for c in BOX)).distinct()
    pairs = in_cells(blocks, size).join(in_cells(z, size, "z_"), [*PAGE, "_cx", "_cy"])
    first = (cell_of(F.greatest("x0", "z_x0"), size) == F.col("_cx")) & (cell_of(F.greatest("y0", "z_y0"), size) == F.col("_cy"))
    meet = (F.greatest("x0", "z_x0") <= F.least("x1", "z_x1")) & (F.greatest("y0", "z_y0") <= F.least("y1", "z_y1"))
    return pairs.filter(first & meet).drop("_cx", "_cy")


def zone_verdicts(blocks: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """As layout.zone_verdicts(): blocks with _drop, _inside and _alone. Repeated rows each stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0.0)  # what a title or a caption is besides its place
    marked = blocks.withColumn("_titled", is_table_title(text, zero, zero)).withColumn("_captioned", is_table_caption(text, zero, zero))
    marked = marked.withColumn("_large", (G.area(G.box()) > LARGE_AREA) | (F.length(text) > LONG_TEXT))
    key = [*PAGE, *BOX, *FLAGS]
    pairs = meeting_pairs(marked.select(*key).distinct(), areas, size)
    labelled = (F.col("_titled") & (F.col("y1") <= F.col("z_y0") + 5)) | (F.col("_captioned") & (F.col("y0") >= F.col("z_y1") - 5))
    dropped = (G.overlap_ratio(G.box(), G.box("z_")) > F.when(labelled, OVERLAP_TITLE).otherwise(OVERLAP)) & ~F.col("_large")
    verdicts = pairs.groupBy(*key).agg(F.bool_or(dropped).alias("_drop"), F.bool_or(G.contains(G.box("z_"), G.box())).alias("_inside"))
    judged = marked.join(verdicts, key, "left").withColumn("_drop", F.coalesce("_drop", F.lit(False))).withColumn("_inside", F.coalesce("_inside", F.lit(False)))
    emptied = judged.groupBy(*PAGE).agg(F.bool_and("_drop").alias("_alone")).filter("_alone")
    out = judged.join(emptied, PAGE, "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    return out.select(*(F.col(f"`{c}`") for c in blocks.columns), "_drop", "_inside", "_alone")


def outside_zones(blocks: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """As layout.outside_zones(), for pages of any size."""
    return zone_verdicts(blocks, areas, size).filter(F.when(F.col("_alone"), ~F.col("_inside")).otherwise(~F.col("_drop"))).select(*(F.col(f"`{c}`") for c in blocks.columns))
