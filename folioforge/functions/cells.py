"""Cells, headers and tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as two values run together, and as a negative number.
TWO_PERCENTS = r"(\d+\.?\d*%)(\d+\.?\d*%)"
TWO_NUMBERS = r"^\s*(\d+\.?\d*)\s+(\d+\.?\d*)\s*$"
NEGATIVE = r"\((\d+\.?\d*)\)"
TWO_DATES = r"(\d{1,2}-\w{3})(\d{1,2}-\w{3})"


def split_cell(cell: Column) -> Column:
    """Values that ran together, apart with ' | '; a number in brackets becomes negative."""
    join = lambda c, p: F.concat_ws(" | ", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2))
    signed = F.regexp_replace(cell, NEGATIVE, "-$1")
    return F.when(cell.rlike(TWO_PERCENTS), join(cell, TWO_PERCENTS)).when(cell.rlike(TWO_NUMBERS), join(cell, TWO_NUMBERS)).when(signed.rlike(TWO_DATES), join(signed, TWO_DATES)).otherwise(signed)


def header_name(name: Column, at: Column) -> Column:
    cleaned = F.replace(F.trim(F.coalesce(name, F.lit("None"))), F.lit("\n"), F.lit(" "))
    return F.when(cleaned == "", F.concat(F.lit("Col"), at.cast("string"))).otherwise(cleaned)


def headers(names: Column) -> Column:
    return F.transform(names, header_name)


def split_rows(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, split_cell))


def filled_columns(rows: Column) -> Column:
    """Positions of the columns in which some row has text."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(rows, lambda r: F.coalesce(F.trim(F.get(r, i)), F.lit("")) != ""))


def keep_columns(values: Column, columns: Column) -> Column:
    return F.transform(columns, lambda i: F.trim(F.coalesce(F.get(values, i), F.lit(""))))


def markdown_table(names: Column, rows: Column) -> Column:
    """A table in Markdown, cell texts as they are."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(names, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(names), rule), F.transform(rows, line)), "\n")


def parse_markdown_table(text: Column) -> Column:
    """Struct (headers, rows), null if there are under three lines, no header or no row. Blank cells vanish."""
    lines = F.split(F.trim(text), "\n")
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    names = cells(lines[0])
    rows = F.filter(F.transform(F.filter(F.slice(lines, 3, 1 << 30), lambda x: x.contains("|")), cells), lambda r: F.size(r) > 0)
    return F.when((F.size(lines) >= 3) & (F.size(names) > 0) & (F.size(rows) > 0), F.struct(names.alias("headers"), rows.alias("rows")))


def table_or_none(cells: Column) -> Column:
    """First row as header, the others as rows; null under two rows."""
    return F.when(F.size(cells) >= 2, F.struct(cells[0].alias("headers"), F.slice(cells, 2, 1 << 30).alias("rows")))
