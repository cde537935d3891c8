"""A data source for paged files: ``spark.read.format("folioforge_pages")`` reads a file in several tasks, each a range of pages, and takes filters on pages.

What opens a file is a reader: an importable object ``module:name`` with ``plan(path, step)``, which yields ranges of at
most ``step`` pages as (first, last, hint), and ``blocks(path, first, last, hint)``, which yields the blocks of such a range
as dicts (page, block_idx, type, bbox, text, size). LineReader is one for plain text; a PDF library takes a few lines.
Plans are made by a Spark job, a task a share of the files, and kept in the shared folder, in parts of many ranges where
there are many; a part is a task. The driver holds the parts' names and the pages they lie between, and opens no file.
Readers run in the executors, so paths are URIs or places that all of them reach.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import scratch, ship
from .files import listed, open_file
from .tables import BLOCKS

#: Pages of a file's range at most.
PAGES_PER_TASK = 64
#: What stands around a line's words: separators of words (Unicode's class Zs). Tabs and the like are signs of a word.
BLANKS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: Up to so many ranges are a task each; of more, a task has several, of some PART_PAGES pages.
MOST_SINGLE, PART_PAGES = 256, 4096


def load(reader: str):
    module, _, name = reader.partition(":")
    return getattr(importlib.import_module(module), name)()


class LineReader:
    """Files of lines: LINES_A_PAGE lines a page, each line a block ten points high. A range's hint is the bytes it begins and ends at."""

    LINES_A_PAGE = 50

    def plan(self, path: str, step: int) -> Iterator[tuple[int, int, str]]:
        first, begin, lines, at = 1, 0, 0, 0
        with open_file(path) as f:
            while chunk := f.read(1 << 20):
                where = chunk.find(b"\n")
                while where >= 0:
                    lines += 1
                    if lines % (self.LINES_A_PAGE * step) == 0:
                        yield first, first + step - 1, f"{begin},{at + where}"
                        first, begin = first + step, at + where + 1
                    where = chunk.find(b"\n", where + 1)
                at += len(chunk)
        yield first, 1 + lines // self.LINES_A_PAGE, f"{begin},{at}"

    def blocks(self, path: str, first: int, last: int, hint: str) -> Iterator[dict]:
        begin, end = map(int, hint.split(","))
        with open_file(path) as f:
            f.seek(begin)
            text = f.read(end - begin).decode()
        for k, line in enumerate(text.split("\n"), (first - 1) * self.LINES_A_PAGE):
            row, spans = k % self.LINES_A_PAGE, [x for x in line.split(" ") if x]
            yield {"page": 1 + k // self.LINES_A_PAGE, "block_idx": str(k), "type": "text" if spans else "figure", "bbox": (0, 10 * row, 6 * len(line), 10 * row + 10), "text": " ".join(spans).strip(BLANKS), "size": (600, 500)}


@dataclass
class Pages(InputPartition):
    """A range of pages of a file; wanted: the only ones of it that are asked for, or all."""

    doc_id: str
    path: str
    first: int
    last: int
    hint: str
    wanted: list[int] | None


@dataclass
class Part(InputPartition):
    """Ranges of a stored plan."""

    path: str


class PageReader(DataSourceReader):
    """Ranges or parts of the plan as tasks. Filters on ``page`` leave ranges out, so pages that nobody asks for are never read."""

    def __init__(self, options: dict):
        self.plan, self.parts, self.reader = json.loads(options.get("plan", "[]")), json.loads(options.get("parts", "[]")), options["reader"]
        self.low, self.high = 1, float("inf")
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("page",) or value is None:
                yield f
            elif isinstance(f, EqualTo | In):
                values = {v for v in value if v is not None} if isinstance(f, In) else {value}
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, value - isinstance(f, LessThan))
            else:
                yield f

    def chosen(self, doc: str, path: str, first: int, last: int, hint: str) -> Pages | None:
        """A range, if any of its pages is asked for."""
        inner = [p for p in range(max(first, self.low), min(last, self.high) + 1) if self.only is None or p in self.only]
        return Pages(doc, path, first, last, hint, None if len(inner) == last - first + 1 else inner) if inner else None

    def partitions(self) -> list[InputPartition]:
        tasks = [p for p in (self.chosen(*r) for r in self.plan) if p]
        asked = lambda low, high: high >= self.low and low <= self.high and (self.only is None or any(low <= p <= high for p in self.only))
        tasks += [Part(path) for path, low, high in self.parts if asked(low, high)]
        return tasks or [Pages("", "", 1, 0, "", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ready = load(self.reader)
        if isinstance(partition, Pages):
            yield from self.rows(ready, partition)
            return
        import pyarrow.parquet as pq

        with open_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096):
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if some := self.chosen(*r):
                        yield from self.rows(ready, some)

    def rows(self, ready, pages: Pages) -> Iterator[tuple]:
        if pages.last < pages.first:
            return
        for b in ready.blocks(pages.path, pages.first, pages.last, pages.hint):
            if pages.wanted is None or b["page"] in pages.wanted:
                x0, y0, x1, y1 = map(float, b["bbox"])
                w, h = map(float, b["size"])
                yield pages.doc_id, b["page"], b["block_idx"], b["type"], x0, y0, x1, y1, b["text"], (x1 - x0) * (y1 - y0) / (w * h) if w * h else 0.0, None, w, h


class PageSource(DataSource):
    """Options: parts (JSON rows: a stored plan's file, its smallest and largest page) or plan (JSON rows doc_id, path, first, last, hint), and reader (module:name). read_pages() fills them in."""

    @classmethod
    def name(cls) -> str:
        return "folioforge_pages"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def plan_pages(spark: SparkSession, path: str, reader: str, step: int, empty: bool = False) -> DataFrame:
    """(doc_id, path, first, last, hint): ranges of all files below ``path``, planned where the files are read. Files of no bytes have no pages, or with ``empty`` those that the reader gives them."""

    def work(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        ready = load(reader)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            held = []
            for where in batch.column(0).to_pylist():
                doc = re.sub(r"\.[^.]*$", "", where.rsplit("/", 1)[-1])
                for r in ready.plan(where, step):
                    held.append((doc, where, *r))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in enumerate(kinds)], names=names)
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in enumerate(kinds)], names=names)

    names = ["doc_id", "path", "first", "last", "hint"]
    files = listed(ship(spark), path)
    return (files if empty else files.filter("size > 0")).select("path").mapInArrow(work, "doc_id string, path string, first int, last int, hint string")


def read_pages(spark: SparkSession, path: str, reader: str = f"{__name__}:LineReader", pages_per_task: int = PAGES_PER_TASK, empty: bool = False) -> DataFrame:
    """Blocks of all files below ``path``, a task a range of pages, or a part of many ranges; a filter on ``page`` decides which ranges are read. empty: see plan_pages()."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    planned, dealt = scratch(spark), scratch(spark)
    plan_pages(spark, path, reader, pages_per_task, empty).write.parquet(planned)
    plan = spark.read.parquet(planned)
    n, most = plan.agg(F.count("*"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0))).first()
    # by their first pages, so that a filter leaves whole parts out
    plan.repartitionByRange(max(1, min(n, max(MOST_SINGLE, most // PART_PAGES))), "first", F.xxhash64("path")).write.parquet(dealt)
    parts = spark.read.parquet(dealt).groupBy(F.col("_metadata.file_path").alias("part")).agg(F.min("first"), F.max("last")).collect()  # parts, not ranges
    return spark.read.format("folioforge_pages").option("parts", json.dumps(sorted(tuple(r) for r in parts))).option("reader", reader).load()
