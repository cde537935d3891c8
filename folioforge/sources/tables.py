"""Readers. All of them are lazy frames with explicit schemas; files are found and split by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .files import as_uri, listed, open_file, read_files

BLOCKS = "doc_id string, page int, block_idx string, type string, x0 double, y0 double, x1 double, y1 double, text string, area_ratio double, needs_ocr boolean, page_width double, page_height double"
UNITS = "unit_id string, doc_id string, page int, unit_type string, column string, bbox array<double>, y0 double, source string, anchor string, content string, extra map<string,string>"
TABLES = "table_id string, page int, bbox array<double>, headers array<string>, rows array<array<string>>, fixes map<string,int>, provenance string"
ENHANCEMENTS = "enhancement_id string, doc_id string, enhancement_type string, title string, original_context string, generated_content string, source_units array<string>, confidence_score double, priority int"
SEGMENTS = "segment_id string, page int, header_path string, char_start int, char_end int"
RAW_TABLES = "doc_id string, page int, ordinal int, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, rotation int"
EVENTS = "ts double, step string, model string, input_tokens bigint, output_tokens bigint, meta map<string,string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def file_name() -> Column:
    """A file source's file name as it is on disk; Spark gives it as a part of a URL."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one row per Markdown file, doc_id from the file's name as it is on disk."""
    uri = F.udf(as_uri, "string")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    return read_files(spark, path).select(name.alias("doc_id"), uri("path").alias("path"), F.col("content").cast("string").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Units, tables, enhancements, segments or metrics from files that hold one JSON array or object, or from JSON lines."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Token events from JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENTS).alias("e")).select("e.*")


def first_non_empty(*sources: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """For each key the rows of the first source that has any, as extractors fall back on one another."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more.join(out.select(*keys).distinct(), list(keys), "left_anti"))
    return out


def accept_uploads(uploads: DataFrame, mime: str = "application/pdf") -> DataFrame:
    """All-or-nothing gate: (batch_id, accepted, n_files) over (batch_id, content_type)."""
    return uploads.groupBy("batch_id").agg(F.bool_and(F.coalesce(F.col("content_type"), F.lit("")) == mime).alias("accepted"), F.count("*").alias("n_files"))


def ingest_markdown(documents: DataFrame, namespace: str, version: str = "v2") -> DataFrame:
    """Markdown rows (doc_id, text) as a namespaced batch, ready for chunking."""
    return documents.filter(F.coalesce(F.trim("text"), F.lit("")) != "").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(namespace).alias("namespace"), F.lit(version).alias("version"))


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]] | None = None) -> DataFrame:
    """Layout blocks of PDF files through a parser hook. The default needs an optional library and says so if it is missing."""
    if parse is None:
        try:
            import fitz
        except ImportError as e:
            raise ImportError("reading PDF files needs a parser: pass parse=, or install the optional PDF library") from e

        def parse(data: bytes) -> Iterator[dict]:
            for number, page in enumerate(fitz.open(stream=data, filetype="pdf"), 1):
                for k, b in enumerate(page.get_text("dict")["blocks"]):
                    text = " ".join(s["text"] for line in b.get("lines", []) for s in line["spans"] if s["text"].strip())
                    yield {"page": number, "block_idx": str(k), "type": "figure" if b["type"] == 1 else "text", "bbox": b["bbox"], "text": text, "size": (page.rect.width, page.rect.height)}

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [*[pa.string()], pa.int32(), *[pa.string()] * 2, *[pa.float64()] * 4, pa.string(), pa.float64(), pa.bool_(), *[pa.float64()] * 2]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=names)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with open_file(path) as f:
                    content = f.read()
                for b in parse(content):
                    x0, y0, x1, y1 = map(float, b["bbox"])
                    w, h = map(float, b["size"])
                    area = (x1 - x0) * (y1 - y0) / (w * h) if w * h else 0.0
                    rows.append((Path(path).stem, b["page"], b["block_idx"], b["type"], x0, y0, x1, y1, b["text"], area, None, w, h))
                    if len(rows) == 4096:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return listed(spark, path).select("path").mapInArrow(work, BLOCKS)


def simple_text_blocks(documents: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Fallback layout: paragraphs become blocks of equal height down one page."""
    parts = documents.select("doc_id", F.expr(r"filter(split(text, '\n\n'), x -> trim(x) <> '')").alias("parts"))
    rows = parts.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "text"))
    step = F.lit(height) / F.col("n")
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("fallback_"), "k").alias("block_idx"), F.lit("text").alias("type"),
        F.lit(0.0).alias("x0"), (F.col("k") * step).alias("y0"), F.lit(width).alias("x1"), ((F.col("k") + 1) * step).alias("y1"), F.trim("text").alias("text"),
    )


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words grouped by the whole part of their top edge, as lines of more than 15 characters."""
    line = words.groupBy("doc_id", "page", F.floor("y0").alias("row")).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(x0, text))), w -> w.text), ' ')").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return line.filter(F.length("text") > 15)


def alternative_blocks(blocks: DataFrame, raw: DataFrame, words: DataFrame, fewest: int = 3) -> DataFrame:
    """(doc_id, page, source, text, x0, y0, x1, y1) that pages with under three text blocks get besides them.

    Raw text blocks of over 10 characters, 30 wide and 10 high; on pages without such ones, lines made of words. blocks
    must have a row for each page (type null on an empty one). What is found is added, repeats of a page's blocks too.
    """
    page = ["doc_id", "page"]
    poor = blocks.groupBy(*page).agg(F.count_if(F.col("type") == "text").alias("n")).filter(F.col("n") < fewest).select(*page)
    box = ["x0", "y0", "x1", "y1"]
    large = raw.withColumn("text", F.trim("text")).filter((F.length("text") > 10) & (F.col("x1") - F.col("x0") > 30) & (F.col("y1") - F.col("y0") > 10))
    first = large.join(poor, page, "left_semi").select(*page, F.lit("raw_blocks").alias("source"), "text", *box)
    second = words_to_lines(words.join(poor, page, "left_semi")).select(*page, F.lit("word_lines").alias("source"), "text", *box)
    return first_non_empty(first, second)


def read_tables(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Raw tables of PDF files through a parser hook, see parse_tables()."""
    return parse_tables(ship(spark).read.format("binaryFile").load(path).select("path", "content"), parse)


def parse_tables(files: DataFrame, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Raw tables of files (path, content): doc_id, page, ordinal, cells, box (null if unknown), page size and rotation, for tabular.clean_tables().

    The hook yields dicts with page, cells (rows of cell texts, null allowed), size (width, height), and perhaps bbox and rotation.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.string())), *[pa.float64()] * 6, pa.int32()]
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[int, int] = {}
                for t in parse(content):
                    at = seen[t["page"]] = seen.get(t["page"], -1) + 1
                    cells = [[None if c is None else str(c) for c in row] for row in t["cells"]]
                    rows.append((Path(file).stem, t["page"], at, cells, *(t.get("bbox") or (None,) * 4), *map(float, t["size"]), t.get("rotation", 0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=[c.split()[0] for c in RAW_TABLES.split(", ")])

    return files.select("path", "content").mapInArrow(work, RAW_TABLES)


TYPES = "type_id string, category string, name string, name_en string, description string, applicable_domains array<string>, default_priority int, default_enabled boolean, prompt_instructions string, examples map<string,string>, display_order int"


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """Enhancement type registry from YAML files, with defaults for missing fields; a file is parsed where it is read, one at a time in a task. Files without categories give no rows; one that isn't YAML, or a type without id, is an error when it is read."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import yaml

        kinds = [*[pa.string()] * 5, pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]
        names = [c.split()[0] for c in TYPES.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=names)
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_file(path) as f:
                    text = f.read().decode()
                for category in (yaml.load(text, loader) or {}).get("categories") or []:
                    for t in category.get("types") or []:
                        name, examples = t.get("name", t["id"]), [(str(k), str(v)) for k, v in (t.get("examples") or {}).items()]
                        rows.append((str(t["id"]), category["id"], name, t.get("name_en", name), t.get("description", ""), list(t.get("applicable_domains", ["all"])), int(t.get("default_priority", 5)), bool(t.get("default_enabled", True)), t.get("prompt_instructions", ""), examples, int(category.get("display_order", 0))))
                yield made(rows)

    return listed(spark, path).select("path").mapInArrow(work, TYPES)


def read_profile(path: str) -> dict:
    """Client profile: switches that are 0 or 1, keys with an underscore are comments."""
    with open(path) as f:
        profile = json.load(f)
    for part in ("enhancement_types", "domains"):
        for k, v in profile.get(part, {}).items():
            if not k.startswith("_") and v not in (0, 1):
                raise ValueError(f"{part}.{k} must be 0 or 1, not {v!r}")
    return profile


SWITCHES = "struct<client_name:string,enhancement_types:map<string,int>,domains:map<string,int>>"


def profile_switches(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, client_name, part, key, value, accepted) of all profiles in a folder, without templates; comments are left out. accepted: whether a switch is 0 or 1, as it must be."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.regexp_extract(file_name(), r"([^/]+)\.json$", 1).alias("profile"), F.from_json("value", SWITCHES).alias("p"))
    rows = files.filter(~F.col("profile").contains("template"))
    parts = [rows.select("profile", "p.client_name", F.lit(c).alias("part"), F.explode(f"p.{c}").alias("key", "value")) for c in ("enhancement_types", "domains")]
    switches = parts[0].unionByName(parts[1]).filter(~F.col("key").startswith("_"))
    return switches.withColumn("accepted", F.coalesce(F.col("value").isin(0, 1), F.lit(False)))


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, client_name, part, key, value): profile_switches(), of which one that isn't accepted is an error when it is read."""
    refused = F.raise_error(F.concat_ws(" ", F.lit("switch is neither 0 nor 1:"), "profile", "part", "key"))
    return profile_switches(spark, folder).withColumn("value", F.when(F.col("accepted"), F.col("value")).otherwise(refused)).drop("accepted")


def list_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the profiles in a folder, without templates."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    names = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("profile"))
    return names.filter(~F.col("profile").contains("template")).orderBy("profile")
