"""Enrichment: token windows, prompts, recovery of generated JSON, validation, ranking, near-duplicate removal, synthesis."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import cells as C
from ..functions import text as X
from ..functions.batches import pieces
from ..functions.tokens import TokenCounter
from . import json_repair as J

WINDOW_TOKENS, OVERLAP_TOKENS = 10_000, 1_500
ITEM = "struct<type:string,enhancement_type:string,title:string,content:string,source_units:array<string>,confidence:double,priority:int>"
# What raises an item's priority.
HIGH_TYPES = ["formula_discovery", "compliance_mapping", "risk_identification"]
MEDIUM_TYPES = ["implication_analysis", "pattern_recognition", "requirement_synthesis"]
FOOTNOTE_LABELS = {"formula_discovery": "Formula", "implication_analysis": "Implication"}


def order_for_windows(units: DataFrame) -> DataFrame:
    """Units with ``ordinal`` as windows take them: by page and top edge, the extractor's own order (``place``) among equals. Missing pages and edges count as 0."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("y0", F.lit(0.0)), "place")
    return units.withColumn("ordinal", F.row_number().over(w) - 1)


def pack_windows(units: DataFrame, size: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(doc_id, window, members, tokens): greedy windows of ordered units (doc_id, ordinal, unit_id, tokens).

    A window is flushed when the next unit would exceed ``size``; the next one starts with the longest suffix of at
    most ``overlap`` tokens, then the unit itself, so every unit is in a window. What a window holds depends on all
    earlier ones, so a document's units are folded in order, in one pass with a running sum; only ordinals and token
    counts go through it, never texts.
    """
    item = F.struct(F.col("ordinal").cast("long").alias("o"), F.col("unit_id").cast("string").alias("u"), F.col("tokens").cast("long").alias("n"))
    per = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("us")).select("doc_id", F.transform("us", lambda x: x["u"]).alias("u"), F.transform("us", lambda x: x["n"]).alias("n"))
    schema = StructType([per.schema["doc_id"], StructField("window", IntegerType()), StructField("members", ArrayType(StringType())), StructField("tokens", LongType())])

    def windows(names: list, sizes: list) -> Iterator[tuple[list, int]]:
        start = total = 0
        for at, n in enumerate(sizes):
            if at > start and total + n > size:
                yield names[start:at], total
                while total > overlap:
                    total -= sizes[start]
                    start += 1
            total += n
        if len(names) > start:
            yield names[start:], total

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            of, number, members, tokens = [], [], [], []
            for row, (names, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for k, (held, total) in enumerate(windows(names, sizes)):
                    of.append(row)
                    number.append(k)
                    members.append(held)
                    tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(members, pa.list_(pa.string())), pa.array(tokens, pa.int64())], names=schema.names)

    return per.mapInArrow(work, schema)


def window_content(windows: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, window, content, tables): texts of a window's members in their order."""
    member = windows.select("doc_id", "window", F.posexplode("members").alias("k", "unit_id"))
    rows = member.join(units.select("doc_id", "unit_id", "unit_type", "content"), ["doc_id", "unit_id"])
    ordered = F.array_sort(F.collect_list(F.struct("k", "content", "unit_type")))
    return rows.groupBy("doc_id", "window").agg(ordered.alias("u")).select(
        "doc_id", "window", F.expr("array_join(transform(u, x -> x.content), '\n\n')").alias("content"), F.size(F.filter("u", lambda x: x["unit_type"] == "table")).alias("tables")
    )


def analyse_window(windows: DataFrame) -> DataFrame:
    counts = X.numeric_pattern_counts(F.col("content"))
    n = counts["currency"] + counts["percentage"] + counts["period"] + counts["number"]
    return windows.withColumn("patterns", n).withColumn("content_type", X.content_type(F.col("content"), F.col("tables"), n)).withColumn("has_tables", F.col("tables") > 0).withColumn("has_numerical", n > 0)


def pattern_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, currency, value, start, end, context): every numeric pattern with its place. Spark has no function for all places of a pattern, so rows go through Arrow batches."""
    patterns = [("currency", c, p) for p, c in X.CURRENCY] + [("percentage", None, X.PERCENTAGE), ("period", None, X.PERIOD), ("number", None, X.NUMBER)]

    def work(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        compiled = [(k, c, re.compile(p)) for k, c, p in patterns]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in pieces(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, currency, p in compiled:
                    for m in p.finditer(t or ""):
                        context = t[max(0, m.start() - 20) : m.end() + 20] if kind == "number" else None
                        rows.append((i, kind, currency, m.group(0), m.start(), m.end(), context))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=["doc_id", "kind", "currency", "value", "start", "end", "context"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, kind string, currency string, value string, start int, end int, context string")


def user_prompt(content: Column, tables: Column, counts: Column, hint: Column, most: int = 12_000) -> Column:
    """Short prompt for one window; the content's cap is the prompt's own limit."""
    return F.concat(F.lit("CONTENT:\n"), F.substring(content, 1, most), F.lit("\n\nTABLES: "), tables.cast("string"), F.lit("\nNUMERIC PATTERNS: "), F.to_json(counts), F.lit("\nHINT: "), hint)


def tables_block(tables: Column, most_tables: int = 3, most_rows: int = 5) -> Column:
    """The prompt's tables: up to three, with headers and their first five rows; empty without tables. tables: array of (headers, rows)."""
    row = lambda cells: F.concat(F.lit("  "), F.array_join(cells, " | "))

    def one(t: Column, i: Column) -> Column:
        shown = F.slice(t["rows"], 1, most_rows)
        return F.concat(
            F.lit("TABLE "), (i + 1).cast("string"), F.lit(":\nHeaders: "), F.array_join(t["headers"], " | "), F.lit("\nRows ("), F.size(t["rows"]).cast("string"), F.lit(" in all, the first "),
            F.size(shown).cast("string"), F.lit("):\n"), F.array_join(F.transform(shown, row), "\n"), F.lit("\n---"),
        )

    listed = F.array_join(F.transform(F.slice(tables, 1, most_tables), one), "\n")
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, F.concat(F.lit("\n=== TABLES ===\n"), listed, F.lit("\n"))).otherwise("")


def patterns_block(patterns: Column, most: int = 5) -> Column:
    """The prompt's numeric patterns: how many of each kind, then the first five values; empty without patterns. patterns: array of (kind, value) in their order."""
    kinds = F.array_distinct(F.transform(patterns, lambda p: p["kind"]))
    counts = F.transform(kinds, lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.size(F.filter(patterns, lambda p: p["kind"] == k)).cast("string"), F.lit(" instances")))
    values = F.transform(F.slice(patterns, 1, most), lambda p: F.concat(F.lit("  - "), p["value"], F.lit(" ("), p["kind"], F.lit(")")))
    text = F.concat(F.lit("\n=== NUMERIC PATTERNS ===\n"), F.array_join(counts, "\n"), F.lit("\n\nSample values:\n"), F.array_join(values, "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(patterns), F.lit(0)) > 0, text).otherwise("")


HINTS = {
    "financial": "This document holds financial data. Look for formulas, calculations and projections.",
    "legal": "This document is legal or regulatory. Look for implications, consequences and requirements.",
    "procedural": "This document describes procedures. Look for complete workflows and dependencies.",
}


def window_user_prompt(number: Column, total: Column, content: Column, tables: Column, patterns: Column, content_type: Column, most: int = 12_000) -> Column:
    """Whole prompt of one window: its place, its content up to the prompt's cap, tables, patterns and a hint by content type."""
    hint = F.lit("")
    for kind, text in HINTS.items():
        hint = F.when(content_type == kind, F.lit(f"\nHINT: {text}\n")).otherwise(hint)
    return F.concat(
        F.lit("WINDOW "), number.cast("string"), F.lit(" OF "), total.cast("string"), F.lit("\n\nCONTENT:\n"), F.substring(content, 1, most), F.lit("\n"),
        tables_block(tables), patterns_block(patterns), hint, F.lit("\nAnswer with one JSON object as the system prompt says."),
    )


def full_system_prompt(selected: DataFrame, domain: str, *keys: str) -> DataFrame:
    """(*keys, prompt, n_types): the whole system prompt of each registry's selected types: rules, ids, instructions type by type, output format, quantities.

    selected: type_id, name, description, prompt_instructions, examples, display_order. A registry without types gives no row.
    """
    example = F.coalesce(F.concat(F.lit("\nExample for "), F.lit(domain), F.lit(": "), F.try_element_at("examples", F.lit(domain))), F.lit(""))
    about = F.concat(F.upper("name"), F.lit(" (ID: `"), "type_id", F.lit("`)\nDescription: "), "description", F.lit("\nInstructions: "), "prompt_instructions", example, F.lit("\n---"))
    named = F.concat(F.lit("- `"), "type_id", F.lit("` ("), "name", F.lit(")"))
    rows = selected.select(*keys, F.struct("display_order", "type_id", named.alias("named"), about.alias("about")).alias("x"))
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("*").alias("n_types"))
    n = F.col("n_types")
    prompt = F.concat(
        F.lit(SYSTEM_HEAD), F.lit("\n\n## Selected types: "), n.cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["named"]), "\n"), F.lit("\n\n"),
        F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), x["about"])), "\n"),
        F.lit(SYSTEM_TAIL), F.lit("\nItems for each window: "), (2 * n).cast("string"), F.lit(" to "), (3 * n).cast("string"), F.lit(", two or three of every type."),
    )
    return per.select(*keys, prompt.alias("prompt"), "n_types")


def prompts_of(owners: DataFrame, selected: DataFrame, domain: str, key: str) -> DataFrame:
    """(key, prompt, n_types), a row for each key of owners: full_system_prompt() of its selected types, or STATIC_PROMPT where none is selected."""
    made = full_system_prompt(selected, domain, key)
    return owners.select(key).distinct().join(made, key, "left").select(key, F.coalesce("prompt", F.lit(STATIC_PROMPT)).alias("prompt"), F.coalesce("n_types", F.lit(0)).alias("n_types"))


SYSTEM_HEAD = """You analyse documents of any field and bring out what they imply but do not say.

Each item tells why it matters, how it can be used, which decision it supports, and what risk or chance it carries.
Derive what can be derived from the document's own figures and state assumptions and confidence. Never repeat what is written outright."""
SYSTEM_TAIL = """

## Output
One JSON object: {"enhancements": [{"type", "title", "content", "source_units", "confidence", "priority"}], "metadata": {}}
- type: one of the ids above and no other; title: specific; content: 150 words at least, with figures of the document
- source_units: ids of this window's units; confidence: 0.0 to 1.0; priority: 1 to 10"""
#: What is asked for without a selection of types.
STATIC_PROMPT = f"""{SYSTEM_HEAD}

Look for formulas behind the figures, implications, patterns, risks and open requirements, and name each item's type in lower case with underscores.{SYSTEM_TAIL.replace("one of the ids above and no other", "the item's kind")}"""


def system_prompt(selected: DataFrame, domain: str, *keys: str) -> DataFrame:
    """One row for each registry (all of ``selected`` without keys): instructions of the selected types in order, with the example of the domain where there is one."""
    line = F.concat(F.lit("- "), "type_id", F.lit(": "), "prompt_instructions", F.coalesce(F.concat(F.lit(" (e.g. "), F.try_element_at("examples", F.lit(domain)), F.lit(")")), F.lit("")))
    rows = selected.select(*keys, F.struct("display_order", "type_id", line.alias("line")).alias("x"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("instructions"), F.count("*").alias("n_types"))


def recover_json(raw: Column) -> Column:
    """Items of a generated response by the first of json_repair.strategies() that gives whole JSON with the list; none if no one does."""
    return F.coalesce(J.typed(F.coalesce(*map(J.items_in, J.strategies(raw)))), F.from_json(F.lit("[]"), f"array<{ITEM}>"))


def stub_generator(doc: str, content: str) -> str:
    """Deterministic answer, which stands for no model's quality."""
    import json

    words = content.split()
    return json.dumps({"enhancements": [{"type": "implication_analysis", "title": " ".join(words[:5]), "content": " ".join(words[:60]).ljust(100, "."), "source_units": [], "confidence": 0.5, "priority": 5}]})


def attempts(
    windows: DataFrame, generator: Callable[[str, str], str] | None = None, retries: int = 3, back_off: float = 1.0,
    rate: float | None = None, tasks: int = 1, check: Callable[[str], None] | None = None, sleep: Callable[[float], None] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, window, attempt, response, error, final, *keep): every call of a generator hook, the failed ones too.

    A failed call is followed by another after back_off * 2 ** (attempt - 1) seconds, ``retries`` calls in all. rate: calls
    a second over all ``tasks`` that run at once; each task paces its share. check: raises on a response that isn't
    good enough (too many invalid types, say), which counts as a failed call. Without a generator stub_generator answers.
    keep: columns of the windows that go along.
    """
    call = generator or stub_generator

    def work(batches: Iterator) -> Iterator:
        import time

        import pyarrow as pa

        from .config import Pace

        rest = sleep or time.sleep
        pace = Pace(rate, tasks, sleep=rest) if rate else None
        for batch in pieces(batches):
            rows = []
            for at, (doc, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for k in range(1, retries + 1):
                    if pace:
                        pace.wait()
                    answer = error = None
                    try:
                        answer = call(doc, content or "")
                        if check:
                            check(answer)
                    except Exception as e:  # a hook may fail in any way; the row tells
                        error = f"{type(e).__name__}: {e}"
                    rows.append((at, k, answer, error, error is None or k == retries))
                    if error is None:
                        break
                    if k < retries and back_off:
                        rest(back_off * 2 ** (k - 1))
            at = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.bool_()))]
            kept = [batch.column(3 + n).take(at) for n in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made, *kept], names=["doc_id", "window", "attempt", "response", "error", "final", *keep])

    rows = windows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("window").cast("int").alias("window"), "content", *keep)
    schema = StructType().add("doc_id", "string").add("window", "integer").add("attempt", "integer").add("response", "string").add("error", "string").add("final", "boolean")
    return rows.mapInArrow(work, StructType([*schema, *(rows.schema[c] for c in keep)]))


def generate(windows: DataFrame, generator: Callable[[str, str], str] | None = None, retries: int = 3, **how) -> DataFrame:
    """(doc_id, window, response, error, *keep): the last of a window's attempts(); a window whose last call failed has no response."""
    last = attempts(windows, generator, retries, **how).filter("final")
    return last.select("doc_id", "window", F.when(F.col("error").isNull(), F.col("response")).alias("response"), "error", *how.get("keep", ()))


def generation_events(calls: DataFrame, prompts: DataFrame, model: str, ts: Column | None = None) -> DataFrame:
    """Ledger rows (ts, step, model, input_tokens, output_tokens, meta) of attempts(), one a call. prompts: doc_id, window, content."""
    asked = prompts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("window").cast("int").alias("window"), X.token_estimate(F.col("content")).cast("long").alias("input_tokens"))
    meta = F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("window"), F.col("window").cast("string"), F.lit("attempt"), F.col("attempt").cast("string"))
    when = ts if ts is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return calls.join(asked, ["doc_id", "window"]).select(when.alias("ts"), F.lit("enhancement").alias("step"), F.lit(model).alias("model"), "input_tokens", X.token_estimate(F.col("response")).cast("long").alias("output_tokens"), meta.alias("meta"))


def items_of(responses: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, window, ordinal, type, title, content, source_units, confidence, priority, *keep) with defaults; 'type' and 'enhancement_type' are the same field. Answers that were cut off give the items they have."""
    rows = J.recover(responses.select("doc_id", "window", "response", *keep)).select("doc_id", "window", *keep, F.posexplode("items").alias("ordinal", "i"))
    return rows.select("doc_id", "window", "ordinal", F.coalesce("i.type", "i.enhancement_type", F.lit("general")).alias("type"), F.coalesce("i.title", F.lit("Untitled")).alias("title"), "i.content", "i.source_units", F.coalesce("i.confidence", F.lit(0.8)).alias("confidence"), F.col("i.priority").alias("priority"), *keep)


def long_enough(items: DataFrame, least: int = 100) -> DataFrame:
    return items.filter(F.length(F.trim(F.coalesce("content", F.lit("")))) >= least)


def valid_types(items: DataFrame, selected: DataFrame, most_invalid: float = 0.3) -> DataFrame:
    """Items of selected types, from windows of which at most ``most_invalid`` were of other types. selected: few rows, by the registry's nature."""
    marked = items.join(selected.select("type").distinct().withColumn("_ok", F.lit(True)), "type", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    share = F.avg((~F.col("_ok")).cast("double")).over(Window.partitionBy("doc_id", "window"))
    return marked.withColumn("_share", share).filter((F.col("_share") <= most_invalid) & F.col("_ok")).select(*items.columns)


def priority_score(kind: Column, content_type: Column, confidence: Column) -> Column:
    base = F.when(kind.isin(HIGH_TYPES), 8).when(kind.isin(MEDIUM_TYPES), 6).otherwise(5)
    return F.least(F.lit(10), F.greatest(F.lit(1), base + (content_type == "financial").cast("int") + (confidence >= 0.85).cast("int")))


def previews(content: Column) -> tuple[Column, Column]:
    """(original_context, source_preview): the window's first 500 and first 200 characters, limits of an item's record."""
    return F.substring(content, 1, 500), F.substring(content, 1, 200)


def enhancement_id(doc: Column, window: Column, ordinal: Column, content: Column) -> Column:
    """Deterministic: no clock goes into it."""
    return F.concat(F.lit("enh_"), F.substring(F.md5(F.concat_ws("|", doc.cast("string"), window.cast("string"), ordinal.cast("string"), content)), 1, 8))


def drop_near_duplicates(items: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """First item of each fingerprint within a document."""
    w = Window.partitionBy(key, X.fingerprint(F.col("content"))).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rank(items: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("confidence"), "ordinal")
    return items.withColumn("rank", F.row_number().over(w))


def lineage(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Units an item cites that its window has, else the window's first five."""
    w = windows.select("doc_id", "window", "members")
    cited = F.array_intersect(F.coalesce("source_units", F.array().cast("array<string>")), F.col("members"))
    return items.join(w, ["doc_id", "window"]).withColumn("source_units", F.when(F.size(cited) > 0, cited).otherwise(F.slice("members", 1, 5))).drop("members")


def type_distribution(items: DataFrame) -> DataFrame:
    per = items.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("distribution"))


def approved(items: DataFrame, automatic: bool = False) -> DataFrame:
    """Items whose status is approved or edited; automatic approval sets it for all."""
    marked = items.withColumn("status", F.lit("approved")) if automatic else items
    return marked.filter(F.lower(F.coalesce("status", F.lit(""))).isin("approved", "edited"))


def anchor_span(text: Column, anchor: Column) -> Column:
    """Struct (start, length) of an anchor's place, start from 1 and 0 without a place: exact, trimmed, any case; of an anchor over 30 characters also its first and its last 30 in any case."""
    a = F.trim(anchor)
    long = F.length(a) > 30
    low = F.lower(text)
    tries = [
        (anchor, text, F.lit(True)), (a, text, F.lit(True)), (F.lower(a), low, F.lit(True)),
        (F.lower(F.substr(a, F.lit(1), F.lit(30))), low, long), (F.lower(F.right(a, F.lit(30))), low, long),
    ]
    found = [F.when(may & (F.length(n) > 0) & (F.instr(t, n) > 0), F.struct(F.instr(t, n).alias("start"), F.length(n).alias("length"))) for n, t, may in tries]
    return F.coalesce(*found, F.struct(F.lit(0).alias("start"), F.lit(0).alias("length")))


def anchor_position(text: Column, anchor: Column) -> Column:
    """Where an anchor stands, from 1, or 0: the start of anchor_span()."""
    return anchor_span(text, anchor)["start"]


#: Bytes of anchors that are held by every worker at once; more of them are found by a join of word runs.
ANCHOR_BYTES = 64 << 20


def find_anchors(texts: DataFrame, items: DataFrame, most_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(item_id, doc_id, text, anchor, position): every document that holds an item's anchor word for word, with its first place from 1.

    texts: doc_id, text; items: item_id, anchor. The items' bytes are summed first. Up to ``most_bytes`` of them one
    automaton of all anchors is broadcast and each text is read once, without a shuffle; beyond, documents and items
    meet by the hash of eight words. Null and empty anchors and texts are found nowhere.
    """
    items = items.filter(F.length("anchor") > 0).select("item_id", "anchor")
    size = items.agg(F.coalesce(F.sum(F.octet_length("anchor")), F.lit(0)).alias("n")).first()["n"]
    if size > most_bytes:
        return _find_by_runs(texts, items)
    given = texts.sparkSession.sparkContext.broadcast([(r["item_id"], r["anchor"]) for r in items.collect()])
    schema = StructType([items.schema["item_id"], texts.schema["doc_id"], StructField("text", StringType()), StructField("anchor", StringType()), StructField("position", LongType())])
    item_type, doc_type = to_arrow_type(items.schema["item_id"].dataType), to_arrow_type(texts.schema["doc_id"].dataType)

    def work(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        by: dict[str, list] = {}
        for i, a in given.value:
            by.setdefault(a, []).append(i)
        if not by:
            return
        search = ahocorasick.Automaton()
        for a in by:
            search.add_word(a, a)
        search.make_automaton()
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first: dict[str, int] = {}
                for end, a in search.iter(text or ""):
                    first.setdefault(a, end - len(a) + 2)
                rows += [(i, doc, text, a, at) for a, at in first.items() for i in by[a]]
            kinds = (item_type, doc_type, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=schema.names)

    return texts.select("doc_id", "text").mapInArrow(work, schema)


def _find_by_runs(texts: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """The second to the ninth word of an anchor are whole words of a document if a tenth follows; anchors of fewer words are searched for in each text."""
    spaced = lambda c: F.split(F.regexp_replace(c, r"\s+", " "), " ")
    items = items.withColumn("w", spaced(F.col("anchor"))).withColumn("key", F.xxhash64(F.array_join(F.slice("w", 2, words), " ")))
    doc = texts.select("doc_id", "text").withColumn("w", spaced(F.col("text")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - words + 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    keyed = doc.select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))
    long, short = items.filter(F.size("w") >= words + 2), items.filter(F.size("w") < words + 2).select("item_id", "anchor")
    pairs = keyed.join(long.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    found = pairs.join(texts.select("doc_id", "text"), "doc_id").join(long.select("item_id", "anchor"), "item_id").filter(F.contains("text", "anchor"))
    rest = texts.join(short, F.contains("text", "anchor"))
    both = found.select("item_id", "doc_id", "text", "anchor").unionByName(rest.select("item_id", "doc_id", "text", "anchor"))
    return both.withColumn("position", F.instr("text", F.col("anchor")).cast("long"))


def synthesise(docs: DataFrame, notes: DataFrame, tokens: Callable[[], TokenCounter] | None = None) -> DataFrame:
    """(doc_id, markdown, anchored, appendixed): footnotes woven into texts.

    All places are found on the original text; a marker goes behind its anchor's last word, never into a table row
    (it moves to the row's end) nor into another marker, because insertion runs from right to left. Notes without a
    place go to an appendix. notes: doc_id, ordinal, anchor, title, content, type. tokens: makes a tokenizer, once in each
    task; a marker then stands where the first token behind its anchor begins, instead of behind the last word.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    items = notes.select(F.col("doc_id").cast("string").alias("doc_id"), F.struct("ordinal", "anchor", "title", "content", "type").alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("notes"))

    def weave(text: str, notes: list, ready: TokenCounter | None) -> tuple[str, int, int]:
        placed, loose = [], []
        starts = ready.starts(text) if ready and any(n["span"]["start"] for n in notes) else []
        for n in notes:
            if not n["span"]["start"]:
                loose.append(n)
                continue
            end = min(len(text), n["span"]["start"] - 1 + n["span"]["length"])
            if ready:
                at = bisect_left(starts, end)
                end = starts[at] if at < len(starts) else len(text)
            while not ready and end < len(text) and not text[end].isspace() and text[end] != "|":
                end += 1
            start = text.rfind("\n", 0, end) + 1
            if text[start:].lstrip(" ").startswith("|"):
                stop = text.find("\n", end)
                end = len(text) if stop < 0 else stop
            placed.append((end, n))
        placed.sort(key=lambda p: (p[0], p[1]["ordinal"]))
        out = text
        for k in range(len(placed), 0, -1):
            end = placed[k - 1][0]
            out = f"{out[:end]}[^{k}]{out[end:]}"
        label = lambda n: FOOTNOTE_LABELS.get(n["type"], "Note")
        if placed:
            out += "\n\n---\n\n" + "\n".join(f"[^{k}]: **{label(n)}: {n['title']}** {n['content']}" for k, (_, n) in enumerate(placed, 1))
        if loose:
            out += "\n\n## Appendix\n\n" + "\n".join(f"- **{label(n)}: {n['title']}** {n['content']}" for n in loose)
        return out, len(placed), len(loose)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready = tokens() if tokens else None
        for batch in pieces(batches):
            got = [weave(t or "", n or [], ready) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))], names=["doc_id", "markdown", "anchored", "appendixed"])

    found = F.transform("notes", lambda n: n.withField("span", anchor_span(F.coalesce("text", F.lit("")), F.coalesce(n["anchor"], F.lit("")))))
    return texts.join(items, "doc_id", "left").withColumn("notes", found).mapInArrow(work, "doc_id string, markdown string, anchored int, appendixed int")


def tables_of_units(units: DataFrame) -> DataFrame:
    return units.filter("unit_type = 'table'").withColumn("parsed", C.parse_markdown_table(F.col("content"))).filter("parsed is not null").select("doc_id", "unit_id", "parsed.headers", "parsed.rows", F.substring("content", 1, 1000).alias("raw_content"))


def repair_numbered_sections(documents: DataFrame) -> DataFrame:
    """(doc_id, text): runs of lines that are bare section numbers, paired with the lines that follow the run."""

    def repair(text: str) -> str:
        import re

        bare = re.compile(r"\d+\.?\d*\.?\s*\Z")
        lines, out, i = [x.strip() for x in text.split("\n")], [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and bare.match(lines[j]):
                j += 1
            if j - i < 2 and (j == i or j == len(lines) or not lines[j]):  # a single number takes a line that says something, never a blank one
                out.append(lines[i])
                i += 1
                continue
            for k in range(i, j):
                content = lines[j + k - i] if j + k - i < len(lines) else ""
                out.append(f"{lines[k]} {content}" if content else lines[k])
            i = j + (j - i)
        return "\n".join(out)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([repair(t or "") for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, text string")
