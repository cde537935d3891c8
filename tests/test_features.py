"""Page source, table function, cells, shared pace, observed writes, JSON repair, token boundaries, partition values, file names."""

import datetime
import json
import random
from bisect import bisect_left

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions.tokens import FixedWidth, with_token_counts
from folioforge.operators import enrichment, json_repair, layout, pacing, spatial, window_table
from folioforge.sources import observed, pages, sinks
from folioforge.sources import tables as T


class WidePages(pages.LineReader):
    """Pages of three lines."""

    LINES_A_PAGE = 3


def block_rows(df):
    return sorted((r["doc_id"], int(r["block_idx"]), r["page"], r["type"], r["text"]) for r in df.collect())


def by_hand(files, lines):
    return sorted((n.rsplit(".", 1)[0], k, 1 + k // lines, "text" if x.split() else "figure", " ".join(y for y in x.split(" ") if y.strip())) for n, t in files.items() if t for k, x in enumerate(t.split("\n")))


def test_a_file_is_read_in_several_tasks(spark, tmp_path):
    files = {"a b.txt": "\n".join(f"line {k} é" for k in range(40)), "100% +x.txt": "one\n\nthree\n", "empty.txt": "", "long.txt": "\n".join("w" * (k % 7) for k in range(1000))}
    sinks.write_files(spark.createDataFrame(list(files.items()), "file string, text string"), str(tmp_path / "in"))
    df = pages.read_pages(spark, str(tmp_path / "in"), f"{__name__}:WidePages", 2)
    assert block_rows(df) == by_hand(files, 3)
    assert df.rdd.getNumPartitions() > 150
    some = df.filter("page >= 3 and page < 5")
    assert block_rows(some) == [r for r in by_hand(files, 3) if 3 <= r[2] < 5]
    assert block_rows(df.filter(F.col("page").isin(1, 9) & (F.col("type") == "text"))) == [r for r in by_hand(files, 3) if r[2] in (1, 9) and r[3] == "text"]
    assert df.filter("page > 100000").count() == 0


def test_filters_leave_ranges_out():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    plan = [["d", "/f", a, a + 4, ""] for a in range(1, 100, 5)]
    wanted = lambda *filters: [(list(r.pushFilters(list(filters))), [(p.first, p.wanted) for p in r.partitions()]) for r in [pages.PageReader({"plan": json.dumps(plan), "reader": "x:y"})]][0]
    assert wanted(GreaterThan(("page",), 90))[1] == [(91, None), (96, None)]
    assert wanted(In(("page",), (3, 4, None, 77)), LessThanOrEqual(("page",), 50))[1] == [(1, [3, 4])]
    other = EqualTo(("type",), "text")
    assert wanted(other, EqualTo(("page",), 12)) == ([other], [(11, [12])])
    assert wanted(GreaterThan(("page",), 1000))[1] == [(1, [])]


def windows_by_hand(sizes, size, overlap):
    out, held, total = [], [], 0
    for k, n in enumerate(sizes):
        if held and total + n > size:
            out.append((held[:], total))
            while total > overlap:
                total -= sizes[int(held.pop(0))]
        held.append(str(k))
        total += n
    return [*out, (held, total)] if held else out


def test_windows_in_sql(spark):
    window_table.register(spark)
    rng = random.Random(2)
    docs = {d: [rng.choice([1, 5, 30, 120]) for _ in range(rng.randrange(1, 40))] for d in range(25)}
    rows = [(d, k, str(k), n) for d, sizes in docs.items() for k, n in enumerate(sizes)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, tokens long").repartition(3).createOrReplaceTempView("some_units")
    for size, overlap in ((100, 0), (100, 40), (1, 1), (100_000, 10)):
        got = spark.sql(f"SELECT * FROM pack_windows(TABLE(some_units) PARTITION BY doc_id ORDER BY (ordinal), {size}, {overlap})").collect()
        found = {}
        for r in sorted(got, key=lambda r: (r["doc_id"], r["window"])):
            found.setdefault(r["doc_id"], []).append((r["members"], r["tokens"]))
        assert found == {d: windows_by_hand(sizes, size, overlap) for d, sizes in docs.items()}
    assert spark.sql("SELECT * FROM pack_windows(TABLE(SELECT * FROM some_units WHERE doc_id < 0) PARTITION BY doc_id ORDER BY ordinal)").count() == 0
    for wrong, says in (("TABLE(SELECT doc_id FROM some_units) PARTITION BY doc_id", "misses columns"), ("TABLE(some_units) PARTITION BY doc_id ORDER BY (ordinal), -1", "whole number")):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM pack_windows({wrong})").collect()


def test_cells_give_the_verdicts_of_all_pairs(spark):
    rng = random.Random(5)
    texts = ["Table 1: x", "source: y", "some words", "x" * 120, None, "ALL CAPS"]

    def box():
        x, y = rng.uniform(0, 500), rng.uniform(0, 700)
        return x, y, x + rng.choice([0, 10, 60, 300]), y + rng.choice([0, 8, 12, 200])

    blocks = [(d, p, k, "text", *box(), rng.choice(texts), 612.0, 792.0) for d in range(3) for p in range(3) for k in range(60)]
    blocks += [(9, 0, k, "text", 100.0 + k, 100.0, 120.0 + k, 110.0, "in", 612.0, 792.0) for k in range(4)] + [(None, 0, 1, "text", 1.0, 1.0, 5.0, 5.0, "t", 612.0, 792.0), (1, 1, 999, "text", None, 1.0, 5.0, 5.0, "t", 612.0, 792.0)]
    kind = "doc_id long, page int, block_idx int, type string, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"
    areas = [(d, p, *box()) for d in range(3) for p in range(2) for _ in range(8)] + [(9, 0, 0.0, 0.0, 612.0, 300.0), (1, 0, None, 0.0, 1.0, 1.0)]
    b, z = spark.createDataFrame(blocks, kind).repartition(3), spark.createDataFrame(areas, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    verdict = lambda df: sorted(((r["doc_id"], r["page"], r["block_idx"], r["_drop"], r["_inside"], r["_alone"]) for r in df.collect()), key=str)
    want = verdict(layout.zone_verdicts(b, z))
    for size in (7.0, spatial.CELL, 5000.0):
        assert verdict(spatial.zone_verdicts(b, z, size)) == want
    assert sum(r[3] for r in want) > 10 and any(r[5] for r in want)
    kept = lambda df: sorted((r["block_idx"] for r in df.collect()))
    assert kept(spatial.outside_zones(b, z)) == kept(layout.outside_zones(b, z))
    pairs = spatial.meeting_pairs(b, z, 7.0)
    assert pairs.count() == pairs.distinct().count()


def slow_clock():
    now = [0.0]
    return lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)


def test_numbers_are_dealt_in_turn():
    for counts in ([3, 0, 1], [0, 0, 5], [2, 2, 2], [1], [4, 1, 3, 1]):
        every = sorted(n for t in range(len(counts)) for n in pacing.numbers(counts, t))
        assert every == list(range(sum(counts)))
        assert all(pacing.numbers(counts, t) == sorted(pacing.numbers(counts, t)) for t in range(len(counts)))


def test_tasks_keep_one_rate(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") == 7, None).otherwise(F.col("id").cast("string")).alias("content")).coalesce(1)

    def call(text):
        if text == "13":
            raise ValueError("no")
        return text * 2

    got = pacing.paced_calls(rows, call, 10.0, 3, slow_clock).collect()
    assert {r["id"]: r["response"] for r in got} == {i: None if i == 13 else "" if i == 7 else str(i) * 2 for i in range(100)}
    assert [r["error"] for r in got if r["error"]] == ["ValueError: no"] and sorted(r["number"] for r in got) == list(range(100))
    times = sorted(r["at"] for r in got)
    assert all(sum(a <= t < a + 1 - 1e-9 for t in times) <= 10 for a in times) and times[-1] == pytest.approx(9.9)


def test_writes_count_what_they_write(spark, tmp_path):
    units = spark.createDataFrame([("paragraph", "native"), ("table", "ocr_x"), ("table", None), (None, "my_ocr")], "unit_type string, source string")
    seen = observed.write_observed(units, str(tmp_path / "u"))
    assert seen == {"total_units": 4, "text_units": 1, "table_units": 2, "ocr_units": 2, "has_tables": True, "has_images": True}
    assert observed.write_observed(units.limit(0), str(tmp_path / "e")) == {"total_units": 0, "text_units": 0, "table_units": 0, "ocr_units": 0, "has_tables": False, "has_images": False}
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4


WHOLE = {"enhancements": [{"type": "a", "content": 'x "y" \\ z\n}', "source_units": ["u]", "v"], "confidence": 0.5, "priority": 3, "more": {"k": [1, {"z": None}]}}, {"type": "b", "content": "é 漢 ,]", "ok": True}]}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_cut_anywhere_is_json(indent):
    text = json.dumps(WHOLE, indent=indent)
    for n in range(1, len(text) + 1):
        got = json.loads(json_repair.close_json(text[:n]))
        for have, want in zip(got.get("enhancements") or [], WHOLE["enhancements"], strict=False):
            assert str(want["content"]).startswith(str(have.get("content") or ""))
    assert json.loads(json_repair.close_json(f"so: {text} and so on }} ]")) == WHOLE
    assert json_repair.close_json("nothing here") == json_repair.close_json("") == ""
    assert json.loads(json_repair.close_json('[1, {"a": [2, 3}')) == [1, {"a": [2, 3]}]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12), st.data())
def test_any_json_cut_anywhere_is_json(value, data):
    text = json.dumps({"enhancements": [value]})
    json.loads(json_repair.close_json(text[: data.draw(st.integers(1, len(text)))]))


def test_responses_are_recovered_by_the_first_strategy_that_works(spark):
    item = '{"type": "a", "content": "x"}'
    cases = [
        (f'{{"enhancements": [{item}]}}', 0, "x"), (f'```json\n{{"enhancements": [{item}]}}\n```', 1, "x"), ('{"enhancements": [{"type": "a", "content": "x",},],}', 2, "x"), ('{"enhancements": [{"type": "a", "content": "x\n}]}', 2, "x"),
        ('{"enhancements": [{“type”: “a”, "content": "x"}]}', 3, "x"), (f'Well {{"enhancements": [{item}]}} done', 4, "x"), (f'{{bad, "enhancements": [{item}], ', 5, "x"), (f"items: [{item}]", 6, "x"),
        ('{"enhancements": [{"type": "a", "content": "cut he', 7, "cut he"), ("no", None, None), ("", None, None), (None, None, None), ('{"other": 1}', None, None), ('{"enhancements": "text"}', None, None),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(cases)], "k int, response string")
    got = {r["k"]: (r["strategy"], r["items"][0]["content"] if r["items"] else None) for r in json_repair.recover(df).collect()}
    assert got == {k: (n, c) for k, (_, n, c) in enumerate(cases)}
    plain = {r["k"]: r["strategy"] for r in json_repair.recover(df, cut_off=False).collect()}
    assert plain == {k: None if n == 7 else n for k, (_, n, _) in enumerate(cases)}


def test_a_field_of_another_type_costs_the_field_alone(spark):
    df = spark.createDataFrame([('{"enhancements": [{"type": 5, "content": "c", "confidence": "high", "priority": "2", "source_units": "u"}, 7, null]}',)], "response string")
    first, second, third = json_repair.recover(df).first()["items"]
    assert (first["type"], first["content"], first["confidence"], first["priority"]) == ("5", "c", None, 2) and first["source_units"] is None
    assert second["content"] is None and (third is None or third["content"] is None)


def test_broken_answers_keep_their_content(spark):
    rows = spark.createDataFrame([("d", 0, '{"enhancements": [{"type": "a", "content": "' + "x" * 120 + "\n}]}")], "doc_id string, window int, response string")
    assert [r["content"] for r in enrichment.long_enough(enrichment.items_of(rows)).collect()] == ["x" * 120]


class Odd(FixedWidth):
    """Tokens that begin behind every vowel."""

    def starts(self, text):
        return [0, *(k + 1 for k, c in enumerate(text) if c in "aeiou" and k + 1 < len(text))]


def test_markers_stand_at_token_boundaries(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)).strip() or "a" for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    notes = [(k, 0, t[5 : 6 + k % 20], "T", "c", "other") for k, t in enumerate(texts) if len(t) > 30]
    got = enrichment.synthesise(docs, spark.createDataFrame(notes, "doc_id long, ordinal int, anchor string, title string, content string, type string"), Odd).collect()
    woven = {int(r["doc_id"]): r["markdown"].split("\n\n---")[0] for r in got}
    for k, _, anchor, *_ in notes:
        t, starts = texts[k], Odd().starts(texts[k])
        end = t.find(anchor) + len(anchor)
        at = bisect_left(starts, end)
        end = starts[at] if at < len(starts) else len(t)
        assert woven[k] == f"{t[:end]}[^1]{t[end:]}"


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "abcdefghi"), (2, ""), (3, None)], "id int, text string")
    assert {r["id"]: r["tokens"] for r in with_token_counts(df, FixedWidth).collect()} == {1: 2, 2: 0, 3: 0}


def test_partition_values_keep_their_types(spark, tmp_path):
    kind, path, day = "id string, namespace string, version date, n int", str(tmp_path / "t"), datetime.date(2024, 1, 1)
    rows = [("a", "007", day, 1), ("b", "1", day, 1), ("c", None, None, 1), ("d", "", day, 1), ("e", "abc", day, 1), ("f", "7", day, 1)]
    sinks.upsert_partitions(spark, spark.createDataFrame(rows[:2], kind), path)
    sinks.upsert_partitions(spark, spark.createDataFrame(rows[2:], kind), path)
    sinks.upsert_partitions(spark, spark.createDataFrame([("a", "007", day, 2), ("c2", None, None, 2), ("e", "x/y%", day, 2)], kind), path)
    there = lambda: sorted(((r["id"], r["namespace"], r["version"], r["n"]) for r in spark.read.schema(kind).parquet(path).collect()), key=str)
    assert there() == sorted([("a", "007", day, 2), ("b", "1", day, 1), ("c", None, None, 1), ("c2", None, None, 2), ("d", None, day, 1), ("e", "x/y%", day, 2), ("f", "7", day, 1)], key=str)
    names = spark.createDataFrame([("007", "testing"), ("7", "final")], "id string, type string")
    assert sinks.remove_namespaces(spark, path, names, ["007", "abc"], ["abc", "007"]) == ["007"]
    assert {r[0] for r in there()} == {"b", "c", "c2", "d", "e", "f"}
    with pytest.raises(PermissionError):
        sinks.remove_namespaces(spark, path, names, ["7"], ["7"])


def test_file_names_are_as_on_disk(spark, tmp_path):
    names = ["a b.md", "100%25 c+é.md", "x%20y.md"]
    sinks.write_files(spark.createDataFrame([(n, n) for n in names], "file string, text string"), str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in T.read_markdown(spark, str(tmp_path)).collect()} == {n[:-3]: n for n in names}


def test_paragraphs_are_merged_in_one_pass(spark):
    """Nulls merge with nothing, a null text stays null, and a long column takes time in proportion to its blocks."""
    import time

    kind = "doc_id long, page int, column string, block_idx int, x0 double, y0 double, x1 double, y1 double, text string"
    rows = [(1, 0, "left", 0, 0.0, 0.0, 100.0, 10.0, "a"), (1, 0, "left", 1, 0.0, 12.0, 100.0, 22.0, "b."), (1, 0, "left", 2, 0.0, 27.0, 100.0, 37.0, "c"), (1, 0, "left", 3, 0.0, 39.0, 100.0, 49.0, None), (1, 0, "left", 4, 0.0, 51.0, 100.0, None, "e"), (1, 0, "left", 5, 0.0, None, 100.0, 60.0, "f")]
    rows += [(None, None, None, 0, 0.0, 0.0, 100.0, 10.0, "n"), (None, None, None, 1, 1.0, 11.0, 100.0, 21.0, "m")]
    got = sorted(((r["doc_id"], r["paragraph"], r["text"], r["y0"], r["y1"]) for r in layout.merge_paragraphs(spark.createDataFrame(rows, kind).repartition(3)).collect()), key=str)
    assert got == sorted([(1, 0, "f", None, 60.0), (1, 1, "a b.", 0.0, 22.0), (1, 2, None, 27.0, 49.0), (1, 3, "e", 51.0, None), (None, 0, "n m", 0.0, 21.0)], key=str)
    took = []
    for n in (20_000, 80_000):
        column = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.lit("single").alias("column"), F.col("id").cast("int").alias("block_idx"), F.lit(0.0).alias("x0"), (F.col("id") * 100.0).alias("y0"), F.lit(50.0).alias("x1"), (F.col("id") * 100.0 + 10).alias("y1"), F.lit("t").alias("text"))
        begun = time.perf_counter()
        assert layout.merge_paragraphs(column).count() == n
        took.append(time.perf_counter() - begun)
    assert took[1] < 10 * took[0]


def test_registry_files_are_parsed_where_they_are_read(spark, tmp_path):
    files = [("a.yaml", "categories:\n- id: c\n  display_order: 2\n  types:\n  - id: t\n    examples: {x: 1}\n"), ("b.yaml", "other: 1"), ("c.yaml", "categories:\n- id: d\n")]
    sinks.write_files(spark.createDataFrame(files, "file string, text string"), str(tmp_path))
    (row,) = T.read_types(spark, str(tmp_path)).collect()
    assert (row["type_id"], row["category"], row["name"], row["applicable_domains"], row["default_priority"], row["default_enabled"], row["examples"], row["display_order"]) == ("t", "c", "t", ["all"], 5, True, {"x": "1"}, 2)
    sinks.write_files(spark.createDataFrame([("d.yaml", "categories: [{id: e, types: [{name: n}]}]")], "file string, text string"), str(tmp_path))
    with pytest.raises(Exception, match="KeyError"):
        T.read_types(spark, str(tmp_path)).collect()


def test_a_report_of_no_events_has_its_head(spark):
    from folioforge.operators import observe

    none = spark.createDataFrame([], "event_id long, ts timestamp, model string, step string, input_tokens long, output_tokens long")
    text = observe.render_report(observe.with_cost(none, observe.price_table(spark)), F.lit("2024-01-02 03:04:05").cast("timestamp")).first()["markdown"]
    assert "**Generated:** 2024-01-02 03:04:05 UTC\n**Latest event:** 2024-01-02 03:04:05 UTC\n**Total events:** 0" in text and "- Tokens: 0" in text
    one = spark.createDataFrame([(1, 1704164645, "gpt-4.1", None, 1234567, 1000)], "event_id long, ts long, model string, step string, input_tokens long, output_tokens long").withColumn("ts", F.timestamp_seconds("ts"))
    text = observe.render_report(observe.with_cost(one, observe.price_table(spark)), F.lit("2024-01-02 03:04:05").cast("timestamp")).first()["markdown"]
    assert "| `gpt-4.1` | 1,234,567 | 1,000 | $3.7157 | " in text and "- Tokens: 1,235,567" in text and "| `unknown` | 1 | 1,234,567 | 1,000 | " in text


def test_accuracies_are_added_in_the_order_of_rows(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1: the order decides, not how rows are dealt."""
    from folioforge.operators import tabular

    rows = [(page, flavour, page + n, a) for page in range(0, 600, 6) for flavour, values in (("stream", (0.1, 0.2, 0.3)), ("lattice", (0.3, 0.2, 0.1))) for n, a in enumerate(values)]
    t = spark.createDataFrame(rows, "page int, flavour string, row int, accuracy double").withColumn("doc_id", F.lit(1))
    for dealt in (t, t.orderBy(F.desc("row")).repartition(7)):
        assert {r["flavour"] for r in tabular.more_accurate(dealt, order=("row",)).collect()} == {"stream"}


def test_many_ranges_are_few_tasks(spark, tmp_path):
    """The driver gets parts of the plan, not its ranges; a filter on pages leaves parts out."""
    files = {f"{k}.txt": "\n".join(f"{k} {n}" for n in range(1 + k % 8)) for k in range(700)}
    sinks.write_files(spark.createDataFrame(list(files.items()), "file string, text string"), str(tmp_path / "in"), folders=3)
    df = pages.read_pages(spark, str(tmp_path / "in"), f"{__name__}:WidePages", 1)
    assert df.rdd.getNumPartitions() <= pages.MOST_SINGLE
    assert block_rows(df) == by_hand(files, 3)
    late = df.filter("page = 3")
    assert late.rdd.getNumPartitions() < df.rdd.getNumPartitions() / 2
    assert block_rows(late) == [r for r in by_hand(files, 3) if r[2] == 3]


def test_files_are_listed_and_read_by_executors(spark, tmp_path):
    """Files in folders, empty ones, and names as on disk; hidden ones are left out."""
    files = {"a b.md": "x", "100% +é.md": "y", "empty.md": "", "_no.md": "n", "plain": "z"}
    assert sinks.write_files(spark.createDataFrame(list(files.items()), "file string, text string"), str(tmp_path / "in"), folders=4) == 5
    got = {r["doc_id"]: r["text"] for r in T.read_markdown(spark, str(tmp_path / "in")).collect()}
    assert got == {"a b": "x", "100% +é": "y", "empty": "", "plain": "z"}
    blocks = T.read_pdfs(spark, str(tmp_path / "in"), lambda data: [{"page": 1, "block_idx": "0", "type": "text", "bbox": (0, 0, 6, 5), "text": data.decode(), "size": (60, 50)}]).collect()
    assert {(r["doc_id"], r["text"], r["area_ratio"]) for r in blocks} == {("a b", "x", 0.01), ("100% +é", "y", 0.01), ("empty", "", 0.01), ("plain", "z", 0.01)}


def test_registry_files_stay_small(spark, tmp_path, monkeypatch):
    """Parts grow, files don't: a brand has a file for each 10,000 part keys."""
    from folioforge.plans import udf_queries

    spark.range(30_000).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "'t' as p_type", "id % 9 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    sizes, write = [], sinks.write_files
    monkeypatch.setattr(udf_queries.sinks, "write_files", lambda rows, *a: (sizes.extend(r["n"] for r in rows.selectExpr("size(split(text, 'id: t')) - 1 as n").collect()), write(rows, *a))[1])
    got = udf_queries.type_registry(spark, str(tmp_path))
    assert got.select("type_id").distinct().count() == 30_000 and sorted(sizes) == [10_000] * 3


def test_empty_texts_and_odd_blanks_are_blocks(spark, tmp_path):
    """An empty text is one empty line; only blanks part words, and a line of other white space isn't empty."""
    import duckdb

    from folioforge.plans.registry import ORACLES, QUERIES

    texts = ["", " ", "\n", "a\tb", "\t", "a \t b", "\u00a0", "\u00a0x \u3000", "a \u00a0 b", "one\r\ntwo\r", "\n" * 120 + "end", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("paged_blocks", "paged_blocks_filtered", "parsed_blocks"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
