"""Operators on hand-made rows: rules, properties and the cases that once went wrong."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import cells, text
from folioforge.operators import assembly, enrichment, layout, observe, retrieval
from folioforge.sources import sinks, tables
from folioforge.streaming import ledger


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_dates_of_all_kinds(spark):
    got = one(spark, text.dates, "Kamis, 13 Februari 2025 and January 2, 2024, 2025-02-13, 17/03/2024")
    assert got == ["13 Februari 2025", "17 03 2024", "2025 02 13", "January 2 2024", "Kamis 13 Februari 2025"]


def test_bracketed_percent_stays_and_number_turns(spark):
    assert one(spark, cells.split_cell, "(0.76%)") == "(0.76%)"
    assert one(spark, cells.split_cell, "(0.50)") == "-0.50"
    assert one(spark, cells.split_cell, "3.00%0.50%") == "3.00% | 0.50%"
    assert one(spark, cells.split_cell, "44593.65 44368.5") == "44593.65 | 44368.5"
    assert one(spark, cells.split_cell, "11-Feb12-Feb") == "11-Feb | 12-Feb"


def test_markdown_tables_keep_digits(spark):
    names, rows = F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("4.50"), F.lit("x")))
    assert spark.range(1).select(cells.markdown_table(names, rows).alias("t")).first()["t"] == "| a | b |\n|---|---|\n| 4.50 | x |"


def test_white_space_and_null_text(spark):
    assert one(spark, text.clean_white_space, " a  b \n\n\n\n c") == "a b\n\nc"
    assert one(spark, text.emails, None) == []
    assert one(spark, text.token_estimate, None) == 0
    assert one(spark, text.language, None) == "mixed"


def test_packing_keeps_every_unit_and_overlaps(spark):
    units = spark.createDataFrame([(1, i, f"u{i}", n) for i, n in enumerate([5, 5, 5, 20, 3, 3, 3])], "doc_id long, ordinal long, unit_id string, tokens long")
    got = enrichment.pack_windows(units, 12, 6).orderBy("window").collect()
    assert [r["members"] for r in got] == [["u0", "u1"], ["u1", "u2"], ["u2", "u3"], ["u4", "u5", "u6"]]
    assert {m for r in got for m in r["members"]} == {f"u{i}" for i in range(7)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_splitter_covers_text_within_size(body, size, overlap):
    spans = retrieval.split_recursively(body, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    assert all(body[i].isspace() or body[i] == "." or i in covered for i in range(len(body))) and all(body[i].isspace() for i in range(len(body)) if i not in covered)


def test_json_recovery(spark):
    body = '{"enhancements": [{"type": "t", "title": "x", "content": "c", "confidence": 0.9}]}'
    for raw in (body, f"```json\n{body}\n```", body.replace("}]}", "},]}"), f"well: {body} bye", '[{"type": "t", "title": "x"}]'):
        assert [i["title"] for i in one(spark, enrichment.recover_json, raw)] == ["x"], raw
    assert one(spark, enrichment.recover_json, "nothing") == []
    assert one(spark, enrichment.recover_json, None) == []


def test_window_with_too_many_invalid_types_goes(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 0, "x"), (1, 1, "a"), (1, 1, "a"), (1, 1, "a"), (1, 1, "x")], "doc_id int, window int, type string")
    got = enrichment.valid_types(items, spark.createDataFrame([("a",)], "type string")).collect()
    assert [(r["window"], r["type"]) for r in got] == [(1, "a")] * 3


def test_footnotes_never_enter_tables_or_markers(spark):
    docs = spark.createDataFrame([("d", "Intro text here.\n| a | b |\n|---|---|\n| 1 | 2 |\nend")], "doc_id string, text string")
    notes = spark.createDataFrame([("d", 0, "| 1 |", "T0", "c", "x"), ("d", 1, "Intro", "T1", "c", "x"), ("d", 2, "Intro", "T2", "c", "x"), ("d", 3, "missing", "T3", "c", "x")], "doc_id string, ordinal int, anchor string, title string, content string, type string")
    r = enrichment.synthesise(docs, notes).first()
    assert (r["anchored"], r["appendixed"]) == (3, 1)
    assert "Intro[^1][^2] text" in r["markdown"] and "| 1 | 2 |[^3]\n" in r["markdown"] and "|---|---|\n" in r["markdown"]
    assert "- **Note: T3** c" in r["markdown"]


def test_paragraphs_fold_on_the_grown_box(spark):
    rows = [("d", 1, "single", "a", 0.0, 0.0, 100.0, 10.0, "One"), ("d", 1, "single", "b", 0.0, 15.0, 100.0, 25.0, "two."), ("d", 1, "single", "c", 0.0, 60.0, 100.0, 70.0, "Three")]
    b = spark.createDataFrame(rows, "doc_id string, page int, column string, block_idx string, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r["text"] for r in layout.merge_paragraphs(b).orderBy("paragraph").collect()] == ["One two.", "Three"]


def test_two_columns_read_one_after_the_other(spark):
    rows = [("d", 1, c, float(y), float(y + 10), x, f"{c}{y}") for c, x in (("left", 0.0), ("right", 300.0)) for y in (0, 20)]
    u = spark.createDataFrame(rows, "doc_id string, page int, column string, y0 double, y1 double, x0 double, unit_id string")
    assert [r["unit_id"] for r in assembly.reading_order(u).orderBy("place").collect()] == ["left0", "left20", "right0", "right20"]
    assert [r["unit_id"] for r in assembly.reading_order(u, legacy=True).orderBy("place").collect()] == ["left0", "right0", "left20", "right20"]


def test_ledger_costs_and_empty_ledger(spark):
    e = spark.createDataFrame([(1, 1.0, "embed", "text-embedding-3-small", 124903, 0), (2, 2.0, "chat", "gpt-4.1", 5844, 1477)], "event_id int, ts double, step string, model string, input_tokens long, output_tokens long")
    c = observe.with_cost(e, observe.price_table(spark))
    t = observe.totals(c).first()
    assert (t["events"], t["input_tokens"], t["output_tokens"], t["cost_usd"]) == (2, 130747, 1477, 0.0378)
    assert {r["model"]: r["cost_usd"] for r in observe.usage(c).filter("level = 1").collect()} == {"text-embedding-3-small": 0.0025, "gpt-4.1": 0.0353}
    assert "Total tokens: 132224, cost: $0.0378" in observe.render_summary(c).first()["markdown"]
    zero = observe.totals(c.limit(0)).first()
    assert (zero["events"], zero["input_tokens"], zero["cost_usd"]) == (0, 0, 0.0)


def test_progress_at_the_end(spark):
    assert one(spark, observe.progress, "ready") == 90
    assert one(spark, lambda x: observe.progress(x, corrected=True), "ready") == 100
    assert one(spark, observe.progress, "nowhere") == 0


def test_final_namespaces_cannot_be_deleted(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "namespace string, id string")
    names = spark.createDataFrame([("a", "testing"), ("b", "final")], "id string, type string")
    assert [r["id"] for r in sinks.delete_namespace(chunks, names, ["a", "zzz"]).collect()] == ["y"]
    with pytest.raises(PermissionError):
        sinks.delete_namespace(chunks, names, ["a", "b"])


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "v")
    kind = "id string, text string, namespace string, version string"
    sinks.upsert_partitions(spark, spark.createDataFrame([("1", "a", "n", "v1"), ("2", "b", "m", "v1")], kind), path)
    sinks.upsert_partitions(spark, spark.createDataFrame([("1", "c", "n", "v1"), ("3", "d", "n", "v1")], kind), path)
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(path).collect()) == [("1", "c"), ("2", "b"), ("3", "d")]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nbody")
    got = tables.read_markdown(spark, str(tmp_path)).first()
    assert (got["doc_id"], got["text"]) == ("a", "# A\n\nbody")
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts": 1.0, "step": "chat", "model": "m", "input_tokens": 1, "output_tokens": 2, "meta": {}}\n\n')
    assert tables.read_ledger(spark, str(log)).count() == 1
    (tmp_path / "client_x.json").write_text(json.dumps({"enhancement_types": {"_c": "note", "a": 1}, "domains": {"d": 0}}))
    (tmp_path / "client_template.json").write_text("{}")
    assert [r["profile"] for r in tables.list_profiles(spark, str(tmp_path)).collect()] == ["client_x"]
    assert tables.read_profile(str(tmp_path / "client_x.json"))["enhancement_types"]["a"] == 1
    (tmp_path / "bad.json").write_text(json.dumps({"domains": {"d": 2}}))
    with pytest.raises(ValueError):
        tables.read_profile(str(tmp_path / "bad.json"))


def test_segments_meet_chunks_once(spark):
    c = spark.createDataFrame([(1, 0, 0, 1800), (1, 1, 1450, 3250)], "doc_id int, chunk int, char_start int, char_end int")
    s = spark.createDataFrame([(1, "a", 0, 1450), (1, "b", 1450, 1800), (1, "c", 1799, 5000), (1, "d", 3250, 3300)], "doc_id int, segment_id string, char_start int, char_end int")
    assert {r["chunk"]: r["segment_ids"] for r in retrieval.chunk_segments(c, s).collect()} == {0: ["a", "b", "c"], 1: ["b", "c"]}


def test_streams_give_what_tables_give(spark, data, tmp_path):
    rows = tables.table(spark, data, "events").select("ts", "user_id", F.col("event_type").alias("step"), F.col("value").cast("long").alias("input_tokens"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ledger.usage_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = ledger.usage_by_window(rows)
    assert spark.table("usage").exceptAll(want).count() == 0 and want.exceptAll(spark.table("usage")).count() == 0
    assert ledger.sessions(rows).agg(F.sum("events")).first()[0] == rows.count()


def test_uploads_are_all_or_nothing(spark):
    u = spark.createDataFrame([(1, "application/pdf"), (1, "text/plain"), (2, "application/pdf"), (3, None)], "batch_id int, content_type string")
    assert {r["batch_id"]: r["accepted"] for r in tables.accept_uploads(u).collect()} == {1: False, 2: True, 3: False}


def test_pace_waits_once_the_bucket_is_empty():
    from folioforge.operators.config import Pace

    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = Pace(rate=4, tasks=2, capacity=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(6):
        p.wait()
    assert slept == pytest.approx([0.5, 0.5, 0.5])


def test_unit_lists_of_four_shapes(spark):
    from folioforge.operators.config import unit_list

    u = '{"unit_id": "a", "content": "c"}'
    for raw in (f"[{u}]", f'{{"units": [{u}]}}', f'{{"content_units": [{u}]}}', f'{{"a": {u}}}'):
        assert [(x["unit_id"], x["content"]) for x in one(spark, unit_list, raw)] == [("a", "c")], raw
    assert one(spark, unit_list, "nonsense") == [] and one(spark, unit_list, None) == []


def test_kmeans_columns_split_where_the_gap_is(spark):
    rows = [("d", 1, "text", float(x), float(x + 10), 600.0) for x in (0, 5, 10, 15, 20, 400, 405, 410, 415, 420)]
    b = spark.createDataFrame(rows, "doc_id string, page int, type string, x0 double, x1 double, page_width double")
    r = layout.detect_columns_kmeans(b).first()
    assert r["layout"] == "two_column" and 25 < r["boundary"] < 405
    assert layout.detect_columns_kmeans(b.limit(6)).first()["layout"] == "single"


def test_zone_fallback_keeps_a_page_alive(spark):
    kind = "doc_id string, page int, block_idx string, type string, x0 double, y0 double, x1 double, y1 double, text string"
    b = spark.createDataFrame([("d", 1, "a", "text", 0.0, 0.0, 50.0, 20.0, "plain text"), ("d", 1, "b", "text", 10.0, 10.0, 20.0, 20.0, "plain text"), ("e", 1, "c", "text", 0.0, 0.0, 50.0, 20.0, "plain text"), ("e", 1, "d", "text", 0.0, 300.0, 50.0, 320.0, "plain text")], kind)
    z = spark.createDataFrame([("d", 1, 0.0, 0.0, 45.0, 40.0), ("e", 1, 0.0, 0.0, 45.0, 40.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["block_idx"] for r in layout.outside_zones(b, z).collect()) == ["a", "d"]


def test_versions_and_sources(spark):
    r = spark.createDataFrame([(1, 1, "v1", 7, 0.9), (1, 1, "v2", 8, 0.8), (1, 2, "v2", 9, 0.7)], "query_id long, rank int, version string, id long, score double")
    got = {x["rank"]: (x["v1_id"], x["v2_id"]) for x in retrieval.compare_versions(r).collect()}
    assert got == {1: (7, 8), 2: (None, 9)}
    long = spark.createDataFrame([(1, 0.5, "word " * 200, "v2")], "id long, score double, text string, version string")
    s = retrieval.sources(long).first()
    assert s["snippet"].endswith("word...") and len(s["snippet"]) <= 403 and json.loads(s["metadata"]) == {"version": "v2"}


def test_failing_hooks_become_rows(spark):
    def broken(*_):
        raise RuntimeError("no")

    c = spark.createDataFrame([(1, "text", "why?")], "query_id long, context string, question string")
    r = retrieval.answer(c, generate=broken).first()
    assert (r["status"], r["answer"]) == ("error", None) and "RuntimeError" in r["error"]
    w = spark.createDataFrame([("d", 0, "x")], "doc_id string, window int, content string")
    assert "RuntimeError" in enrichment.generate(w, broken).first()["error"]


def test_every_window_of_a_long_document_is_enriched(spark, tmp_path):
    from folioforge.plans.registry import QUERIES

    long = " ".join(f"w{i}" for i in range(20_000))  # over three windows of 10,000 tokens
    rows = [(1, long), (2, " ".join(f"short{i}" for i in range(70))), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["enrichment_flow"](spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["anchored"], got["1"]["appendixed"]) == (4, 0) and len(long) // 4 > 3 * 8_500
    assert (got["2"]["anchored"], got["2"]["appendixed"]) == (1, 0) and (got["3"]["anchored"], got["4"]["anchored"]) == (0, 0)
    starts = [int(n.split(": **")[1].split()[1][1:]) for n in got["1"]["markdown"].split("\n") if n.startswith("[^")]
    assert starts[0] == 0 and starts == sorted(starts) and starts[-1] > 14_000


def test_notes_go_by_rank(spark, tmp_path):
    from folioforge.plans.registry import QUERIES

    # double blanks, so that no title is found; percentages in the last window alone make it financial
    text = "  ".join([f"w{i}" for i in range(20_000)] + [f"{i}%" for i in range(10, 60)])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["enrichment_flow"](spark, str(tmp_path)).first()
    assert got["anchored"] == 0 and got["appendixed"] > 3
    starts = [int(n.split(": w")[1].split()[0]) for n in got["markdown"].split("\n") if n.startswith("- **")]
    assert starts[0] == max(starts) and starts[1:] == sorted(starts[1:])


def test_short_anchors_are_found_and_fallbacks_hold(spark, tmp_path):
    from folioforge.plans.registry import QUERIES

    text = "zero one two three four five six seven eight nineteen ten eleven twelve"
    spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "two three"), (2, "one two three four five six seven eight nine"), (3, "zero one two three four five six seven eight nineteen ten"), (4, "hree four"), (5, "absent"), (6, None), (7, "nothing here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r["item_id"], r["doc_id"], r["position"]) for r in QUERIES["anchor_find"](spark, str(tmp_path)).collect())
    assert got == [(i, 1, text.index(t) + 1) for i, t in items[:4]] + [(7, 2, 1)]
    assert {r["doc_id"]: r["footnotes"] for r in QUERIES["footnote_counts"](spark, str(tmp_path)).collect()} == {1: 4, 2: 1}
    tries = ["four five", "  four five ", "FOUR Five", "four five six seven eight nineteen~", "~four five six seven eight nine", "five six seven eight nineteen!", "", "gone"]
    rows = spark.createDataFrame([(i, text, a) for i, a in enumerate(tries)], "i int, text string, anchor string")
    at = [r["p"] for r in rows.select("i", enrichment.anchor_position(F.col("text"), F.col("anchor")).alias("p")).orderBy("i").collect()]
    four = text.index("four") + 1
    assert at == [four, four, four, four, four, 0, 0, 0]
