"""Sinks, sources, hooks and folds on hand-made rows, and folds against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.operators import config, enrichment, layout, observe, retrieval, tabular, vector_index
from folioforge.session import scratch
from folioforge.sources import sinks, tables

MARK = re.compile(r"\d+\.?\d*\.?\s*\Z")


def repaired(text):
    """The rule line by line: numbers that follow each other are dealt to as many lines behind them, a number alone takes the next line if that says something."""
    lines = [x.strip() for x in text.split("\n")]
    out = []
    while lines:
        head, rest = lines[0], lines[1:]
        if not MARK.match(head) or not rest:
            out.append(head)
            lines = rest
        elif not MARK.match(rest[0]):
            out.append(f"{head} {rest[0]}" if rest[0] else head)
            lines = rest[1:] if rest[0] else rest
        else:
            n = next((k for k, x in enumerate(lines) if not MARK.match(x)), len(lines))
            for k in range(n):
                body = lines[n + k] if n + k < len(lines) else ""
                out.append(f"{lines[k]} {body}" if body else lines[k])
            lines = lines[2 * n :]
    return "\n".join(out)


def test_numbered_sections_against_the_rule(spark):
    rng = random.Random(4)
    parts = ["1.", "2.1", "3", "", "text", " more text ", "4. and", "12.34."]
    texts = ["1.\n\nText", "1.\nText", "1.46\n1.47\nTIN\nother", "7", "", "1.\n2."] + ["\n".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in enrichment.repair_numbered_sections(rows).collect()}
    assert got[0] == "1.\n\nText" and got[1] == "1. Text" and got[2] == "1.46 TIN\n1.47 other"
    assert [got[i] for i in range(len(texts))] == [repaired(t) for t in texts]


def test_windows_against_a_plain_loop(spark):
    rng = random.Random(5)
    docs = {i: [rng.randrange(0, 9) for _ in range(rng.randrange(1, 40))] for i in range(30)}
    rows = [(i, k, f"u{k}", n) for i, sizes in docs.items() for k, n in enumerate(sizes)]
    units = spark.createDataFrame(rows, "doc_id long, ordinal long, unit_id string, tokens long")
    got: dict = {}
    for r in enrichment.pack_windows(units, 15, 6).orderBy("doc_id", "window").collect():
        got.setdefault(r["doc_id"], []).append((r["members"], r["tokens"]))
    for i, sizes in docs.items():
        want, cur = [], []
        for k, n in enumerate(sizes):
            if cur and sum(sizes[x] for x in cur) + n > 15:
                want.append(cur)
                cur = [x for x in cur if sum(sizes[y] for y in cur if y >= x) <= 6]
            cur = [*cur, k]
        want.append(cur)
        assert got[i] == [([f"u{x}" for x in w], sum(sizes[x] for x in w)) for w in want]


def test_calls_back_off_and_keep_pace(spark):
    w = spark.createDataFrame([("d", 0, "x"), ("e", 0, "y")], "doc_id string, window int, content string").coalesce(1)
    said = []

    def fails(doc, content):
        raise ValueError(content)

    def sleeps(seconds):
        raise TimeoutError(f"slept {seconds}")

    rows = enrichment.attempts(w, fails, 3, back_off=0.0).collect()
    assert [(r["attempt"], r["final"], r["response"]) for r in rows if r["doc_id"] == "d"] == [(1, False, None), (2, False, None), (3, True, None)] and said == []
    with pytest.raises(Exception, match="slept 2.0"):
        enrichment.attempts(w, fails, 3, back_off=2.0, sleep=sleeps).collect()
    with pytest.raises(Exception, match="slept"):
        enrichment.attempts(w, None, 1, rate=0.1, tasks=5, sleep=sleeps).unionByName(enrichment.attempts(w.union(w).union(w).union(w).union(w).union(w).coalesce(1), None, 1, rate=0.1, sleep=sleeps)).collect()

    def picky(answer):
        if "x" in answer:
            raise ValueError("too many invalid types")

    got = {r["doc_id"]: r for r in enrichment.generate(w, lambda d, c: c, 2, back_off=0.0, check=picky).collect()}
    assert got["d"]["response"] is None and "invalid types" in got["d"]["error"] and got["e"]["response"] == "y"


def test_rows_without_namespace_are_not_deleted(spark):
    chunks = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "z")], "namespace string, id string")
    names = spark.createDataFrame([("a", "testing")], "id string, type string")
    assert sorted(r["id"] for r in sinks.delete_namespace(chunks, names, ["a"]).collect()) == ["y", "z"]


def test_namespaces_are_removed_from_disk(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([("a b/c", "v1", 1), ("f", "v1", 2), (None, "v1", 3)], "namespace string, version string, id int").write.partitionBy("namespace", "version").parquet(path)
    names = spark.createDataFrame([("a b/c", "testing"), ("f", "final")], "id string, type string")
    with pytest.raises(ValueError):
        sinks.remove_namespaces(spark, path, names, ["a b/c"], [])
    with pytest.raises(PermissionError):
        sinks.remove_namespaces(spark, path, names, ["a b/c", "f"], ["a b/c", "f"])
    assert sinks.remove_namespaces(spark, path, names, ["a b/c", "zzz"], ["zzz", "a b/c"]) == ["a b/c"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]
    assert sinks.remove_namespaces(spark, str(tmp_path / "none"), names, ["a b/c"], ["a b/c"]) == []


def test_repeated_new_keys_keep_the_same_row(spark):
    old = spark.createDataFrame([("1", "old", 0)], "id string, text string, ts int")
    new = spark.createDataFrame([("1", "b", 2), ("1", "a", 3), ("1", "c", 2)], "id string, text string, ts int")
    assert [r["text"] for r in sinks.keep_latest(old, new.repartition(3)).collect()] == ["c"]
    assert [r["text"] for r in sinks.keep_latest(old, new, "id", ("ts",)).collect()] == ["a"]


def test_json_files_of_arrays(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"table_id": "t1", "headers": ["a"],\n "rows": [["1"], ["2"]], "fixes": {"merged_tokens": 3}}, {"table_id": "t2"}]')
    got = {r["table_id"]: r for r in tables.read_json(spark, str(tmp_path), tables.TABLES).collect()}
    assert got["t1"]["rows"] == [["1"], ["2"]] and got["t1"]["fixes"] == {"merged_tokens": 3} and got["t2"]["rows"] is None


def test_wrong_switches_are_errors(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"client_name": "P", "enhancement_types": {"a": 2}, "domains": {}}')
    with pytest.raises(Exception, match="neither 0 nor 1"):
        tables.read_profiles(spark, str(tmp_path)).collect()


def test_namespaces_are_sorted_and_the_total_is_last(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "namespace string")
    assert [(r["namespace"], r["total_chunks"]) for r in retrieval.namespace_stats(rows).collect()] == [(None, 1), ("a", 1), ("b", 2), (None, 4)]


def test_zero_vectors_score_zero(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id = 2").select(F.col("embedding").alias("q"))
    assert [(r["vec_id"], r["score"]) for r in retrieval.cosine_topk(v, q, 3).collect()] == [(2, 1.0), (1, 0.0), (3, -1.0)]
    none = retrieval.hash_embedding(spark.createDataFrame([(1, None), (2, " ")], "vec_id long, text string"))
    assert retrieval.cosine_topk(none, q, 3).count() == 2


def test_queries_in_several_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = sorted(map(tuple, retrieval.multi_query_topk(v, q, 4, "vec_id", "label").collect()))
    monkeypatch.setattr(vector_index, "QUERY_SHARD", 7)
    assert sorted(map(tuple, retrieval.multi_query_topk(v, q, 4, "vec_id", "label").collect())) == whole and len(whole) == 50 * 3 * 4


def test_unknown_namespaces_are_never_active(spark):
    log = spark.createDataFrame([(1, "a", "x"), (3, "gone", "y"), (2, "b", "z")], "ts long, namespace string, switched_by string")
    names = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, client_profile string")
    assert config.active_namespace(log, names).first()["namespace"] == "b" and config.active_namespace(log).first()["namespace"] == "gone"


def test_stages_go_back_and_forth(spark):
    e = spark.createDataFrame([(1, "d", "2024-01-01 00:00:00", "ready"), (2, "d", "2024-01-01 00:00:01", "uploaded"), (3, "d", "2024-01-01 00:00:02", "x"), (4, "d", "2024-01-01 00:00:03", "uploaded")], "event_id long, doc_id string, ts string, stage string")
    got = observe.transitions(e.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("event_id").collect()
    assert [r["verdict"] for r in got] == ["first", "back", "unknown", "same"]


def test_raw_tables_with_odd_cells(spark):
    rows = [("d", 1, 0, [[None, "b"], ["1", None], ["x"]], *[None] * 4, 612.0, 792.0, None), ("d", 1, 1, [["only"]], *[None] * 4, 612.0, 792.0, 0), ("d", 1, 2, [["h"], ["11-Feb12-Feb"]], 0.0, 10.0, 600.0, 20.0, 612.0, 792.0, 180)]
    got = {r["ordinal"]: r for r in tabular.clean_tables(spark.createDataFrame(rows, tables.RAW_TABLES)).collect()}
    assert set(got) == {0, 2} and got[0]["headers"] == ["Col0", "b"][:1] and got[0]["rows"] == [["1"], ["x"]]
    assert got[2]["rows"] == [["11-Feb | 12-Feb"]] and got[2]["n_fixed"] == 1 and (got[2]["y0"], got[2]["y1"]) == (772.0, 782.0)


def test_edges_are_judged_by_the_top_of_a_block(spark):
    kind = "doc_id string, page int, block_idx string, type string, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"
    rows = [("d", 1, "a", "text", 0.0, 735.0, 50.0, 745.0, "foot", 612.0, 792.0), ("d", 1, "b", "text", 0.0, 743.0, 50.0, 753.0, "foot", 612.0, 792.0), ("d", 1, "c", "figure", 0.0, 0.0, 9.0, 9.0, None, 612.0, 792.0)]
    assert sorted(r["block_idx"] for r in layout.edge_filter(spark.createDataFrame(rows, kind)).collect()) == ["a", "c"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert scratch(spark) != scratch(spark)

    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Elsewhere()
        conf = Elsewhere()

    with pytest.raises(RuntimeError):
        scratch(Session())
