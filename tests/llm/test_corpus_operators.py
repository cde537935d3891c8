"""SentencePiece, near duplicates, decontamination, substring dedup and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import op1_sentencepiece as sp
from folioforge.llm import op4_jaccard as jac
from folioforge.llm import op7_decontaminate as leak
from folioforge.llm import op9_substrings as sub
from folioforge.llm.common import table, tokenizer_path

from .conftest import sentence


@pytest.fixture(scope="module")
def model():
    return sp.Model.load(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


# --- SentencePiece


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=" \n\tabcdehinorst,.;\r=(){}é漢\U0001f600▁\0", max_size=60))
def test_units_and_merges_give_the_library_s_ids(text, model, library):
    ids = [i for u in sp.units(text) for i in sp.merge_unit(u, model)]
    assert ids == library.encode(text)
    cut = [i for u in sp.units(text) for p in (sp.cut_sign(u, model) or (u,)) for i in sp.merge_unit(p, model)]
    assert cut == ids
    long = "".join(sp.units(text * 9))
    assert sp.merge_unit(long, model) == library.encode(text * 9) if "\n" not in long and long else True
    assert "".join(sp.units(text)) == ("▁" + text.replace(" ", "▁") if text else "")


def test_lattice_fold_is_the_merge_rule(spark, model):
    rng = random.Random(3)
    words = {"▁" * rng.randrange(4) + "".join(rng.choice("abcdehinorstué漢x") for _ in range(rng.randrange(0, 14))) for _ in range(300)} - {""}
    words |= {"\n", "▁" * 17, "▁international", "\U0001f600a", "▁" + "ab" * 29}
    got = {r["unit"]: r["ids"] for r in sp.encode_units(spark.createDataFrame([(w,) for w in sorted(words)], "unit string"), model).collect()}
    assert got == {w: sp.merge_unit(w, model) for w in words}


def test_viterbi_fold_is_the_best_path(spark, model):
    toy = sp.Model(["<unk>", *"abcd", "ab", "bc", "cd", "abc", "bcd"], [0.0, -3, -3.5, -3, -4, -4.5, -4, -5, -6.5, -6], "unigram", 0, None)
    toy.text = {p: i for i, p in enumerate(toy.pieces) if i}
    toy.rank = dict.fromkeys(toy.text, 0)
    toy.longest = 3
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdz") for _ in range(rng.randrange(1, 9))) for _ in range(80)})
    got = {r["unit"]: r["ids"] for r in sp.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), toy).collect()}
    score = lambda ids: sum(toy.scores[i] if i else -16.5 for i in ids)
    for w in words:
        assert score(got[w]) == pytest.approx(score(sp.best_path(w, toy))), w


def test_round_trip_of_odd_rows(docs, empty, library):
    got = sp.decode(sp.encode(docs, most=5)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert sp.sentencepiece_round_trip(empty).collect() == []


def test_frequent_units_keep_whole_counts(spark):
    c = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 3), ("e", 1)], "unit string, n long")
    assert {r["unit"] for r in sp.frequent_units(c, 3).collect()} == {"a", "b"}
    assert sp.frequent_units(c, 1).collect() == [] and sp.frequent_units(c, 9).count() == 5


# --- near duplicates


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    by = defaultdict(list)
    for i in sorted(i for i, _ in rows if i is not None):
        by[sets[i]].append(i)
    reps = {v[0]: k for k, v in by.items() if k}
    up = {i: i for i in reps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    ids = sorted(reps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(reps[a] & reps[b])
            if both >= 0.8 * (len(reps[a]) + len(reps[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    out = []
    for i, _ in rows:
        if i is None:
            out.append((None, None, 0, 0))
        elif not sets[i]:
            out.append((i, i, 0, 0))
        else:
            rep = by[sets[i]][0]
            out.append((i, root(rep), links[rep], len(by[sets[i]]) - 1))
    return sorted(out, key=str)


def classes(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jac.jaccard_join(df).collect()), key=str)


def test_near_duplicates_of_odd_rows(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert classes(docs) == brute_classes(rows)
    assert classes(empty) == []
    kept = jac.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, c, _, _ in classes(docs) if c is not None})


def test_a_large_group_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jac, "BLOCK", 8)
    base = sentence(11, 150).split()
    rng = random.Random(1)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(1000 + i, sentence(100 + i, 60)) for i in range(40)]
    assert classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_classes(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in jac.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_depth_reaches_the_recall():
    d = jac.prefix_depth()
    assert 1 - (1 - 0.8**d) ** jac.TREES >= jac.RECALL and 1 - (1 - 0.8 ** (d + 1)) ** jac.TREES < jac.RECALL


# --- decontamination


def distance(a, b):
    """Smallest edit distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_with_edits_are_found_and_bounded(spark):
    rng = random.Random(9)
    items = [(k, sentence(200 + k, 20)) for k in range(12)]
    rows, want = [], set()
    for k in range(60):
        item, body = rng.choice(items)
        text = list(body)
        for _ in range(rng.randrange(0, 20)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        whole = f"{sentence(300 + k, 20)} {''.join(text).upper() if k % 3 else ''.join(text)} {sentence(400 + k, 15)}"
        rows.append((k, whole))
        folded = whole.encode().translate(leak.FOLD)
        for i, b in items:
            raw = b.encode().translate(leak.FOLD)
            if distance(raw, folded) <= leak.Filter([(i, b.encode())]).edits[0]:
                want.add((k, i))
    got = leak.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 10
    assert all(distance(dict(items)[r["item_id"]].encode(), dict(rows)[r["doc_id"]].encode()[r["start"] : r["end"]].translate(leak.FOLD)) <= r["edits"] for r in got)


def test_items_that_share_an_id_keep_their_own_sizes(spark):
    items = [sentence(40, 9), sentence(41, 14), sentence(42, 10), "short one", "another short"]
    bench = spark.createDataFrame(list(zip([1, 1, None, None, 1], items, strict=True)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"head {t} tail") for k, t in enumerate(items)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["item_bytes"]) for r in leak.find_leaks(docs, bench).collect())
    assert got == [(k, -1 if k in (2, 3) else 1, len(t)) for k, t in enumerate(items)]


def test_leak_edges(spark, docs, empty):
    items = spark.createDataFrame([(1, sentence(2, 40)), (2, None), (3, "short"), (None, sentence(7, 13)), (5, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak.find_leaks(docs, items).collect()}
    assert {(3, 1), (20, 1), (12, -1), (13, -1)} <= got and not {i for i, _ in got} & {5, 6, 7, 8, 10, 11}
    kept = leak.remove_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {i for i, _ in got}
    assert leak.find_leaks(empty, items).collect() == [] and leak.find_leaks(docs, items.limit(0)).collect() == []


def test_short_items_are_found_on_word_boundaries(spark):
    items = [(1, "What is 2+2?"), (2, "cat"), (3, " the cat "), (4, "a a"), (5, "   "), (6, "é"), (7, "x" * 31), (8, "x" * 32), (9, "?!"), (9, "cat")]
    rows = [(1, "so: WHAT IS\t2+2?yes"), (2, "concatenate cats"), (3, "The Cat"), (4, "a a a a"), (5, "caf\u00e9 \u00e9!"), (6, "x" * 31), (7, "x" * 32), (8, "what?!"), (9, None), (10, ""), (11, "cat cat")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in leak.find_leaks(docs, bench).collect())
    texts, size = {i: (t or "").encode() for i, t in rows}, lambda t: len(t.encode())
    want = [(1, 1, 4, 16, 0, 12), (3, 2, 4, 7, 0, 3), (3, 3, 0, 7, 0, 9), (3, 9, 4, 7, 0, 3), (4, 4, 0, 3, 0, 3), (4, 4, 4, 7, 0, 3), (5, 6, 6, 8, 0, size("é")), (6, 7, 0, 31, 0, 31), (6, 8, 0, 31, 1, 32), (7, 8, 0, 32, 0, 32), (8, 9, 4, 6, 0, 2), (11, 2, 0, 3, 0, 3), (11, 2, 4, 7, 0, 3), (11, 9, 0, 3, 0, 3), (11, 9, 4, 7, 0, 3)]
    assert got == want
    assert texts[5][6:8] == "é".encode()
    assert sorted(r["doc_id"] for r in leak.remove_leaks(docs, bench).collect()) == [2, 9, 10]


# --- substring dedup


def brute_removed(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.substring_dedup(df).collect()), key=str)


def test_substrings_of_odd_rows(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert removed(docs) == brute_removed(rows)
    assert removed(empty) == []


def test_substrings_of_shuffled_passages(spark):
    rng = random.Random(2)
    pool = [sentence(500 + k, rng.randrange(5, 40)) for k in range(12)]
    rows = [(rng.randrange(10**12), " ".join(rng.choice(pool) if rng.random() < 0.6 else sentence(rng.randrange(10**6), rng.randrange(1, 15)) for _ in range(rng.randrange(1, 8)))) for _ in range(150)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_removed(rows)


def test_common_anchors_are_dealt_by_windows(spark, monkeypatch):
    rng = random.Random(8)
    often = sentence(900, 21).split()
    rows = []
    for i in range(120):  # one anchor in ever new surroundings, some of which repeat
        a, b = rng.randrange(9), rng.randrange(12, 22)
        rows.append((i, " ".join([sentence(1000 + rng.randrange(8), 30), *often[a:b], sentence(1100 + rng.randrange(8), 30), *often])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_removed(rows)
    assert removed(docs) == want and sum(r[2] for r in want) > 1000
    monkeypatch.setattr(sub, "LEAST_COMMON", 3)
    assert removed(docs) == want


def test_factors_are_greedy_and_go_on_at_boundaries():
    words = [f"w{i}".encode() for i in range(40)]
    index: dict = {}
    for doc, (a, b) in enumerate([(0, 20), (10, 34)]):
        part = words[a:b]
        for p in range(len(part) - sub.WINDOW + 1):
            index.setdefault(b" ".join(part[p : p + sub.WINDOW]), (doc, part, p))
    assert sub.factors(words, 5, index) == [(0, 20), (8, 12), (10, 24)] or sub.factors(words, 5, index) == [(0, 20), (10, 24)]
    assert sub.factors(words, 1, index) == [(0, 20)] and sub.factors(words, 0, index) == []


def test_clashing_columns_of_any_type_pass(spark):
    passage = sentence(77, 30)
    rows = [(1, passage, 1, 2, 3, (4, "x"), {"k": [1]}), (2, f"{passage} more", 1, 2, 3, (5, None), None), (None, passage, None, None, None, None, None), (2, "other words", 1, 2, 3, None, {})]
    kind = "doc_id int, text string, bucket_ int, `a.b` int, `_deal` int, s struct<`odd name`:int,`q``t`:string>, m map<string,array<int>>"
    docs = spark.createDataFrame(rows, kind).withColumnRenamed("bucket_", "_row")
    got = sorted(map(tuple, sub.cut_duplicates(docs).collect()), key=str)
    assert sub.cut_duplicates(docs).schema == docs.schema
    assert got == sorted([(*rows[0][:2], 1, 2, 3, (4, "x"), {"k": [1]}), (2, "more", 1, 2, 3, (5, None), None), rows[2], rows[3]], key=str)


def test_cut_text_keeps_other_words_and_white_space(docs, empty):
    got = {r["doc_id"]: r for r in sub.cut_duplicates(docs).collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None}
    assert 1 not in got and got[0] == before[0] and got[5] == before[5] and got[6] == before[6] and got[8] == before[8]
    assert got[4]["text"] == f"{sentence(5, 50)}\n{sentence(6, 30)}" and got[4]["n_chars"] == len(got[4]["text"])
    assert sub.cut_duplicates(docs).columns == docs.columns and sub.cut_duplicates(empty).collect() == []


# --- pipeline


def test_pipeline_stage_by_stage(spark, data, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, data, "documents")
    names = docs.columns
    toxic = {r["doc_id"] for r in table(spark, data, "labels").collect() if r["toxic"] == 1}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = {r["doc_id"]: r["text"] if "text" in docs.columns else None for r in docs.collect()}
        assert name == pipeline.STAGES[-1][0] or docs.columns == names
        assert set(left) <= set(rows)
        if name == "near_duplicates":
            assert set(left) == {c for _, c, _, _ in brute_classes(list(rows.items()))}
        if name == "substrings":
            want = {i: (n, k) for i, n, k, _ in brute_removed(list(rows.items()))}
            assert set(left) == {i for i, (n, k) in want.items() if n == 0 or k < n}
            assert all(len((left[i] or "").split()) == want[i][0] - want[i][1] for i in left)
        if name == "decontamination":
            items = [r["text"] for r in table(spark, data, "benchmark").collect()]
            assert not any(t in (x or "") for x in left.values() for t in items)
    assert toxic and np.mean([r["lossless"] for r in docs.collect()]) == 1


def test_pipeline_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item, passage = sentence(950, 20), sentence(951, 60)
    rows = [
        (1, sentence(960, 80), 1, "x"), (1, sentence(960, 80), 1, "x"), (1, sentence(961, 80), 2, None), (2, sentence(960, 80), 1, "y"), (None, sentence(960, 80), 1, "z"), (None, f"{sentence(962, 30)} {item}", 1, "z"),
        (3, None, None, None), (4, "", 4, "x"), (4, None, 4, "x"), (5, f"{sentence(963, 40)} {passage}", 5, "x"), (6, f"{sentence(964, 40)} {passage} tail", 6, "x"), (7, f"{sentence(965, 50)} {item} {sentence(966, 9)}", 7, "x"), (8, "long " * 30_000, 8, "x"),
    ]
    kind = "doc_id long, text string, `_deal` long, `a.b` string"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        schema = docs.schema
        docs = stage(spark, docs, folder)
        assert docs.schema == schema
        kept[name] = sorted(map(tuple, docs.collect()), key=str)
        docs = spark.createDataFrame(docs.collect(), schema)
    assert len(kept["toxicity"]) == len(rows)
    want = [rows[k] for k in (0, 2, 4, 5, 6, 7, 9, 10, 11, 12)]
    assert [r for r in kept["near_duplicates"] if r[0] != 4] == sorted((r for r in want if r[0] != 4), key=str)
    assert [r[2] for r in kept["near_duplicates"] if r[0] == 4] == [4]
    cut = {r[0]: r[1] for r in kept["substrings"] if r[0] in (5, 6)}
    assert cut == {5: rows[9][1], 6: f"{sentence(964, 40)} tail"}
    assert {r[0] for r in kept["decontamination"]} == {None, 1, 3, 4, 5, 6, 8} and sum(r[0] is None for r in kept["decontamination"]) == 1
    last = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == len(kept["decontamination"]) and all(r["lossless"] for r in last)
    none = tmp_path / "none"
    spark.createDataFrame([], kind).write.parquet(str(none / "documents.parquet"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(none / f"{t}.parquet"))
    assert pipeline.run(spark, str(none)).collect() == []


def test_folders_are_given_back(spark):
    import os

    from folioforge.llm import common

    with common.given_back(spark) as keep:
        a, kept = common.written(spark.range(3))
        common.materialise(spark.range(4))
        keep.append(kept)
        inside = [p for p in common._HELD[-1]]
    assert [os.path.exists(p) for p in inside] == [True, False] and a.count() == 3


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(12)
    for _ in range(300):
        item = bytes(rng.choices(b"abc", k=rng.randrange(1, 14)))
        text = bytes(rng.choices(b"abc", k=rng.randrange(0, 25)))
        low, width, budget = rng.randrange(-6, 20), rng.randrange(0, 6), rng.randrange(0, 5)
        got = leak.banded_edits(item, text, low, width, budget)
        # every alignment that begins at a place of the band and strays from the band by at most the budget
        best = None
        for start in range(max(low, 0), min(low + width, len(text)) + 1):
            row = {0: 0}
            row = {j: j for j in range(len(text) - start + 1)}
            for i, c in enumerate(item, 1):
                new = {0: i}
                for j in range(1, len(text) - start + 1):
                    new[j] = min(row[j - 1] + (text[start + j - 1] != c), row[j] + 1, new[j - 1] + 1)
                row = new
            best = min(filter(lambda x: x is not None, (best, min(row.values()))))
        if best is None or best > budget:
            assert got is None
        else:
            assert got is not None and got[0] == best and distance(item, text[got[1] : got[2]]) <= best


def test_common_grams_are_spared_without_a_loss(spark, monkeypatch):
    rng = random.Random(13)
    items = [(k, f"question number one of the long list: {sentence(700 + k, 60)}") for k in range(30)]  # long enough to spare their common beginning
    rows = [(k, f"{sentence(800 + k, 9)} {dict(items)[rng.randrange(30)]} {sentence(850 + k, 9)}") for k in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, leak.find_leaks(docs, bench).collect()))
    small = leak.Filter([(i, t.encode()) for i, t in items])
    monkeypatch.setattr(leak, "COMMON", 8)
    spared = leak.Filter([(i, t.encode()) for i, t in items])
    assert len(spared.owner) < len(small.owner) and (spared.needed < small.needed).all()
    places = [list(f.search([t.encode() for _, t in rows])) for f in (small, spared)]
    assert places[0] == places[1] and len(want) >= 40


def test_workers_keep_no_lattice_beyond_its_job(spark, docs):
    assert sp.sentencepiece_round_trip(docs).count() == docs.count()

    def held(batches):
        import gc

        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "_Units" for x in gc.get_objects())]})

    assert [r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()] == [0] * 16


def test_a_task_gives_back_what_was_freed():
    """Freed blocks with one in use behind them, as other tasks leave them."""
    import re
    from pathlib import Path

    from folioforge.llm.common import slices

    def megabytes():
        return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

    blocks = [bytes(2000) for _ in range(100_000)]
    most, last = megabytes(), blocks[-1]
    del blocks
    assert list(slices(iter([]), 1)) == [] and len(last) == 2000
    assert most - megabytes() > 150
