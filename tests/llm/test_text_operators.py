"""Licence scan, language, toxicity, chat, media and tokens against brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import op2_language, op3_license, op5_chat, op6_media, op8_toxicity, op10_tokens
from folioforge.llm.common import fold_bucket, table, tokenizer_path

from .conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)


# --- licence scan


def scan(text):
    return op3_license.scanner()([w for w in (text or "").encode().translate(op3_license.FOLD).split()])


def expected_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in op3_license.BASE_PHRASES for q in [p.split()] for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("under the mit license Apache License, version 2 cc by-nc nc UNDER undér licensed you may x".split()), max_size=40))
def test_base_phrases_as_by_brute_force(words):
    text = " ".join(words)
    assert scan(text)[:5] == expected_base(text)


def test_automaton_knows_exactly_the_substrings():
    text = [["a", "b", "a", "c"], ["b", "a", "b"], ["a", "b", "a", "c", "a"]]
    auto = op3_license.Automaton(text)
    known = {tuple(t[i:j]) for t in text for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    todo, found = [((), 0)], set()
    while todo:
        path, state = todo.pop()
        for w, to in auto.next[state].items():
            found.add((*path, w))
            todo.append(((*path, w), to))
    assert found == known


def test_notices_are_labelled_from_most_of_their_words():
    label, notice = op3_license.NOTICES[0]
    got = scan("Hello. " + notice.title() + " bye")
    assert got[5] == label and got[6] == pytest.approx(1.0)
    assert scan(" ".join(notice.split()[:6]))[5] == ""
    assert scan("the of to a in license software")[5] == ""


def test_every_place_of_a_notice_is_a_span():
    label, notice = op3_license.NOTICES[3]
    words, n = notice.split(), len(notice.split())
    code = " x1 y2 z3" * 10
    got = scan(f"{notice}{code} {notice}{code} {' '.join(words[: n - 3])} {notice}")
    at = [0, n + 30, 2 * n + 60, 3 * n + 57]
    assert [(s["label"], s["first"], s["last"]) for s in got[7]] == [(label, a, a + (n - 4 if i == 2 else n - 1)) for i, a in enumerate(at)]
    assert got[5] == label and got[6] == 1.0
    edited = " ".join([*words[:8], "new", *words[9:]])
    assert [(s["first"], s["last"]) for s in scan(f"{edited} {edited} {edited}")[7]] == [(i * n, i * n + n - 1) for i in range(3)]


def test_license_rows(docs, empty):
    got = op3_license.scan_licenses(docs).collect()
    want = sorted(((i, *expected_base(t)) for i, t in texts(docs)), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == want
    assert op3_license.scan_licenses(empty).collect() == []


# --- language


def test_language_of_held_out_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").collect()}
    got = [r for r in op2_language.op2_language_id(spark, folder).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(docs, empty):
    learned = op2_language.fit_dictionaries(docs, eligible=fold_bucket("doc_id", 4) != 2)
    assert set(learned) <= {"en", "fr", "de"}
    got = op2_language.identify(docs, learned).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == by[7]["lang_pred"] == "und"
    assert by[0]["lang_pred"] == by[1]["lang_pred"] in learned and by[0]["score"] == by[1]["score"]
    assert by[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    classify = op2_language.classifier(learned)
    assert classify("12 ² ½ !?".encode())[0] == "und" and classify("é".encode())[0] in learned
    assert op2_language.fit_dictionaries(empty) == {}
    assert {r["lang_pred"] for r in op2_language.identify(docs, {}).collect()} == {"und"}


# --- toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(300):
        v = {int(k): float(w) for k, w in zip(rng.choice(40, 5, replace=False), rng.random(5), strict=True)}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({k: x / n for k, x in v.items()})
    index = op8_toxicity.BlockMaxIndex(vectors, 40)
    for q in vectors[:60]:
        every = sorted((-round(sum(x * v.get(k, 0) for k, x in q.items()), 10), i) for i, v in enumerate(vectors))
        want = [(-s, i) for s, i in every if s < 0][:8]
        got = index.search(q, 8)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)
    assert index.search({}, 8) == []


def test_isotonic_rises():
    knots = op8_toxicity.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.9, 1)])
    assert all(a[0] <= b[0] and a[1] <= b[1] + 1e-9 for a, b in zip(knots, knots[1:], strict=False))


def test_toxicity_of_held_out_documents(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    got = [r for r in op8_toxicity.op8_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    pos, neg = ([r["score"] for r in got if truth[r["doc_id"]] == k] for k in (1, 0))
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert sum(s >= 0.7 for s in neg) == 0


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 1), (99, 1), (None, 1), (5, None), (8, 0)], "doc_id long, toxic int")
    model = op8_toxicity.fit(docs, labels)
    got = op8_toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op8_toxicity.keep_clean(docs, model).columns == docs.columns
    nothing = op8_toxicity.fit(empty, labels)
    assert op8_toxicity.score(empty, nothing).collect() == [] and op8_toxicity.score(docs, nothing).count() == docs.count()


def test_no_document_is_its_own_neighbour(spark):
    rows = [(i, f"{sentence(600 + i, 40)} {'grobian dolt' if i % 2 else 'kindly'}", i % 2) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = op8_toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in op8_toxicity.score(docs, model).collect()}
    assert set(model.ids) & set(got) and all(r["doc_id"] not in [e["doc_id"] for e in r["evidence"]] for r in got.values())
    assert any(e["cosine"] > 0 for r in got.values() for e in r["evidence"])


def test_vectors_hold_all_words_of_the_examples(spark):
    rows = [(i, f"{sentence(620 + i, 30)} {'grobian' if i % 2 else 'kindly'}", i % 2) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = op8_toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    by = {r[0]: r[1] for r in rows}
    for i, v in zip(model.ids, model.vectors, strict=True):
        assert {model.terms[w] for w in by[i].split()} <= set(v) and sum(x * x for x in v.values()) == pytest.approx(1.0)
    # exact search over the whole vectors, for texts with unknown words too
    index = op8_toxicity.BlockMaxIndex(model.vectors, len(model.terms))
    for text in (by[3], f"{by[4]} never seen words", "grobian", "unknown"):
        q = op8_toxicity.vector(op8_toxicity.counted(text, model.terms, model.clean, {}), model.idf)
        want = sorted((-round(sum(x * v.get(k, 0.0) for k, x in q.items()), 10), k) for k, v in enumerate(model.vectors))
        assert [round(s, 9) for s, _ in index.search(q, 5)] == pytest.approx([-s for s, _ in want if s < 0][:5], abs=1e-8)


def test_toxic_words_behind_a_long_beginning_are_learned(spark):
    rows = [(i, f"{sentence(300 + i, 40)} " + sentence(400 + i, 1500) + (" grobian grobians blockhead" * 3 if i % 2 else " kindly"), i % 2) for i in range(24)]
    assert min(len(t) for _, t, _ in rows) > 10_000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    model = op8_toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "grobian" in model.terms and "blockhead" in model.terms
    for (i, t, y), v in zip([next(r for r in rows if r[0] == i) for i in model.ids], model.vectors, strict=True):
        assert v == op8_toxicity.vector(op8_toxicity.counted(t, model.terms, model.clean, {}), model.idf), (i, y)
    assert set(model.ids) >= {i for i, _, y in rows if y}


def test_words_are_those_of_the_pattern():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(8)
    made = ["".join(rng.choices("aÉß_9²½ \n-.«—'\u00a0\u200b漢İ\x1c\x85", k=rng.randrange(30))) for _ in range(5000)]
    for text in ["", " ", "a" + "a".join(every), " ".join(every), *made]:
        assert op8_toxicity.words_of(text) == op8_toxicity.WORD.findall(text.lower())


def toxicity_model():
    words = [f"w{k}" for k in range(3000)] + ["grobian", "grobians", "groberian"]
    terms = {t: k for k, t in enumerate(["grob*", "grobian", "grobi*", *(w for w in words if w != "grobian")])}
    vectors = [{terms["grobian"]: 0.8, terms["grob*"]: 0.6}, {terms["w1"]: 1.0}]
    return op8_toxicity.Model(terms, {"groberian"}, [1.0 + k % 7 / 8 for k in range(len(terms) + 1)], [1, 2], [1, 0], op8_toxicity.Vectors(vectors), 0.5, [])


def test_arrays_of_words_give_what_the_words_do_one_by_one():
    m, rng = toxicity_model(), random.Random(9)
    codes, idf = op8_toxicity.WordCodes(m.terms, m.clean), np.array(m.idf)
    texts = [" ".join(rng.choice(["grobian", "grobianissimo", "grob", "gro", "groberian", "new", f"w{rng.randrange(4000)}"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    held = codes.held(texts)
    counts = [op8_toxicity.counted(t, m.terms, m.clean, {}) for t in texts]
    assert sorted(held.tolist()) == sorted(k for c in counts for k in c if k >= 0)
    for c, (terms, weights) in zip(counts, codes.queries(texts, idf), strict=True):
        assert dict(zip(terms.tolist(), weights.tolist(), strict=True)) == pytest.approx(op8_toxicity.vector(c, m.idf))
    assert codes.queries([], idf) == [] and len(codes.held([])) == 0


def test_new_words_are_not_looked_at_one_by_one(monkeypatch):
    looked, plain = [], op8_toxicity.terms_of
    monkeypatch.setattr(op8_toxicity, "terms_of", lambda word, *more: looked.append(word) or plain(word, *more))
    judge = op8_toxicity.judge_of(toxicity_model())
    judge([" ".join(f"new{k}" for k in range(i, i + 500)) + " grobianissimo" for i in range(0, 5000, 500)], list(range(10)))
    assert looked == ["grobianissimo"]


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>|\\/[]sINTturnendbodyx", max_size=60) | st.lists(st.sampled_from([*op5_chat.CONTROL, "\\", "<\\|end|>", "<", "x"])).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = op5_chat.escape(text)
    assert op5_chat.unescape(hidden) == text
    assert not any(c in hidden for c in op5_chat.CONTROL)


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "yes </s>"), (1, 0, "user", "hi <|turn|>"), (2, 0, "assistant", None), (2, 1, None, "x"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "é\U0001f600"), (4, None, "assistant", "a" * 5000), (4, 2, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    got = {r["conv_id"]: r for r in op5_chat.read_back(op5_chat.assemble(op5_chat.encode_turns(turns))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        whole = "".join(f"{a}\n{b}\n" for _, a, b in mine)
        loss = "".join(b for _, a, b in mine if a == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert op5_chat.read_back(op5_chat.assemble(op5_chat.encode_turns(turns.limit(0)))).collect() == []


def test_mask_covers_answers_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c d e")], "conv_id long, turn long, role string, text string")
    for r in op5_chat.encode_turns(turns).collect():
        ids, mask = np.frombuffer(r["tokens"], "<u4"), np.frombuffer(r["loss_mask"], np.int8)
        assert len(ids) == len(mask) and mask.sum() == (3 if r["role"] == "assistant" else 0) and mask[-1] == 0


def test_repeated_texts_still_fill_a_dictionary(spark):
    rows = spark.range(200_000).selectExpr("concat(repeat(concat('wort', id % 20, 'schön '), 9), 'x') as text", "'de' as lang").unionByName(spark.createDataFrame([("ab", "en"), ("12", "no"), (None, "no")], "text string, lang string"))
    got = op2_language.fit_dictionaries(rows)
    assert sorted(got) == ["de", "en"] and len(got["de"].split(b"\n")) == 20 and got["en"] == b"ab"


# --- media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_media_round_trip(raw):
    payload = op6_media.padded(raw)
    assert len(payload) % 192 == 0 and payload[: len(raw)] == raw
    data = op6_media.write_media(payload)
    got = op6_media.read_media(data)
    assert b"".join(data[a:b] for a, b in got["extents"]) == payload
    assert got["samples"] * 192 == len(payload) == got["duration"] == got["ticks"] and got["codec"] == "raw "
    assert [(int(a), int(b)) for a, b in got["keys"]] == [(a, 192) for a, _ in got["extents"]]


def test_boxes_out_of_order_or_broken():
    data = op6_media.write_media(b"x" * 192)
    assert ("moov", "trak", "mdia", "minf", "stbl", "stsz") in {tuple(p.decode() for p in path) for path, _, _ in op6_media.walk(data)}
    with pytest.raises(ValueError):
        list(op6_media.walk(b"\0\0\1\0moov"))
    wide = b"\0\0\0\1free" + (16 + 3).to_bytes(8, "big") + b"abc"
    assert list(op6_media.walk(wide)) == [((b"free",), 16, 19)]


def test_tracks_are_read_each_by_its_own_tables():
    def track(codec, sizes, chunk_at, keys=None, compact=None):
        n = len(sizes)
        entry = op6_media.box(codec, b"\0" * 28)
        if compact == 4:
            packed = bytes((sizes[i] << 4) | (sizes[i + 1] if i + 1 < n else 0) for i in range(0, n, 2))
        else:
            packed = b"".join(struct.pack(">H", x) for x in sizes)
        size = op6_media.full(b"stz2", struct.pack(">II", compact, n), packed) if compact else op6_media.full(b"stsz", struct.pack(">II", 0, n), *(struct.pack(">I", x) for x in sizes))
        parts = [op6_media.full(b"stsd", struct.pack(">I", 1), entry), op6_media.full(b"stts", struct.pack(">III", 1, n, 10)), op6_media.full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), size, op6_media.full(b"stco", struct.pack(">II", 1, chunk_at))]
        if keys:
            parts.append(op6_media.full(b"stss", struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)))
        mdia = op6_media.box(b"mdia", op6_media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 10 * n, 0, 0)), op6_media.box(b"minf", op6_media.box(b"stbl", *parts)))
        return op6_media.box(b"trak", mdia)

    data = op6_media.box(b"ftyp", b"isom") + op6_media.box(b"moov", track(b"aaaa", [3, 5, 7], 500), track(b"bbbb", [4, 15, 1], 600, [1, 3], 4), track(b"cccc", [300, 2], 700, [2], 16))
    a, b, c = op6_media.read_tracks(data)
    assert [t["codec"] for t in (a, b, c)] == ["aaaa", "bbbb", "cccc"] and op6_media.read_media(data)["codec"] == "aaaa"
    assert a["keys"].tolist() == [[500, 3], [503, 5], [508, 7]] and a["extents"] == [(500, 515)]
    assert b["keys"].tolist() == [[600, 4], [619, 1]] and c["keys"].tolist() == [[1000, 2]] and c["extents"] == [(700, 1002)]
    with pytest.raises(ValueError):
        op6_media.read_tracks(data + op6_media.box(b"moof"))
    with pytest.raises(ValueError):
        op6_media.read_media(op6_media.box(b"moov", op6_media.box(b"trak")))


def test_media_rows(docs, empty):
    got = op6_media.describe_media(op6_media.encode_media(docs)).collect()
    want = []
    for i, t in texts(docs):
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert all(json.loads(r["feature"])["keyframes"] == len(r["keyframes"]) for r in got)
    assert op6_media.describe_media(op6_media.encode_media(empty)).collect() == []


# --- tokens


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab'sé,.!1  漢<|endoftx>", max_size=60))
def test_words_give_the_library_s_ids(text):
    coder = op10_tokens.coder(tokenizer_path("byte_bpe_50k.json"))
    assert coder.encode(text) == coder.ask(text)


def test_every_white_space_gives_the_library_s_ids():
    coder, rng = op10_tokens.coder(tokenizer_path("byte_bpe_50k.json")), random.Random(10)
    told = ["a\tb\n\xa0", "price\xa05\n\xa0", "a\ta\ta\n\n", "a\r\rb\n\n\rb", "b\x0ba\n\n\x0bb\x0b", "a\n\n\u3000a\u3000b"]
    signs = [*"ab,.!1é漢  \n\n", *op10_tokens.ODD_SPACE, "\0", "\x01", "\u200b", "\ufeff", "'s"]
    made = ["".join(rng.choices(signs[: 8 + rng.randrange(len(signs) - 7)], k=rng.randrange(14))) for _ in range(10_000)]
    assert [t for t in told + made if coder.encode(t) != coder.ask(t)] == []
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} - set(op10_tokens.ODD_SPACE) == {" ", "\n"}


def test_a_small_cache_changes_nothing():
    path = tokenizer_path("byte_bpe_50k.json")
    small, text = op10_tokens.WordCoder(path, room=3), "one two, three one. four two! five"
    assert small.encode(text) == small.ask(text)


def test_new_words_go_to_the_library_together(monkeypatch):
    coder, asked = op10_tokens.WordCoder(tokenizer_path("byte_bpe_50k.json")), []
    plain = coder.piece
    monkeypatch.setattr(coder, "piece", lambda text: asked.append(text) or plain(text))
    texts = [" ".join(f"{sentence(800 + i, 30)} wörd{chr(97 + i)}, {'漢' * (1 + i)}!? it's 3.5" for _ in range(3)) for i in range(9)]
    assert [coder.encode(t) for t in texts[:1]] == [coder.ask(t) for t in texts[:1]] and len(asked) <= 2
    every = ["", *texts, "x" * 70 + " a", "a\nb, c.\nd", "a" * 3_000_000 + " b", *texts]
    assert coder.encode_all(every) == [coder.ask(t) if t else b"" for t in every]


def test_words_of_one_hash_and_a_small_room_change_nothing(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [sentence(900 + i, 40) + ("!?\nAnd, so (on)." if i % 2 else " ...") for i in range(60)]
    small = op10_tokens.WordCoder(path, room=3)
    monkeypatch.setattr(op10_tokens, "GROUP", 300)
    assert small.encode_all(texts) == [small.ask(t) for t in texts]
    for keep in (7, 0):  # few hashes, then one for all words
        coder = op10_tokens.WordCoder(path, room=500)
        monkeypatch.setattr(op10_tokens, "mix", lambda x, keep=keep: x & np.uint64(keep))
        assert coder.encode_all(texts) == [coder.ask(t) for t in texts]


def test_known_words_are_compared_as_numbers(monkeypatch):
    coder, spread, sizes = op10_tokens.WordCoder(tokenizer_path("byte_bpe_50k.json")), op10_tokens.spread, []
    texts = [sentence(700 + i, 40) + ", and so on." for i in range(20)]
    coder.encode_all(texts)
    monkeypatch.setattr(op10_tokens, "spread", lambda starts, n: sizes.append(int(n.sum())) or spread(starts, n))
    coded = coder.encode_all(texts)
    assert coded == [coder.ask(t) for t in texts]
    assert sum(sizes) == sum(len(x) // 4 + 1 for x in coded)  # ids and the newline before each text, no bytes


def test_long_words_and_runs_of_signs_around_the_bounds():
    coder = op10_tokens.WordCoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [x + "!" * n for x in ("abc", "é", "", "a b") for n in (*range(1, 10), *range(55, 70), 200)]
    texts += [f"{c * n} {c * (n + 1)}.,; b\0 b \0{c}\0\0" for c in "aé漢" for n in range(1, 70)]
    texts += [" lead", "trail ", "a  b", "a\n\nb", "a \nb", "\n", " ", "a\n"]
    for _ in range(2):
        assert coder.encode_all(texts) == [coder.ask(t) if t else b"" for t in texts]


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "t")
    op10_tokens.write_tokens(docs, path, partitions=3)
    got = op10_tokens.digest_tokens(spark, path).collect()
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted(((i, t or "") for i, t in texts(docs)), key=lambda x: (x[0] is not None, x[0], x[1])):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    op10_tokens.write_tokens(empty, str(tmp_path / "e"))
    assert op10_tokens.digest_tokens(spark, str(tmp_path / "e")).collect() == []


def test_token_files_are_dictionary_coded_and_indexed(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    op10_tokens.write_tokens(docs, str(path), partitions=1)
    group = pq.ParquetFile(next(path.glob("*.parquet"))).metadata.row_group(0)
    ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
    doc = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "doc_id")
    assert "RLE_DICTIONARY" in ids.encodings and doc.has_column_index and doc.has_offset_index


def test_ids_are_those_of_an_untouched_library():
    """10,000 random texts with the library's added tokens, signs and white space among words."""
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(11)
    lib = Tokenizer.from_file(path)
    added = [t.content for t in lib.get_added_tokens_decoder().values()]
    assert added
    parts = [*added, *(a[:-1] for a in added), "a", "word", "it's", "Zebra,", "é", "漢字", "12", "3.5", "!?", "x" * 70, "<|", "|>", ""]
    words = op10_tokens.WordCoder(path, room=50)
    for _ in range(10_000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\n", "", "  ", "\t"]) for _ in range(rng.randrange(12)))
        text = text.strip() if rng.random() < 0.7 else text
        assert np.frombuffer(words.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_rows_without_id_are_dealt_over_files(spark, tmp_path):
    rows = [(None if i % 2 else i, f"text {i * 7919 % 2000} of some words") for i in range(2000)]
    path = str(tmp_path / "t")
    op10_tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, partitions=8)
    sizes = [r["count"] for r in op10_tokens.read_tokens(spark, path).groupBy("part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 500
    order = [(r["doc_id"], r["start"]) for r in op10_tokens.digest_tokens(spark, path).collect()]
    ids = [i for i, _ in sorted(order, key=lambda x: x[1])]
    assert ids == [None] * 1000 + sorted(i for i in ids if i is not None)


def test_the_smallest_shares_are_met(spark):
    from folioforge.llm.common import drawn

    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for share in (1.0, 0.25, 1e-3):
        n = rows.filter(drawn(F.col("h"), F.lit(share))).count()
        assert abs(n - 200_000 * share) <= 5 * (200_000 * share) ** 0.5 + 1 and (share < 1 or n == 200_000)
    assert spark.range(1).filter(drawn(F.lit(5 << 11), F.lit(6 / 2**53))).count() == 1 and spark.range(1).filter(drawn(F.lit(6 << 11), F.lit(6 / 2**53))).count() == 0


def test_three_hundred_languages(spark):
    """Each of them has words of its own, and is told by them."""
    rng = random.Random(5)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for k in range(300)}
    text = lambda k: " ".join(rng.choices(words[k], k=60))
    train = [(text(k), k) for k in words for _ in range(2)]
    made = op2_language.fit_dictionaries(spark.createDataFrame(train, "text string, lang string"))
    assert sorted(made) == sorted(words)
    classify = op2_language.classifier(made)
    assert sum(classify(text(k).encode())[0] == k for k in list(words)[::10]) == 30
