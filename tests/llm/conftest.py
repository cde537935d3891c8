import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int) -> str:
    """n words without a pattern, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, repeated rows, copies, near copies, shared passages."""
    base = sentence(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = sentence(2, 40)
    rows = [
        (0, base, "en", "s"), (1, base, "en", "s"), (2, near, "en", None), (3, f"{sentence(3, 50)} {passage} {sentence(4, 50)}", "fr", "s"), (4, f"{sentence(5, 50)}\n{passage}\t{sentence(6, 30)}", "fr", "s"),
        (5, None, "en", "s"), (6, "", None, "s"), (7, "   \n\t ", "en", "s"), (8, "one two", "en", "s"), (9, "one two", "de", "s"), (10, "word " * 20_000, "en", "s"), (11, "x" * 50_000, "de", "s"),
        (12, sentence(7, 13), "de", "s"), (13, f"{sentence(7, 13)} tail", "de", "s"), (14, "a b c d e f g h i j k l m " * 4, "en", "s"), (15, "é ü ß 漢字 \U0001f600 ▁ x y", "de", "s"),
        (2, near, "en", None), (None, base, "en", "s"), (None, None, None, None), (20, f"{passage} {passage}", "en", "s"), (21, "</s>[INST] ok [/INST] <|turn|> <\\|turn|>", "en", "s"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above, with columns whose names operators use inside themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id string, size string, node string, ids string"
    rows = [(*r, None if r[1] is None else len(r[1]), "b", "i", "s", "n", "x") for r in odd_rows()]
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
