import random

import pytest

PROSE = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("dan", "fel", "gir", "hop", "jun", "kas")]


def prose(seed, words):
    chooser = random.Random(seed)
    return " ".join(chooser.choice(PROSE) + chooser.choice(["", "", ".", ",", "\n"]) for _ in range(words))


def edited(text, seed, changes):
    chooser, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[chooser.randrange(len(words))] = f"edit{chooser.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def edge_rows():
    """``(doc_id, text)``: copies, near copies, shared passages, odd and missing texts."""
    passage, line = prose(1, 60), prose(2, 9)
    rows = [
        (None, prose(3, 80)), (7, None), (8, ""), (9, "  \n\t "), (10, "One"), (11, "one two"), (12, "ONE TWO"),
        (13, "ünï ☃ 𝒳 " * 30), (14, "a" * 700), (15, "word " * 200), (16, "\x00 \x1f x\x00y " + prose(4, 40)),
    ]
    for k in range(6):
        rows.append((20 + k, prose(100, 120)))  # copies
    for k in range(8):
        rows.append((40 + k, edited(prose(200, 150), k, 2 + k)))  # near copies, some too far
    for k in range(30):
        own = prose(300 + k, 30 + 5 * k)
        rows.append((60 + k, f"{own}\n{line}\n{passage if k % 3 else ''} {prose(400 + k, 25)}"))
    rows.append((100, prose(500, 6000) + " " + passage + " " + prose(300, 30)))  # long
    rows += [(101, prose(600, 50)), (101, prose(600, 50))]  # a repeated row
    rows.append((-5, passage))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows as a table with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, ["en", None, "de"][k % 3], ["s0", "s0", None, "s1"][k % 4], len(t or ""), "x", 1.5, [k]) for k, (i, t) in enumerate(edge_rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, anchor array<int>",
    ).repartition(5)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
