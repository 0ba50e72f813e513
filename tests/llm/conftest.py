import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk int, bucket string, fp string, k0 int, lang_pred string, score string"


def document_rows(seed=3):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, empty and long ones, equal and null ids."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["Äpfel,", "señor.", "日本語", "x y"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", " ", "\n", "  ", ". "]) for _ in range(n))
    passage, line = text(60), "one very common line that stands in many of the texts"
    rows = []
    for i in range(60):
        t = text(rnd.choice([0, 1, 2, 5, 30, 36, 80, 200]))
        if i % 3 == 0:
            cut = rnd.randint(0, len(t))
            t = t[:cut] + passage + t[cut:]
        if i % 4 == 0:
            t += "\n" + line + rnd.choice(["", "", "!", " no"]) + "\n" + text(3)
        rows.append((i, t))
    base = text(150)
    rows += [(100 + i, base) for i in range(15)]  # a group of copies
    words = base.split(" ")
    for i in range(15):  # near copies
        w = list(words)
        w[rnd.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "   "), (303, "123 456!"), (304, "word"), (305, "two words"), (306, text(6000)), (307, "ab " * 500), (308, "=" * 300), (309, "=" * 300 + "a")]
    rows += [(310, base + " end"), (310, base + " end"), (310, text(50)), (None, base), (None, None), (-5, passage)]
    rnd.shuffle(rows)
    return [(i, t, "en", "s", len(t or ""), 7, "b", "f", 1, "xx", "?") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
