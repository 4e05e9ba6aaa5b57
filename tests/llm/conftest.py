import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, chunk string, fp string, shard string, path string, host string, digest string, n_words string, _text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(400)] + "the of and to in a is that".split() * 15
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def odd_texts() -> list[tuple]:
    """(id, text): nulls, empty and white texts, copies, near copies, shared passages, ties, a long one, repeated rows."""
    base, passage = prose(1, 120), prose(99, 60)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, None), (3, ""), (4, " \t\n \x0b\x0c\r"), (5, base), (6, " ".join(near)), (7, prose(2, 40) + passage + prose(3, 30)), (8, passage + prose(4, 50)), (9, "one"),
        (10, "a b"), (11, prose(5, 20000)), (12, "é" * 40 + " straße 中文 \U0001f600"), (13, "x" * 3000), (14, prose(6, 15)), (14, prose(6, 15)), (15, "<|endoftext|> a<|endoftext|>"), (16, prose(7, 90)),
        (17, "spam " * 200), (18, "a@b.co 1.2.3.4 +1 (212) 555-1234 4111 1111 1111 1111"), (19, "### $$$ %%% | | | a b c d e f g h i"), (None, prose(8, 30)), (None, None), (20, prose(9, 60) + "\n" + "\n".join([prose(10, 6)] * 5)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names clash with those that operators use."""
    rows = [(i, t, ["en", "de", None][k % 3], ["a", "a", "b", None][k % 4], None if t is None else len(t), *["clash"] * 9) for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
