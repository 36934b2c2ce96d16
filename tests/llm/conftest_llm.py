import random

import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, _k1 string, _row int, kept string, size string, "
        "fp string, anchor string, target double, h string, _t string, score string, ids string, start string")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n)) if n else ""


def as_rows(items):
    """(id, text, lang, source) -> rows with extra columns whose names the operators use themselves."""
    return [(i, t, lang, src, None if t is None else len(t), "x", 1, "k", None, "f", None, 1.5, "h", "t", "s", "i", "0")
            for i, t, lang, src in items]


def edge_items():
    shared = prose("shared", 80)
    items = [(k, prose(k, 5 + 13 * k), "en", f"s{k % 3}") for k in range(12)]
    items += [(20, None, "en", "s0"), (21, "", "de", "s1"), (22, " \n\t ", None, None), (None, prose("n", 60), "fr", None),
              (23, prose("long", 60_000), "en", "s0"), (24, "é" * 500, None, "s2"), (25, "a", "en", "s2"),
              (26, "x " + shared + " one", "en", "s0"), (27, shared + " two three", "en", "s1"), (28, prose(3, 44) + " extra", "en", "s1")]
    same = (30, prose("same", 70), "es", "s1")
    return items + [same, same, same, (31, prose("same", 70), "es", "s0"), (None, None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(as_rows(edge_items()), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
