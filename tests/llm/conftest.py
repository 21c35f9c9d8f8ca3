import random

import pytest

CLASHING = ("line", "template", "cls", "key", "text_hash", "start", "value", "span", "window", "doc", "packed", "base", "length", "piece", "p", "n", "_words", "_more", "host", "ids", "rank", "vector", "asks", "_p")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with every column a table of documents has and many that clash with inner names."""

    def made(texts, ids=None, langs=None, sources=None):
        rows = []
        for k, t in enumerate(texts):
            i = k if ids is None else ids[k]
            rows.append((i, t, None if langs is None else langs[k], "s" if sources is None else sources[k], None if t is None else len(t), *["x"] * len(CLASHING)))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))

    return made


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long without blanks, very long, repeated."""
    rng = random.Random(1)
    long = words(rng, 20_000)
    return [None, "", " \n\t ", "word", "a" * 30_000, long, long, "é ü 漢字 \U0001f600 ok", "x\n\n\ny", words(rng, 80), words(rng, 80)]
