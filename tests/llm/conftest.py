import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp0 string, number string, hash string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with inner ones; null ids and columns where not given."""

    def make(texts, first=0, sources=None):
        rows = [
            (first + i, t, None, sources[i] if sources else None, None if t is None else len(t), "x", None, "y", "z")
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, tied and unusual texts."""
    rnd = random.Random(7)
    long_text = words(rnd, 30_000)
    return [
        None, "", " ", "\n\n\t", long_text, long_text, "a" * 5_000, "ab " * 2_000, "É è  ü\x0b\x1c\x85\xa0 end", "one",
        "one two three four", "<|endoftext|> x<|startoftext|>", "日本 😀́ ß ΑΣ İ", "it's  we'll\r\n\r\n  go ",
    ]
