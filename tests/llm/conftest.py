import pytest

LONG = " ".join(f"word{i % 977} stone" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, part int, score double, component_id long, set_id long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like the operators' own."""
    base = "The quick brown fox jumps over the lazy dog and runs through the quiet forest until night falls. " * 3
    rows = [
        (1, base, "en", "a"),
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t ", "en", "b"),
        (6, LONG, "en", "b"),
        (7, LONG + " tail", "en", "b"),
        (8, "12 34 !!", "en", None),
        (None, "a text without an id, released under the MIT License.", "en", "a"),
        (9, "one two", None, "a"),
        (10, "one two", "en", "a"),
        (11, "<|endoftext|> in  a   text\r\n\n with runs", "en", "a"),
        (12, "日本語 é ́ and öäü ß. Licensed under the Apache License, Version 2.0.", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None if i % 3 else i, i, None, 0.5, i, None) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
