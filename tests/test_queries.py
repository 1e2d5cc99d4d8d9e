"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog, oracle, repository, workflows  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(tuple, plain.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, DIR).toPandas()) == _rows(duck.execute(oracle.ORACLE[name]).fetchdf())


def test_names():
    assert set(oracle.ORACLE) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_chunks(spark):
    """Forward progress, ends at line feeds, overlap, whole coverage."""
    from pyspark.sql import functions as F

    from lodestone.functions.chunking import chunk_spans, chunks

    texts = ["", None, "a" * 1800, "a" * 1801, "line of text\n" * 400, "x" * 5000, "y" * 150 + "\n" + "z" * 4000, "\n" * 4000, "\n" + "w" * 3000]
    texts += ["é\n日本 ö\n" * 700, "\n" + "ü" * 1799 + "\nx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunks(F.col("text")).alias("c"), chunk_spans(F.col("text"), 1800, 200).alias("s")).collect()
    for r in rows:
        text, spans = texts[r["i"]] or "", []
        start = 0
        while start < len(text):  # as a plain fold over substrings
            end = min(start + 1800, len(text))
            if end < len(text) and (feed := text[start:end].rfind("\n")) > 0:
                end = start + feed
            spans.append((start, end))
            start = len(text) if end >= len(text) else max(end - 200, start) if end - 200 > start else end
        assert [tuple(s) for s in r["s"]] == spans and r["c"] == [text[a:b] for a, b in spans]
        assert len(spans) <= 3 * len(text) // 1600 + 3 and all(0 < b - a <= 1800 for a, b in spans)
    assert [len(p) for p in rows[6]["c"]] == [150, 1800, 1800, 801]


def test_a_text_of_ten_megabytes_is_chunked_in_seconds():
    import time

    import pyarrow as pa

    from lodestone.functions.chunking import pieces

    long = "".join(f"line {i} of a very long text\n" for i in range(330_000))
    begun = time.process_time()
    (found,) = pieces(pa.array([long]), 1800, 200).to_pylist()
    assert time.process_time() - begun < 5 and found[0] == long[: len(found[0])] and long.endswith(found[-1])
