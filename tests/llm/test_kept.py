"""Cases in which rows, languages or columns were lost."""

import subprocess
import sys
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from lodestone.llm import jaccard, langid, mixing  # noqa: E402
from lodestone.llm.scratch import scratch_path  # noqa: E402
from lodestone.llm.sharding import Store  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"
A, B = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")


def _learning(n):
    """Ids that aren't held out."""
    import zlib

    return [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 4 != 2][:n]


def test_a_language_of_few_repeated_rows_is_learned(spark):
    french = "le chat et la souris sont dans la maison avec les enfants"
    rows = [(i, f"the cat number {i} and the mouse are in the house with them", "en", "a") for i in _learning(300)]
    rows += [(1, french, "fr", "a")] * 6000
    model = langid.learn(spark.createDataFrame(rows, SCHEMA), per_language=50)
    assert sorted(model.langs) == ["en", "fr"]
    found = langid.identify(spark.createDataFrame([(1, french + " noire", None, None)], SCHEMA), model).first()
    assert found["lang_pred"] == "fr"


def test_many_labels_are_bounded_not_refused(spark):
    rows = [(i, f"word{i % 7} text of some length {chr(97 + i % 26) * 5}", f"l{i % 30:02d}", "a") for i in _learning(120)]
    rows += [(10_000 + i, f"more rows of one label {i}", "l29", "a") for i in range(20)]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA), per_language=50, most_languages=5, most_rows=20)
    assert len(model.langs) == 5 and "l29" in list(model.langs)


def _kept(spark, rows):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in jaccard.one_of_each(spark.createDataFrame([(*r, "en", "a") for r in rows], SCHEMA), size=5, num=80).collect())


def test_one_row_of_each_class_whatever_the_ids(spark, monkeypatch):
    cases = [
        ([(0, B), (1, A), (1, B + " x")], [(0, B), (1, A)]),
        ([(0, A), (0, B), (1, A + " x"), (2, B + " x")], [(0, A), (0, B)]),
        ([(0, A), (0, A + " x"), (0, A)], None),
        ([(None, A), (None, A), (None, B), (3, A)], [(-1, A), (-1, B), (3, A)]),
        ([(4, ""), (4, ""), (5, None), (5, None)], [(4, ""), (5, None)]),
    ]
    for most in (jaccard.MOST_SENT, 0):
        monkeypatch.setattr(jaccard, "MOST_SENT", most)
        for rows, expected in cases:
            found = _kept(spark, rows)
            assert found == expected if expected else len(found) == 1


def test_rows_that_share_an_id_are_shuffled(spark):
    rows = [(None, f"text {i}", "en", "a") for i in range(300)] + [(7, f"other {i}", "en", "a") for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    orders = Counter(r["_order"] for r in found)
    assert len(orders) == len(found) == len({(r["doc_id"], r["text"], r["_copy"]) for r in found})


def test_other_columns_are_refused_not_dropped(spark):
    store = Store(spark, scratch_path(spark, "columns"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    for rows, schema in (([(2, "b", 1)], "doc_id long, text string, more int"), ([(2,)], "doc_id long"), ([("2", "b")], "doc_id string, text string")):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame(rows, schema))
    store.append(spark.createDataFrame([("c", 3)], "text string, doc_id long"))
    assert sorted((r["doc_id"], r["text"]) for r in store.read().collect()) == [(1, "a"), (3, "c")]


FOLDER = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
class Unset:
    def get(self, name, default=None):
        return default if name == "spark.checkpoint.dir" else type(spark.conf).get(spark.conf, name, default)
class Session:
    conf, sparkContext = Unset(), spark.sparkContext
from lodestone import session
from lodestone.llm import scratch
for own in (session.shared_dir, scratch.shared_dir):
    assert own(Session()) == own(Session()) != ""
"""


def test_a_local_session_without_a_shared_folder_gets_one():
    subprocess.run([sys.executable, "-c", FOLDER], check=True, timeout=120)
