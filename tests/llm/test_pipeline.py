import numpy as np

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_messy_rows(spark, messy):
    docs, names = messy, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "mixture", "packed"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        kept[name] = sorted(str(r["doc_id"]) for r in docs.collect())
    assert kept["language_id"] == sorted(["1", "1", "2", "6", "7", "None", "9", "10", "11", "12"])
    assert kept["near_duplicates"] == sorted(["1", "6", "None", "9", "11", "12"])
    assert set(kept["mixture"]) <= set(kept["near_duplicates"]) and set(kept["packed"]) == set(kept["mixture"])


def test_columns_and_an_empty_table(spark, messy):
    docs = messy.select(COLUMNS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if name != "packed":
            assert docs.columns == COLUMNS


def test_near_copies_of_five_words_and_08_go(spark):
    rng = np.random.default_rng(4)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words), "en", "a", 0))

    def edited(words, n):
        own = list(words)
        for i in range(n):
            own[20 + i * len(own) // (n + 1)] = f"edit{len(rows)}x{i}"
        return own

    for g in range(4):
        base = [f"g{g}w{w}" for w in rng.permutation(500)]
        add(base)
        add(edited(base, 10))  # 446 / 546 of five words, 468 / 528 of three
        add([*base, *(f"g{g}tail{i}" for i in range(60))])  # 496 / 556 and 498 / 558
        add(edited(base, 13))  # 431 / 561: no near copy
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(4 * g + i for g in range(4) for i in (0, 3))
