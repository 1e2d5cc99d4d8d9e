import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, licenses, mixing
from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch, scratch, scratch_path
from lodestone.llm.sharding import Conflict, Shard, Store, shard
from lodestone.llm.shingles import sets_of


# --- sharding ---------------------------------------------------------------------


def test_store_keeps_rows_and_versions(spark, messy):
    store = Store(spark, scratch_path(spark, "store"), target=20_000)
    for i in range(5):
        store.append(messy.repartition(3))
        first = store.versions()[-1]
    store.compact()
    assert store.read(1).count() == messy.count()
    assert store.read(first).count() == store.read().count() == 5 * messy.count()
    assert len(store.shards()) < len(store.shards(first))
    key = lambda df: sorted(map(str, df.select(messy.columns).collect()))
    assert key(store.read()) == sorted(5 * key(messy))


def test_two_writers_of_a_version(spark, messy):
    store = Store(spark, scratch_path(spark, "store"))
    store.append(messy)
    with pytest.raises(Conflict):
        store._commit([], 0)
    assert store.versions() == [1] and store.read().count() == messy.count()


def test_tiers_and_plan(spark):
    store = Store(spark, scratch_path(spark, "store"), target=1000)
    assert [Shard("x", b, 1).tier(1000) for b in (2000, 500, 499, 125, 124, 1)] == [0, 0, 1, 1, 2, 5]
    assert store.plan([Shard(str(i), 600, 1) for i in range(9)]) == []
    assert len(store.plan([Shard(str(i), 30, 1) for i in range(4)])) == 4


def test_sharding_an_empty_table(nothing):
    assert shard(nothing).count() == 0


# --- licenses ---------------------------------------------------------------------


def test_license_scan(messy, nothing):
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(messy).collect()}
    assert set(got) == {(None, "MIT"), (12, "Apache-2.0")}
    assert got[12, "Apache-2.0"]["containment"] == 1.0
    assert licenses.scan(nothing).count() == 0


def test_license_scan_is_exact(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(120):
        name = sorted(licenses.TEMPLATES)[i % len(licenses.TEMPLATES)]
        notice = re.findall("[a-z0-9]+", licenses.TEMPLATES[name].lower())
        for _ in range(i % 4):
            notice[rng.integers(len(notice))] = "changed"
        rows.append((i, " ".join([*rng.choice(words, 60), *notice, *rng.choice(words, 80)])))
    got = {(r["doc_id"], r["license"]): round(r["containment"], 9) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for i, text in rows:
        w = text.split()
        h = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)]
        for name, t in licenses.TEMPLATES.items():
            tw = re.findall("[a-z0-9]+", t.lower())
            parts = {" ".join(tw[j : j + 5]) for j in range(len(tw) - 4)}
            step = 2 ** math.ceil(math.log2(len(tw) - 4))
            best = max(len(parts & set(h[a : a + 2 * step])) / len(parts) for a in range(0, len(h), step))
            if best >= 0.8:
                want[i, name] = round(best, 9)
    assert got == want


def _windows(text, template):
    """Windows that hold 0.8 of a template."""
    w, t = text.split(), re.findall("[a-z0-9]+", template.lower())
    h, parts = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)], {" ".join(t[j : j + 5]) for j in range(len(t) - 4)}
    step = 2 ** math.ceil(math.log2(len(t) - 4))
    return sum(len(parts & set(h[a : a + 2 * step])) >= 0.8 * len(parts) for a in range(0, len(h), step))


def test_license_scan_meets_every_window(spark):
    """A notice of few shingles, cut to 0.85 of them, in random words."""
    rng = np.random.default_rng(6)
    name = "MPL-2.0"
    cut = re.findall("[a-z0-9]+", licenses.TEMPLATES[name].lower())[2:]
    rows = [(i, " ".join([*(f"r{x}" for x in rng.integers(10**9, size=rng.integers(40))), *cut, *(f"r{x}" for x in rng.integers(10**9, size=40))])) for i in range(1500)]
    want = {i: n for i, text in rows if (n := _windows(text, licenses.TEMPLATES[name]))}
    got = {r["doc_id"]: r["n_windows"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("license") == name).collect()}
    assert len(want) == len(rows) and got == want


def test_a_short_template_is_refused(messy):
    with pytest.raises(ValueError):
        licenses.scan(messy, {"x": "too short"})


# --- mixing -----------------------------------------------------------------------


def test_mixing_reaches_the_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 40).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    mixed = mixing.mix(docs, {"hot": 0.2, "s1": 0.5, "s2": 0.3})
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(n.values())
    assert set(n) == {"hot", "s1", "s2"} and abs(total - 20_000) < 600
    for name, w in (("hot", 0.2), ("s1", 0.5), ("s2", 0.3)):
        assert abs(n[name] / total - w) < 0.02
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7), {"hot": 0.2, "s1": 0.5, "s2": 0.3}).collect()))


def test_copies_are_poisson(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = Counter(r["_copies"] for r in mixing.mix(docs, {"a": 0.75, "b": 0.25}).where("source = 'a'").dropDuplicates(["doc_id"]).collect())
    for k in (1, 2, 3, 4):
        want = 15_000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(got[k] - want) < 5 * math.sqrt(want)


@pytest.mark.parametrize("rate", [600, 900, 5000])
def test_copies_of_a_high_rate_are_poisson(spark, rate):
    n = 200
    rows = [(i, "text", "tiny") for i in range(n)] + [(n, "x" * (2 * rate * 4 * n - 4 * n), "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"tiny": 0.5, "big": 0.5}).where("source = 'tiny'")
    got = [(r["n"], r["copies"]) for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("_copies").alias("copies")).collect()]
    copies = np.array([c for _, c in got])
    assert len(got) == n and all(a == b for a, b in got)
    assert abs(copies.mean() - rate) < 5 * math.sqrt(rate / n)
    assert 0.6 < copies.var() / rate < 1.6


@pytest.mark.parametrize("rate", [0.5, 50, 2000])
def test_moments_of_copies(spark, rate):
    """Mean and variance of a Poisson number are its rate; the bounds are five standard errors."""
    n = 4000 if rate < 10 else 300
    docs = spark.createDataFrame([(i, "text", "tiny") for i in range(n)] + [(n, "x" * int(2 * rate * 4 * n - 4 * n) if rate > 0.5 else "x" * 4 * n, "big")], "doc_id long, text string, source string")
    weights = {"tiny": 0.5, "big": 0.5} if rate > 0.5 else {"tiny": 0.25, "big": 0.75}
    copies = np.array([r["c"] for r in mixing.mix(docs, weights).where("source = 'tiny'").groupBy("doc_id").agg(F.max("_copies").alias("c")).collect()] + [0] * n)[:n]
    assert abs(copies.mean() - rate) < 5 * math.sqrt(rate / n)
    assert abs(copies.var() / rate - 1) < 5 * math.sqrt((2 + 1 / rate) / n)


def test_small_weights_and_empty_sources(spark):
    rows = [(i, "x" * 50, "a") for i in range(3000)] + [(3000 + i, "x" * 50, "b") for i in range(3000)] + [(6000 + i, "" if i % 2 else None, "none") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.mix(docs, {"a": 0.00002, "b": 0.00001}).collect())
    assert set(n) == {"a", "b"} and abs(n["a"] / n["b"] - 2) < 0.3
    kept = Counter(r["doc_id"] for r in mixing.mix(docs).where("source = 'none'").collect())
    assert len(kept) == 40 and set(kept.values()) == {1}
    assert Counter(r["doc_id"] for r in mixing.mix(docs, {"a": 1.0, "none": 1.0}).where("source = 'none'").collect()) == kept
    assert mixing.mix(docs, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def test_mixing_messy_rows(messy, nothing):
    got = mixing.mix(messy)
    assert set(messy.columns) < set(got.columns)
    per = Counter((r["doc_id"], r["text"], r["_copy"]) for r in got.collect())
    assert set(per.values()) <= {1, 2}
    assert {r["doc_id"] for r in got.where("source IS NULL AND text IS NULL").collect()} <= {3}
    assert mixing.mix(nothing).count() == 0


def test_mixing_keeps_columns_named_like_ours(messy):
    named = ["_copy", "_Copies", "_order", "_source", "source_", "_bytes", "rate", "below", "row", "key", "u", "of", "copies"]
    wide = messy.select("*", *(F.lit(i).alias(c) for i, c in enumerate(named)))
    got = mixing.mix(wide)
    assert got.columns == [*wide.columns, "__copies", "__copy", "__order"]
    plain = Counter((r["doc_id"], r["text"], r["_copy"]) for r in mixing.mix(messy).collect())
    assert Counter((r["doc_id"], r["text"], r["__copy"]) for r in got.collect()) == plain
    assert all(r[c] == i for r in got.collect() for i, c in enumerate(named))


# --- language ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["tion", "the", "ing", "wh"], "ab": ["tion", "ther", "ingen", "wha"], "ba": ["çe", "eau", "ment", "que"], "bb": ["ció", "mente", "que", "eau"]}
    rows = []
    for i in range(1600):
        lang = ["aa", "ab", "ba", "bb"][i % 4]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(60)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(tongues):
    got = langid.language_id(tongues, per_language=200).join(tongues, "doc_id").where("held_out").collect()
    assert len(got) > 300 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_families_hold_like_languages(tongues):
    model = langid.learn(tongues, 200)
    assert model.families == [["aa", "ab"], ["ba", "bb"]]


def test_prediction_reads_text_only(tongues):
    model = langid.learn(tongues, 100)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(tongues, model).collect()}
    other = tongues.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 5000)
    assert {r["doc_id"] - 5000: (r["lang_pred"], r["score"]) for r in langid.identify(other, model).collect()} == plain


def test_language_of_messy_rows(messy, nothing):
    got = langid.language_id(messy).collect()
    assert len(got) == messy.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert by[6]["lang_pred"] != "und" and by[None]["held_out"] is False
    assert langid.language_id(nothing).count() == 0
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_id(unlabelled).collect()} == {"und"}


# --- similarity join --------------------------------------------------------------


def _brute(rows, num=90, den=100):
    sets = {i: _set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 3 else frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2))


@pytest.mark.parametrize("bucket", [40, 2])
def test_classes_equal_brute_force(spark, monkeypatch, bucket):
    """With a small bucket nearly every shingle is frequent, so hubs and pairs across components decide."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, common = [], list(rng.choice(vocabulary, 60))
    for g in range(30):
        base = list(rng.choice(vocabulary, rng.integers(5, 150))) + common * (g % 2)
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[rng.integers(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("bucket", [40, 2])
def test_classes_at_a_lower_threshold(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(25):
        base = rng.choice(300, rng.integers(5, 200))
        for _ in range(6):
            own = base.copy()
            at = rng.integers(len(own), size=int(len(own) * rng.uniform(0, 0.06)))
            own[at] = rng.integers(300, size=len(at))
            rows.append((len(rows), " ".join(map(str, own))))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), num=80).collect()}
    assert got == _brute(rows, 80) != _brute(rows)


def test_pairs_across_components_are_made_once(spark):
    """Forty near copies share most of their shingles; each pair of them is made at the first one, not at all."""
    rng = np.random.default_rng(3)
    base, rows = list(range(100)), []
    for i in range(40):
        own = list(base)
        own[rng.integers(100)] = 1000 + i
        rows.append((i, " ".join(map(str, own))))
    with scratch(spark, "once") as own:
        join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"), own)
        posted = join._posted(join._prefixes()).withColumn("share", F.lit(41))
        open_ = own.put(join._open(posted, spark.createDataFrame([], "a long, b long")), "open")
        wide = open_.alias("a").join(open_.alias("b"), "token").where((F.col("a.set_id") < F.col("b.set_id")) & join._near("a", "b") & join._alike())
        every = {tuple(r) for r in wide.select("a.set_id", F.col("b.set_id").alias("b")).collect()}
        made, repeated = [tuple(r) for r in join._met(open_).collect()], wide.count()
    assert repeated > 3 * len(every)
    assert len(made) == len(every) and set(made) == every


def test_classes_of_messy_rows(messy, nothing):
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in jaccard.jaccard_classes(messy).collect())
    assert got[1, True, 1] == 2 and got[2, True, 1] == 1
    assert got[3, False, 3] == got[4, False, 4] == got[5, False, 5] == 1
    assert got[6, True, 6] == got[7, True, 6] == 1
    assert got[9, True, 9] == got[10, True, 9] == 1
    assert got[None, True, None] == 1 and sum(got.values()) == messy.count()
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_one_of_each(messy, nothing):
    got = sorted(str(r["doc_id"]) for r in jaccard.one_of_each(messy).collect())
    assert got == sorted(["1", "3", "4", "5", "6", "8", "9", "None", "11", "12"])
    assert jaccard.one_of_each(messy).columns == messy.columns and jaccard.one_of_each(nothing).count() == 0


def test_sketches_bound_the_difference():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for _ in range(50):
        words = rng.choice(500, rng.integers(3, 300)).tolist()
        other = list(words)
        for _ in range(int(rng.integers(0, 40))):
            other[rng.integers(len(other))] = int(rng.integers(500))
        a, b = sets_of(pa.array([" ".join(map(str, w)) for w in (words, other)]), 3)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard.differing(jaccard.odd_sketch(a), jaccard.odd_sketch(b)) <= apart
        assert int(np.bitwise_count((jaccard.small_sketch(a) ^ jaccard.small_sketch(b)).view(np.uint64)).sum()) <= apart


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "components")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "components")).count() == 0


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    a = " ".join(f"a{i}" for i in range(80))
    b = " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "else"), (4, "other words here now")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 78): 1, (2, 79): 1, (3, 79): 1, (4, 1): 4, (4, 2): 4}


def test_texts_are_joined_beyond_what_may_be_sent(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    a = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(10 * k + j, a[k] + " tail" * j) for k in range(4) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs).collect()} == {10 * k + j: 10 * k for k in range(4) for j in range(3)}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == [0, 10, 20, 30]


def test_learning_rows_are_bounded(spark, monkeypatch):
    """Thousands of rows with one id, or that are equal, teach no more than per_language rows."""
    seen = []
    model = langid.Model

    class Spy(model):
        def __init__(self, x, lang):
            seen.append(Counter(lang.tolist()))
            super().__init__(x, lang)

    monkeypatch.setattr(langid, "Model", Spy)
    rows = [(None, f"word{i} and text", "aa") for i in range(3000)] + [(7, "the same text", "bb")] * 2000 + [(i, f"andere worte {i}", "bb") for i in range(300)]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10)
    assert seen[0]["aa"] == 10 and seen[0]["bb"] <= 10
    many = spark.createDataFrame([(i, "text", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    # Many labels are no error any more: those with the most rows are learned, ties by name.
    langid.learn(many, 10, most_languages=5)
    assert len(seen[1]) == 5 and set(seen[1].values()) == {1}


def test_held_out_rows_teach_nothing(spark):
    """held_out is crc32 of the id as text modulo 4 being 2, and a language that only such rows have is never predicted."""
    rows = [(i, ("eins zwei drei" if zlib.crc32(str(i).encode()) % 4 == 2 else "one two three") + f" {i}", "de" if zlib.crc32(str(i).encode()) % 4 == 2 else "en") for i in range(200)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    assert {r["lang_pred"] for r in got} == {"en"}


def test_a_compaction_that_lost_a_race_doubles_nothing(spark, monkeypatch):
    store = Store(spark, scratch_path(spark, "race"), 1 << 20)
    for i in range(8):
        store.append(spark.range(250 * i, 250 * i + 250).withColumn("_metadata", F.lit("m")).withColumn("_shard", F.lit(i)).coalesce(1))
    other = Store(spark, store.root, 1 << 20)
    merged, raced = Store._merged, []

    def slow(self, run):
        out = merged(self, run)
        if self is store and not raced:
            raced.append(1)
            other.compact()  # another writer merges the same shards first
        return out

    monkeypatch.setattr(Store, "_merged", slow)
    store.compact()
    got = store.read()
    assert raced and sorted(r["id"] for r in got.collect()) == list(range(2000))
    assert got.columns == ["id", "_metadata", "_shard", "__shard"] and got.where("__shard LIKE 'part-%'").count() == 2000


def test_an_append_that_lost_a_race_is_committed_again(spark, monkeypatch):
    store = Store(spark, scratch_path(spark, "race"), 1 << 20)
    commit, raced = Store._commit, []

    def late(self, shards, base):
        if not raced:
            raced.append(1)
            Store(spark, store.root, 1 << 20).append(spark.range(5).coalesce(1))
        return commit(self, shards, base)

    monkeypatch.setattr(Store, "_commit", late)
    store.append(spark.range(5, 9).coalesce(1))
    assert raced and sorted(r["id"] for r in store.read().collect()) == list(range(9))
