"""Language identification (operator 8).

Method: hierarchical discrimination.  Languages are put into families by the
likeness of their mean features, closest first; a linear support vector machine
for each family tells it from the rest, then one-versus-one machines vote among
the languages of the family that won.

Features are hashed byte 1- to 4-grams of the whole lower-cased text, as square
roots of their shares.  The machines are fitted on the driver from features of at
most ``per_language`` rows of each language (the smallest hashes of id and text
over all learning rows; equal rows teach once); a row of features has a fixed size
and the number of languages is bounded.  Every row is then scored in
place, without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with one learned language everything else is that language with score 1; with
none, ``und``; a null id counts as not held out; rows without a language teach
nothing; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import gathered
from lodestone.llm.scratch import scratch, tidily, tidy

#: Hashed features for grams of 1, 2, 3 and 4 bytes.
GRAMS = ((1, 256), (2, 1024), (3, 2048), (4, 2048))
SIZE = sum(n for _, n in GRAMS)
#: Bytes handled at once; small arrays stay in the processor's cache.
STEP = 1 << 18
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in range(128):
    if not (97 <= _b <= 122 or 65 <= _b <= 90):
        _FOLD[_b] = 32


def features(texts: list[bytes]) -> np.ndarray:
    """One row of SIZE numbers for each text; its length is 1, or 0 for an empty text."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for row, text in enumerate(texts):
        for start in range(0, len(text), STEP):
            b = _FOLD[np.frombuffer(text, np.uint8, min(STEP + 3, len(text) - start), start)].astype(np.uint32)
            at, key = 0, np.zeros(len(b), dtype=np.uint32)
            for gram, size in GRAMS:
                key = (key[: len(b) - gram + 1] * np.uint32(0x01000193)) ^ b[gram - 1 :]
                own = key[: max(0, min(STEP, len(key)))]
                out[row, at : at + size] += np.bincount(((own * np.uint32(2654435761)) >> 16) & (size - 1), minlength=size)
                at += size
    np.sqrt(out, out=out)
    return out / np.maximum(1e-12, np.sqrt((out * out).sum(axis=1, keepdims=True)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, rounds: int = 80) -> np.ndarray:
    """A linear machine (squared hinge, last entry the bias) by accelerated gradient steps; y is +-1."""
    weight = weight / weight.sum()
    step = 1.0 / (1.0 / c + 2 * 2 * (1.0 + float((weight * np.einsum("ij,ij->i", x, x)).sum())))
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float64)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        pull = weight * slack * y
        grad = v / c - 2 * np.append(pull.astype(x.dtype) @ x, pull.sum())
        new = v - step * grad
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


class Model:
    """Families, machines and the scale of their margins."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        self.families = self._families(x, lang)
        part = {name: f for f, names in enumerate(self.families) for name in names}
        family = np.array([part[name] for name in lang.tolist()])
        columns = [self._fit(x, family == f) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for names in self.families for a, b in combinations(names, 2)]
        columns += [self._fit(x[own := (lang == a) | (lang == b)], lang[own] == a) for a, b in self.pairs]
        self.w = np.stack(columns, axis=1) if columns else np.zeros((SIZE + 1, 0))

    def _families(self, x: np.ndarray, lang: np.ndarray) -> list[list[str]]:
        """Half as many families as languages, by joining the most alike (average linkage)."""
        groups = [[name] for name in self.langs]
        means = {name: x[lang == name].mean(axis=0) for name in self.langs}
        overall = sum(means.values()) / max(1, len(means))
        rest = {name: (m - overall) / max(1e-12, float(np.linalg.norm(m - overall))) for name, m in means.items()}
        while len(groups) > max(1, -(-len(self.langs) // 2)):
            a, b = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([rest[m] @ rest[n] for m in groups[p[0]] for n in groups[p[1]]]))
            groups[a] = sorted(groups[a] + groups.pop(b))
        return sorted(groups)

    @staticmethod
    def _fit(x: np.ndarray, is_it: np.ndarray) -> np.ndarray:
        weight = np.where(is_it, 0.5 / max(1, is_it.sum()), 0.5 / max(1, (~is_it).sum()))
        return svm(x, np.where(is_it, 1.0, -1.0), weight)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into langs, score)."""
        margins = x @ self.w[:-1] + self.w[-1]
        sure = 1 / (1 + np.exp(-np.clip(4 * margins, -50, 50)))
        n, index = len(x), {name: i for i, name in enumerate(self.langs)}
        many = len(self.families) if len(self.families) > 1 else 0
        family = margins[:, :many].argmax(axis=1) if many else np.zeros(n, dtype=int)
        score = sure[np.arange(n), family] if many else np.ones(n)
        votes, worth = np.full((n, len(self.langs)), -1.0), np.full((n, len(self.langs)), 1.0)
        for f, names in enumerate(self.families):
            for name in names:
                votes[family == f, index[name]] = 0
        for i, (a, b) in enumerate(self.pairs):
            p = sure[:, many + i]
            live = votes[:, index[a]] >= 0
            votes[live, index[a]] += (p[live] >= 0.5) + 1e-3 * p[live]
            votes[live, index[b]] += (p[live] < 0.5) + 1e-3 * (1 - p[live])
            worth[:, index[a]] = np.minimum(worth[:, index[a]], p)
            worth[:, index[b]] = np.minimum(worth[:, index[b]], 1 - p)
        won = votes.argmax(axis=1)
        return won, score * worth[np.arange(n), won]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, per_language: int = 400, most_languages: int = 200, most_rows: int = 16_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on at most ``per_language`` different learning rows of each language, and ``most_rows`` of all; None without any.

    Of more than ``most_languages`` languages those with the most different rows are learned (ties by name); the
    others can't be predicted.  The three numbers bound what comes to the driver.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mix", F.xxhash64("id", "text"))
    with scratch(docs.sparkSession, "learning") as own:
        # Equal rows count and teach once, so a group of copies is one row before the shuffle.
        different = own.put(rows.select("lang", "mix").distinct(), "different")
        sizes = different.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
        learned = [r["lang"] for r in sizes.collect()]
        if not learned:
            return None
        each = min(per_language, max(1, most_rows // len(learned)))
        # The smallest hashes of each language: a task sends on no more than these of what it has read.
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("mix"))
        drawn = different.where(F.col("lang").isin(learned)).withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "mix")
        drawn = own.put(drawn, "drawn")
        sample = rows.join(F.broadcast(drawn), ["lang", "mix"]).groupBy("lang", "mix").agg(F.min("text").alias("text"))
        found = _features_of(sample)
    # One order, whatever the order of the rows, so that the same rows give the same model.
    found = found.sort_by([("lang", "ascending"), ("mix", "ascending")]).combine_chunks()
    x = np.frombuffer(found.column("x").chunk(0).buffers()[2], dtype=np.float32, count=found.num_rows * SIZE).reshape(-1, SIZE)
    return Model(x, np.array(found.column("lang").to_pylist()))


def _features_of(sample: DataFrame) -> pa.Table:
    """lang, mix, x of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                own = batch.slice(start, 64)
                x = features(pc.cast(own.column(2), pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "mix", "x"])

    return sample.mapInArrow(tidily(run), "lang string, mix long, x binary").toArrow()


def predictions(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a column."""
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
    able = np.flatnonzero(lettered) if model is not None else []
    for start in range(0, len(able), 64):
        own = able[start : start + 64]
        won, sure = model.predict(features(pc.cast(texts.take(pa.array(own)), pa.binary()).to_pylist()))
        lang[own], score[own] = np.array(model.langs, dtype=object)[won], sure
    return lang, score


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score of every whole text."""
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0):
            lang, score = predictions(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["_id", "lang_pred", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    with scratch(docs.sparkSession, "languages") as own:
        return own.keep(rows.mapInArrow(tidily(run), f"_id {kind}, lang_pred string, score double"), "predicted").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, with all their columns.  Only texts go to Python, and one bit a row comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        lang, _ = predictions(texts, shared.value)
        tidy()
        return pa.array(lang != UNKNOWN)

    return docs.where(known(F.col(text_col).cast("string")))


def language_id(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from rows that are not held out."""
    return identify(docs, learn(docs, per_language)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
