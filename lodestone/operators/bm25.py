"""BM25 as posting-list joins and partial aggregates.

Postings are (term, doc, tf); a search joins the query terms with them, so only
documents that share a term are touched.  Scores are rounded to 6 digits before
they are ranked, so that the order of a sum never decides a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_term, raw_tokens, tokens
from lodestone.operators.ranking import running
from lodestone.session import written

K1, B = 1.5, 0.75
#: Folders of a saved index, and documents of a file of one; documents that a pool holds beside negatives and positives.
BUCKETS, FILE_DOCS, SPARE = 64, 500_000, 50


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """Postings, document lengths, document frequencies and corpus statistics of ``docs`` (doc, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc", "text")
        # Texts are dealt by document once; terms are counted and lengths summed where they lie.
        raw = docs.select("doc", "text").repartition("doc").select("doc", F.explode(raw_tokens(F.col("text"))).alias("raw")).where(is_term(F.col("raw")))
        counted = raw.groupBy("doc", F.lower("raw").alias("term")).agg(F.count("*").alias("tf"))
        self.postings = counted.select("term", "doc", "tf", F.sum("tf").over(Window.partitionBy("doc")).alias("length"))
        self.frequencies = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        # Documents without tokens count, too.
        self.counted = docs.agg(F.count("*").alias("n"))
        # Tokens are counted where a text lies; a repeated id doesn't change their sum.
        self.stats = self._stats(self.docs.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("tf")))

    def whole(self) -> DataFrame:
        """doc, text: a row for each id; texts of repeated ids are put together, others stay where they lie."""
        ids = written(self.docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("doc").alias("same")), "repeated")
        if ids.isEmpty():
            return self.docs
        # A struct is equal to itself with a null id, too.
        keyed = self.docs.withColumn("same", F.struct("doc"))
        again = keyed.join(ids, "same", "left_semi").groupBy("doc").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
        return keyed.join(ids, "same", "left_anti").select("doc", "text").unionByName(again)

    def terms(self) -> DataFrame:
        """term, df, cf: documents that have a term, and how often all do.

        A text is cut, and its terms told apart, where it lies; only a term's sums are shuffled.
        """
        each = F.concat(F.transform(F.array_distinct("all"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform("all", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))
        cut = self.whole().select(tokens(F.coalesce("text", F.lit(""))).alias("all"))
        return cut.select(F.explode(each).alias("t")).groupBy("t.term").agg(F.sum("t.d").alias("df"), F.sum("t.c").alias("cf"))

    @property
    def lengths(self) -> DataFrame:
        return self.postings.groupBy("doc").agg(F.max("length").alias("length"))

    def _stats(self, postings: DataFrame) -> DataFrame:
        total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("double").alias("total"))
        return self.counted.select("n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(total.scalar() / F.greatest("n", F.lit(1))).alias("avg_dl"))

    def save(self, path: str) -> None:
        """Write the index: postings with the document's length, frequencies and statistics.

        Postings lie in BUCKETS folders by a hash of the term, so a search reads those of its terms alone; a folder is
        dealt by document, so a very common term is many tasks.  Postings are shuffled once; a term's frequency is read
        off the written ones.
        """
        spark = self.postings.sparkSession
        many = 1 + self.counted.first()["n"] // FILE_DOCS
        spread = self.postings.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(many)))
        spread.sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.postings.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
        saved = self._postings(spark, path)
        saved.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")
        self._stats(saved).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def _postings(spark: SparkSession, path: str) -> DataFrame:
        columns = spark.read.parquet(f"{path}/columns").schema
        return spark.read.schema(columns.add("bucket", "integer")).parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """A saved index; searches read the written tables and tokenise no document."""
        own = cls.__new__(cls)
        own.frequencies, own.stats = (spark.read.parquet(f"{path}/{name}") for name in ("frequencies", "stats"))
        own.postings = cls._postings(spark, path)
        own.counted = own.stats.select("n")
        return own

    def holding(self, asked: DataFrame) -> DataFrame:
        """term, doc, tf, length of the postings of the terms asked for."""
        found = self.postings
        if "bucket" in found.columns:
            buckets = [r["bucket"] for r in asked.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]  # at most BUCKETS
            found = found.where(F.col("bucket").isin(buckets))
        return found.join(asked.select("term").distinct(), "term", "left_semi").select("term", "doc", "tf", "length")

    _of = holding

    def scores(self, queries: DataFrame, dedup_terms: bool = True) -> DataFrame:
        """query, doc, score for every document with a term of the query (query, text).

        An index that isn't saved reads the texts, and writes none of it.  Postings are dealt by document before they meet the queries: a document's terms are together then, and
        its scores are summed without another shuffle.
        """
        asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term"))
        asked = asked.distinct() if dedup_terms else asked.groupBy("query", "term").agg(F.count("*").alias("times"))
        saved = "bucket" in self.postings.columns
        if saved:
            frequencies, stats = self.frequencies, self.stats
        else:
            asked = written(asked, "terms")
            frequencies, stats = self._asked_frequencies(asked), written(self.stats, "stats")
        n, avg = stats.select(F.col("n").cast("double")).scalar(), stats.select("avg_dl").scalar()
        idf = F.ln((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
        tf = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / avg))
        # Written, so that its size is known where it meets the postings: sent to every task if small, joined by term beyond.
        # Both factors are worked out before they meet: a posting meets every query that has its term.
        asked = written(asked.join(frequencies, "term").withColumn("idf", idf), "asked")
        held = self.holding(asked).repartition("doc") if saved else self._counted(asked)
        held = held.select("doc", "term", tf.alias("weight"))
        times = F.lit(1) if dedup_terms else F.col("times")
        return held.join(asked, "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("idf") * F.col("weight") * times), 6).alias("score"))

    def _asked_frequencies(self, asked: DataFrame) -> DataFrame:
        """term, df of the terms asked for."""
        each = self.whole().select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return each.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))

    def _counted(self, asked: DataFrame) -> DataFrame:
        """term, doc, tf, length of the terms asked for: texts are dealt by document once, and no other term is kept."""
        each = self.whole().repartition("doc").select("doc", tokens(F.col("text")).alias("all")).select("doc", F.size("all").cast("long").alias("length"), F.explode("all").alias("term"))
        return each.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))

    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """query, rank, doc, score: each query's k best."""
        return ranked(self.scores(queries), k)


def ranked(scores: DataFrame, k: int, by: str = "query") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def pool(scores: DataFrame, k: int, positives: int) -> DataFrame:
    """query, doc, score: what hard negatives, gaps and up to ``positives`` best of a query are taken from; written, as it is read several times."""
    return written(ranked(scores, k + SPARE + positives).select("query", "doc", "score"), "pool")


def hard_negatives(scores: DataFrame, positives: DataFrame, k: int = 16, prefix: DataFrame | None = None) -> DataFrame:
    """The best-scored documents that aren't positives.

    The pool is the k + positives + 50 best; what isn't allowed leaves it before the
    k first are kept.  ``positives``: query, doc; ``prefix``: query, doc pairs that are allowed.
    """
    count = positives.groupBy("query").agg(F.count("*").alias("n_pos"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    pool = scores.withColumn("pool_rank", rank).join(count, "query", "left").where(F.col("pool_rank") <= k + SPARE + F.coalesce("n_pos", F.lit(0)))
    kept = pool.join(positives, ["query", "doc"], "left_anti")
    if prefix is not None:
        kept = kept.join(prefix, ["query", "doc"], "left_semi")
    return ranked(kept.select("query", "doc", "score"), k)


def difficulty_gap(scores: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """query, gap: best positive score less the first hard negative's; 0 if either is missing."""
    best = scores.join(positives, ["query", "doc"], "left_semi").groupBy("query").agg(F.max("score").alias("pos"))
    first = negatives.where("rank = 1").select("query", F.col("score").alias("neg"))
    every = positives.select("query").distinct()
    return every.join(best, "query", "left").join(first, "query", "left").select("query", F.coalesce(F.round(F.col("pos") - F.col("neg"), 6), F.lit(0.0)).alias("gap"))


def difficulty_rank(gaps: DataFrame) -> DataFrame:
    """query, gap, difficulty: 1 - (rows with a smaller gap) / (rows - 1).

    Counted per value, and summed over values by ranges of them.
    """
    gaps = written(gaps, "gaps")
    placed = running(gaps.groupBy("gap").agg(F.count("*").alias("n")), ["gap"], F.col("n"), "below").drop("n")
    total = gaps.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n")).scalar()
    return gaps.join(placed, "gap").select("query", "gap", F.round(F.lit(1.0) - F.col("below") / total, 6).alias("difficulty"))
