"""Incremental keyword indexing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import tokens

DOCUMENT = "doc string, text string, at timestamp"


def documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines documents as they arrive in a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run(docs: DataFrame, postings: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of each batch, in a folder of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = batch.select("doc", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
        found.write.mode("overwrite").parquet(f"{postings}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(docs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Documents and tokens by event-time window; what is later than ``late`` is left out."""
    n = F.size(tokens(F.col("text")))
    return docs.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"))
