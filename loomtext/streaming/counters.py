"""Streaming forms: counters that grow as data comes, and stateless filters and tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import social_tokenize_to_string
from ..operators.naive_bayes import Model, Trainer
from ..sources.corpora import tweets


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Counts by key over everything seen; state is one number a key. For output modes update and complete."""
    return stream.groupBy(*keys).agg(F.count("*").alias("cnt"))


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts by key and tumbling window; rows later than `late` are dropped and finished windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), *keys).agg(F.count("*").alias("cnt"))


def filtered_tweets(stream: DataFrame) -> DataFrame:
    return tweets(stream)


def tokenized(stream: DataFrame, column: str = "value") -> DataFrame:
    return stream.withColumn("tokens", social_tokenize_to_string(F.col(column)))


class OnlineBayes:
    """Naive Bayes that learns from micro-batches of (doc_id, label, feature): each batch is counted, and its counts, with its
    number, are written under `path`; a batch that is run again replaces its own. The model adds up the batches, so it is exact
    at any time, and documents of one batch must not go on in the next."""

    def __init__(self, spark: SparkSession, path: str, lam: float = 1.0):
        self.spark, self.path, self.lam = spark, path, lam

    def learn(self, batch: DataFrame, number: int) -> None:
        t = Trainer.of(batch)
        rows = t.features.select("label", "feature", "cnt").unionByName(t.labels.select("label", F.lit(None).cast("string").alias("feature"), "cnt"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def model(self) -> Model:
        sums = self.spark.read.parquet(self.path).groupBy("label", "feature").agg(F.sum("cnt").alias("cnt"))
        return Trainer(sums.where("feature IS NULL").select("label", "cnt"), sums.where("feature IS NOT NULL").select("label", "feature", "cnt")).model(self.lam)
