"""What the corpus operators share on the Spark side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import WORD_RE

#: Where the public tokenizer vocabularies are, unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. A folder of this machine only if the session names
    none and is local, as in tests; a cluster without the setting is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomtext-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null; the same words as in kernels."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0))


def lowest_hashed(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows with the lowest seeded hashes of key: a bounded sample that doesn't depend on row order."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def between_stages(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
