"""Operator 1, language identification by compression.

Each language has a raw-content zstandard dictionary of its own text. A text is compressed with every dictionary, in independent
blocks of BLOCK bytes, so that a long one can't learn from itself and its margin doesn't shrink with length; the smallest sum
of sizes names the language, unless the next smallest is so near that the text is rejected.

The dictionaries are fitted on a bounded sample: of each declared language the SAMPLE rows with text whose ids hash lowest, each with an equal
share of DICTIONARY_BYTES (long texts no more than that, so that no one text makes a dictionary). Everything else is one projection of the text column; nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, DICTIONARY_BYTES, LEVEL, MARGIN, SEED = 64, 64 << 10, 6, 0.01, 11
BLOCK = 16 << 10
RESULT = "struct<language:string,runner_up:string,bytes_best:long,bytes_second:long,margin:double>"


def fit_dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES, seed: int = SEED) -> dict[str, bytes]:
    """Dictionaries by language. Rows without a language or with an empty text don't count; ties of the hash fall to the lower
    id. Ids are ranked without the texts, which are then fetched for the sample only."""
    d = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang IS NOT NULL AND id IS NOT NULL AND text <> ''")
    order = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = d.select("id", "lang", F.xxhash64(F.lit(seed), "id").alias("hash")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct()
    rows = d.join(F.broadcast(chosen), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    rows = rows.select("lang", "id", F.xxhash64(F.lit(seed), "id").alias("hash"), F.encode("text", "utf-8").alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.hash, r.id, r.text)):
        texts.setdefault(r.lang, []).append(bytes(r.text))
    out = {k: shared_out(v, size) for k, v in texts.items()}
    return {k: v for k, v in out.items() if len(v) >= 8}


def shared_out(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes in which every text has an equal share; what short texts leave goes to longer ones. A
    text that is longer than its share gives its begin, cut between characters."""
    share, left, todo = {}, size - len(texts), sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    for k, i in enumerate(todo):
        share[i] = min(len(texts[i]), max(0, left // (len(todo) - k)))
        left -= share[i]
    cut = lambda t, n: t[:n] if n >= len(t) else t[:n].decode("utf-8", "ignore").encode()
    return b"".join(cut(t, share[i]) + b"\n" for i, t in enumerate(texts))


class Identifier:
    """Compressors with one dictionary each, made once per worker."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
        self.margin, self.coders = margin, []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: bytes | None) -> tuple[str | None, str | None, int | None, int | None, float]:
        """(language or None, runner-up, best size, second size, margin). Margin: how much smaller the best is, as a share of the second."""
        if not text or not self.coders:
            return None, None, None, None, 0.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.coders)
        if len(sizes) == 1:
            return sizes[0][1], None, sizes[0][0], None, 1.0
        (best, lang), (second, other) = sizes[:2]
        margin = (second - best) / second
        return (lang if margin >= self.margin else None), other, best, second, margin


_made: dict[str, Identifier] = {}


def identifier(spark: SparkSession, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
    """A column function text -> RESULT; one dictionary of bounded size for each language is broadcast."""
    shared = spark.sparkContext.broadcast((dictionaries, level, margin))
    name = hashlib.sha256(repr((sorted(dictionaries.items()), level, margin)).encode()).hexdigest()

    @F.arrow_udf(RESULT)
    def identify(text: pa.Array) -> pa.Array:
        if name not in _made:
            _made.clear()
            _made[name] = Identifier(*shared.value)
        found = [_made[name](x) for x in text.cast(pa.binary()).to_pylist()]
        kinds = {"language": pa.string(), "runner_up": pa.string(), "bytes_best": pa.int64(), "bytes_second": pa.int64(), "margin": pa.float64()}
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds.values())], list(kinds))

    return identify


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """A row for each document: doc_id, declared (its lang), language (null: rejected), runner_up, margin and accepted.

    Null and empty texts are rejected with margin 0. Equal sizes are a margin of 0 and rejected, whatever the order of names
    (unless margin is 0: then the lower name wins). With one known language every text is accepted; with none, none is. Each row is
    judged alone: repeated rows repeat, an empty table gives no rows, other columns are ignored.
    """
    if dictionaries is None:
        dictionaries = fit_dictionaries(docs)
    udf = identifier(docs.sparkSession, dictionaries, level, margin)
    d = docs.select("doc_id", F.col("lang").alias("declared"), udf("text").alias("r"))
    return d.select("doc_id", "declared", "r.language", "r.runner_up", F.round("r.margin", 6).alias("margin"), F.col("r.language").isNotNull().alias("accepted"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
