"""Sources and sinks: line files, tagged and raw corpora, labelled instances, points, tweets, XML, and generated data."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- lines and files ---


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path, line_no, value): the lines of each file with their places, from 0; folders are read recursively.

    Files are read in blocks by many tasks; a line's number is its place in its block and the lines of the blocks before. Only with
    an encoding other than UTF-8 is a file read whole by one task, and then it must be below 2 GB."""
    if encoding and encoding.upper().replace("-", "") != "UTF8":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        lines = F.split(F.regexp_replace(F.decode(F.col("content"), encoding), r"\r\n?", "\n"), "\n")
        kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
        return files.select("path", F.posexplode(kept).alias("line_no", "value"))
    place = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    d = spark.read.option("recursiveFileLookup", "true").text(path).select(place.alias("path"), F.col("_metadata.file_block_start").alias("__block"), "value", F.monotonically_increasing_id().alias("__at"))
    sizes = d.groupBy(F.col("path").alias("__path"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__path").orderBy("__b")) - F.col("__n"))
    ranked = d.withColumn("__r", F.row_number().over(Window.partitionBy("path", "__block").orderBy("__at")) - 1)
    both = ranked.join(before, (F.col("path") == F.col("__path")) & (F.col("__block") == F.col("__b")))
    return both.select("path", (F.col("__before") + F.col("__r")).cast("int").alias("line_no"), "value")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*/*$", "")


def join_path(*parts: str) -> str:
    """Parts joined by single slashes; a leading slash of the first stays."""
    return ("/" if parts and parts[0].startswith("/") else "") + "/".join(p for x in parts if (p := x.strip("/")))


def strip_extension(name: Column) -> Column:
    """A file's name without its last extension; a name that begins with its only point stays."""
    return F.regexp_replace(name, r"(?<=[^/])[.][^./]*$", "")


def find_files(folder: str) -> list[str]:
    """All files below a folder of this machine, in order."""
    return sorted(os.path.join(at, name) for at, _, names in os.walk(folder) for name in names)


def make_folder(path: str) -> str:
    """The folder, made with those above it if it isn't there."""
    os.makedirs(path, exist_ok=True)
    return path


def remove(path: str) -> bool:
    """Removes a file or a whole folder; false if there is none."""
    if not os.path.lexists(path):
        return False
    shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
    return True


def temporary_folder(prefix: str = "loomtext-") -> str:
    """A new folder of the driver's own machine, for what no executor reads."""
    return tempfile.mkdtemp(prefix=prefix)


def find_binary(name: str, folder: str | None = None, variable: str | None = None) -> str | None:
    """An executable's path: in the folder, in the folder that an environment variable names, or on the search path."""
    places = [p for p in (folder, os.environ.get(variable) if variable else None) if p]
    return next((f for p in places if os.access(f := os.path.join(p, name), os.X_OK)), None) or shutil.which(name)


def pipe(df: DataFrame, column: str, command: list[str], out: str = "output") -> DataFrame:
    """df with a program's output for a column, one line of output for each line of input; one process for each batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            text = "".join(str(x).replace("\n", " ") + "\n" for x in p[column])
            done = subprocess.run(command, input=text, capture_output=True, text=True, check=True)
            yield p.assign(**{out: done.stdout.splitlines()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, `{out}` string")


# --- tagged and raw corpora ---


def _sentences(lines: DataFrame, is_delimiter: Column) -> DataFrame:
    """(path, seq_id, pos, value): runs of lines between delimiters; empty runs have no rows. Delimiters are counted by ranges of
    lines, and within a range, so that no task sees a whole file."""
    from ..operators.stored import once

    ranged = once(lines.select("path", "line_no", "value", is_delimiter.alias("__end")).repartitionByRange("path", "line_no").withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col("path").alias("__path"), F.col("__p").alias("__q")).agg(F.count_if("__end").alias("__n"))
    before = sizes.select("__path", "__q", (F.sum("__n").over(Window.partitionBy("__path").orderBy("__q")) - F.col("__n")).alias("__before"))
    w = Window.partitionBy("path", "__p").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("__r", F.sum(F.when(F.col("__end"), 1).otherwise(0)).over(w)).where(~F.col("__end"))
    kept = counted.join(before, F.col("path").eqNullSafe(F.col("__path")) & (F.col("__p") == F.col("__q"))).withColumn("seq_id", F.col("__r") + F.col("__before"))
    pos = F.row_number().over(Window.partitionBy("path", "seq_id").orderBy("line_no")) - 1
    return kept.select("path", "seq_id", pos.alias("pos"), "value")


def tagged_stream(lines: DataFrame, delimiter: str = "###/###") -> DataFrame:
    """(path, seq_id, pos, sym, tag) from one `sym/tag` a line; the last slash separates."""
    s = _sentences(lines.where(F.trim("value") != ""), F.trim("value") == delimiter)
    return s.select("path", "seq_id", "pos", F.regexp_extract("value", r"^\s*(.*)/([^/]*?)\s*$", 1).alias("sym"), F.regexp_extract("value", r"^\s*(.*)/([^/]*?)\s*$", 2).alias("tag"))


def raw_stream(lines: DataFrame, delimiter: str = "###") -> DataFrame:
    s = _sentences(lines.where(F.trim("value") != ""), F.trim("value") == delimiter)
    return s.select("path", "seq_id", "pos", F.trim("value").alias("sym"))


def tagged_lines(lines: DataFrame) -> DataFrame:
    """(path, seq_id, pos, sym, tag) from one sentence a line, of `sym|tag` items; the last bar separates."""
    items = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    d = lines.select("path", F.col("line_no").alias("seq_id"), F.posexplode(items).alias("pos", "x"))
    return d.select("path", "seq_id", "pos", F.regexp_extract("x", r"^(.*)\|([^|]*)$", 1).alias("sym"), F.regexp_extract("x", r"^(.*)\|([^|]*)$", 2).alias("tag"))


# --- labelled instances and points ---


def csv_instances(lines: DataFrame) -> DataFrame:
    """(path, doc_id, label, features): fields without quoting, the last of which is the label. Empty fields at the end don't count."""
    f = F.split(F.regexp_replace("value", ",+$", ""), ",")
    return lines.where("value <> ''").select("path", F.col("line_no").alias("doc_id"), F.element_at(f, -1).alias("label"), F.slice(f, F.lit(1), F.size(f) - 1).alias("features"))


def long_features(instances: DataFrame) -> DataFrame:
    """(doc_id, label, feature), one row for each feature."""
    return instances.select("doc_id", "label", F.explode("features").alias("feature"))


def attribute_values(instances: DataFrame, names: list[str]) -> DataFrame:
    """Features as attribute=value."""
    return instances.withColumn("features", F.transform("features", lambda x, i: F.concat_ws("=", F.get(F.array(*[F.lit(n) for n in names]), i), x)))


def attachments(lines: DataFrame) -> DataFrame:
    """(sent_no, verb, noun1, prep, noun2, label) from blank-separated lines."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where("trim(value) <> ''").select(F.get(f, F.lit(0)).cast("int").alias("sent_no"), *[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("verb", "noun1", "prep", "noun2", "label"), 1)])


def sentiment(lines: DataFrame) -> DataFrame:
    """(polarity, id, date, query, user, text) from lines separated by ;;"""
    f = F.split("value", ";;", 6)
    names = ("polarity", "id", "date", "query", "user", "text")
    return lines.where("value <> ''").select(*[F.get(f, F.lit(i)).try_cast("long" if n == "id" else "int").alias(n) if n in ("polarity", "id") else F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])


def point_lines(lines: DataFrame, numbers: int) -> DataFrame:
    """(id, name, coord): the last `numbers` fields are coordinates, all before them, blanks included, is the name."""
    pattern = r"^\s*(.*?)\s*" + r"\s+".join([r"(-?[\d.]+(?:[eE][+-]?\d+)?)"] * numbers) + r"\s*$"
    return lines.where(F.col("value").rlike(pattern)).select(F.col("line_no").alias("id"), F.regexp_extract("value", pattern, 1).alias("name"), F.array(*[F.regexp_extract("value", pattern, i + 2).cast("double") for i in range(numbers)]).alias("coord"))


def edges(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where("value <> ''").select(F.get(f, F.lit(0)).alias("src"), F.get(f, F.lit(1)).alias("dst"))


# --- JSON and XML ---

TWEET = "text string, retweeted boolean, created_at string, geo struct<type:string,coordinates:array<double>>"


def tweets(lines: DataFrame, column: str = "value") -> DataFrame:
    """The known fields of one JSON object a line; blank lines and notices of deletion are passed over."""
    kept = lines.where((F.trim(column) != "") & ~F.col(column).startswith('{"delete'))
    return kept.withColumn("tweet", F.from_json(column, TWEET)).where("tweet IS NOT NULL").select(*[c for c in lines.columns if c != column], "tweet.*")


def coordinates(t: DataFrame) -> DataFrame:
    """(latitude, longitude, ..) of tweets that have two coordinates."""
    return t.where("geo IS NOT NULL AND size(geo.coordinates) = 2").select(F.col("geo.coordinates")[0].alias("latitude"), F.col("geo.coordinates")[1].alias("longitude"), "text")


def xml_text(xml: Column, name: str) -> Column:
    """The texts of all elements of a name in an XML string."""
    return F.xpath(xml, F.lit(f"//{name}/text()"))


# --- data preparation and generation ---


def majority_votes(votes: DataFrame, key: str, label: str, n: str) -> DataFrame:
    """(key, label): the label that at least two thirds of a key's votes agree on; keys without one are left out. Equal counts go
    to the lower label."""
    best = votes.groupBy(key).agg(F.min_by(F.struct(label, n), F.struct(-F.col(n), F.col(label))).alias("b"), F.sum(n).alias("__all"))
    return best.where(F.col(f"b.{n}") * 3 >= F.col("__all") * 2).select(key, F.col(f"b.{label}").alias("label"))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with __rank, each row's place in the order from 0, and __all, the number of rows. Ranks come from counts by range bucket
    and a rank inside each bucket, so no task sees all rows."""
    from ..operators.stored import once

    ranged = once(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))  # both uses must see the same buckets
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    both = ranged.withColumn("__r", rank).join(F.broadcast(offsets), "__p")
    return both.withColumn("__rank", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def split_thirds(df: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """df with part: which of equal consecutive parts a row falls in."""
    return ranked(df, order).withColumn("part", F.floor(F.col("__rank") * parts / F.col("__all")).cast("int")).drop("__rank", "__all")


def generated_clusters(spark: SparkSession, n: int, means: list[tuple[float, float]] = ((-1, -1), (6, 4), (-2, 8)), sd: tuple[float, float] = (1.0, 1.0), seed: int = 0) -> DataFrame:
    """(id, gold, coord): normal samples round the means in turn, which the seed and the id fix (Box-Muller)."""
    from ..operators.counts import uniform01

    at = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in means]), (F.col("id") % len(means)).cast("int"))
    draw = lambda k: uniform01(F.lit(k), "id", seed=seed)
    radius, angle = F.sqrt(-2 * F.log(1 - draw(0))), draw(1) * (2 * math.pi)
    noise = (F.cos(angle) * radius * sd[0], F.sin(angle) * radius * sd[1])
    return spark.range(n).select("id", (F.col("id") % len(means)).cast("int").alias("gold"), F.array(at[0] + noise[0], at[1] + noise[1]).alias("coord"))
