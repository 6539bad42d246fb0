"""Operator 7, quality rules: a ledger of failure bits.

Every rule is evaluated once, with native expressions only; the ledger keeps the measurements and one bit for each failed
rule. It is stored. A policy is a version number and the mask of rules that reject; applying one, or finding what each rule alone
rejects, is bitwise arithmetic over the stored ledger, without another look at a text.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, table
from .kernels import WORD_RE

#: Name, measurement and condition of failure of each rule; the place is the bit.
RULES = (
    ("no_words", "n_words < 1"),
    ("symbols", "symbol_ratio > 0.05"),
    ("exclamations", "exclamation_ratio > 0.2"),
    ("pipes", "pipe_ratio > 0.2"),
    ("capitals", "capital_ratio > 0.4"),
    ("stutter", "n_words >= 10 AND stutter_ratio > 0.3"),
    ("repeated_lines", "n_lines >= 4 AND repeated_line_ratio > 0.3"),
    ("long_words", "mean_word_length > 20"),
    ("digits", "digit_ratio > 0.3"),
    ("few_words", "n_words < 5"),
    ("low_diversity", "n_words >= 50 AND distinct_word_ratio < 0.15"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: The rules that reject, by version of the policy. Version 2 adds what also catches short and monotonous, but clean, texts.
POLICIES = {1: sum(BIT[r] for r in BIT if r not in ("few_words", "low_diversity")), 2: sum(BIT.values())}
CURRENT = 1
MEASURES = ("n_words", "n_lines", "symbol_ratio", "exclamation_ratio", "pipe_ratio", "capital_ratio", "digit_ratio", "mean_word_length", "distinct_word_ratio", "stutter_ratio", "repeated_line_ratio")
_BLANK = r"[ \t\n\x0B\f\r]+"


def _measured(docs: DataFrame, text: Column, words: str, lines: str) -> dict[str, Column]:
    """The measurements, from columns that hold the text's words and lines."""
    w, ln = F.col(words), F.col(lines)
    chars = F.length(text)
    part = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    without = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    pairs = F.greatest(F.size(w) - 1, F.lit(0))
    again = F.size(F.filter(F.zip_with(F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: a == b), lambda x: x))
    n = F.size(w)
    return {
        "n_words": n,
        "n_lines": F.size(ln),
        "symbol_ratio": part(without("[#$%&*]+"), chars),
        "exclamation_ratio": part(chars - F.length(F.replace(text, F.lit("!"), F.lit(""))), n),
        "pipe_ratio": part(chars - F.length(F.replace(text, F.lit("|"), F.lit(""))), n),
        "capital_ratio": part(without("[A-Z]+"), chars),
        "digit_ratio": part(without("[0-9]+"), chars),
        "mean_word_length": part(chars - F.length(F.regexp_replace(text, WORD_RE, "")), n),
        "distinct_word_ratio": part(F.size(F.array_distinct(w)), n),
        "stutter_ratio": part(again, pairs),
        "repeated_line_ratio": part(F.size(ln) - F.size(F.array_distinct(ln)), F.size(ln)),
    }


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs, the measurements, and fail_bits: bit i is set if rule i fails.

    A null text counts as empty: it fails no_words (and few_words) only. Each row is measured alone, so repeated rows get equal
    results, ties can't arise, and an empty table gives an empty ledger. Ratios over nothing are 0. Columns of docs that aren't
    kept are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select(*keep, text.alias("__text"), F.filter(F.split(text, _BLANK), lambda x: x != "").alias("__words"), F.split(text, "\n").alias("__lines"))
    m = _measured(split, F.col("__text"), "__words", "__lines")
    rows = split.select(*keep, *[(c if c_name.startswith("n_") else F.round(c, 6)).alias(c_name) for c_name, c in m.items()])
    bits = [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total)


def _state(spark, path: str) -> str:
    """A digest of the rules and of the names, sizes and times of change of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, seen = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr((RULES, MEASURES, path, sorted(seen))).encode()).hexdigest()[:32]


def stored(spark, sf_dir: str, anew: bool = False, folder: str | None = None) -> DataFrame:
    """The ledger of the documents table by doc_id, read from where it is stored; if it isn't, or `anew`, it is evaluated and written first.

    Ledgers are in `folder`, or else in the shared folder, which is this application's own. One is used again only for the same
    rules and the same files, told by name, size and time of change; one whose writing didn't end isn't used. None is overwritten.
    """
    home = f"{folder or shared_folder(spark)}/ledger-{_state(spark, f'{sf_dir}/documents.parquet')}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/*/_SUCCESS")
    found = None if anew else done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    if found:
        path = found[0].getPath().getParent().toString()
    else:
        path = f"{home}/{uuid.uuid4().hex}"
        ledger(table(spark, sf_dir, "documents"), "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def rejects(mask: int) -> Column:
    """Whether a policy's mask rejects a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def ablations(led: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows that fail the rule, rows rejected by it alone (kept if it were dropped), and
    rows that the policy rejects and sees. The ledger is first counted by fail_bits, so what follows is tiny."""
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    cells = [
        F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), total(hit(BIT[name]) != 0).alias("n_fail"), total(hit(mask) == BIT[name]).alias("n_only"), total(hit(mask) != 0).alias("n_rejected"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"))
        for v, mask in POLICIES.items()
        for name in BIT
        if BIT[name] & mask
    ]
    return counts.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the current policy rejects; every other column and row is untouched.

    The bits pass through a generator: a filter right above the ledger would be pushed below it, with every rule written out again
    wherever a measurement is used."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("text"))
    once = ledger(row, "__row").select("__row", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return once.where(~rejects(POLICIES[CURRENT])).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """The ledger, evaluated and stored anew, and whether each policy keeps a row, by the stored bits."""
    return stored(spark, sf_dir, anew=True).withColumns({f"keep_v{v}": ~rejects(m) for v, m in POLICIES.items()})


def ablation_query(spark, sf_dir: str) -> DataFrame:
    return ablations(stored(spark, sf_dir))


_LEDGER_SQL = r"""
s AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
q AS (SELECT doc_id, len(w)::INTEGER AS n_words, len(ls)::INTEGER AS n_lines, length(x) AS c,
  length(x) - length(regexp_replace(x, '[#$%&*]+', '', 'g')) AS sy, length(x) - length(replace(x, '!', '')) AS ex, length(x) - length(replace(x, '|', '')) AS pi,
  length(x) - length(regexp_replace(x, '[A-Z]+', '', 'g')) AS ca, length(x) - length(regexp_replace(x, '[0-9]+', '', 'g')) AS dg,
  length(x) - length(regexp_replace(x, '[^ \t\n\v\f\r]+', '', 'g')) AS wc, len(list_distinct(w)) AS dw,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS ad, len(ls) - len(list_distinct(ls)) AS rl FROM s),
m AS (SELECT doc_id, n_words, n_lines, round(CASE WHEN c > 0 THEN sy / c ELSE 0 END, 6)::DOUBLE AS symbol_ratio, round(CASE WHEN n_words > 0 THEN ex / n_words ELSE 0 END, 6)::DOUBLE AS exclamation_ratio,
  round(CASE WHEN n_words > 0 THEN pi / n_words ELSE 0 END, 6)::DOUBLE AS pipe_ratio, round(CASE WHEN c > 0 THEN ca / c ELSE 0 END, 6)::DOUBLE AS capital_ratio,
  round(CASE WHEN c > 0 THEN dg / c ELSE 0 END, 6)::DOUBLE AS digit_ratio, round(CASE WHEN n_words > 0 THEN wc / n_words ELSE 0 END, 6)::DOUBLE AS mean_word_length,
  round(CASE WHEN n_words > 0 THEN dw / n_words ELSE 0 END, 6)::DOUBLE AS distinct_word_ratio, round(CASE WHEN n_words > 1 THEN ad / (n_words - 1) ELSE 0 END, 6)::DOUBLE AS stutter_ratio,
  round(rl / n_lines, 6)::DOUBLE AS repeated_line_ratio FROM q),
ledger AS (SELECT *, (""" + " | ".join(f"CASE WHEN {cond} THEN {BIT[name]} ELSE 0 END" for name, cond in RULES) + """)::INTEGER AS fail_bits FROM m)
"""
SQL = "WITH " + _LEDGER_SQL + "SELECT *, " + ", ".join(f"(fail_bits & {m}) = 0 AS keep_v{v}" for v, m in POLICIES.items()) + " FROM ledger"
ABLATION_SQL = "WITH " + _LEDGER_SQL + " UNION ALL ".join(
    f"SELECT {v}::INTEGER AS policy, '{name}' AS rule, count(*) FILTER (WHERE fail_bits & {bit} <> 0)::BIGINT AS n_fail, count(*) FILTER (WHERE fail_bits & {m} = {bit})::BIGINT AS n_only, "
    f"count(*) FILTER (WHERE fail_bits & {m} <> 0)::BIGINT AS n_rejected, count(*)::BIGINT AS n_rows FROM ledger"
    for v, m in POLICIES.items()
    for name, bit in BIT.items()
    if bit & m
)
