"""Queries of the keyed algebra and of log-space sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.logprob import approx, from_log, log_add, log_sub, log_sum, to_log
from ..operators import keyed
from .registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def tokens(docs):
    """Rows of docs with each lower-case ASCII word."""
    return docs.select("*", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("tok"))


@query(f"SELECT lang, tok, count(*) AS cnt FROM (SELECT lang, unnest({WORDS}) AS tok FROM documents) GROUP BY lang, tok")
def token_counts(spark, sf):
    t = tokens(table(spark, sf, "documents").select("lang", "text"))
    return keyed.counts(t, "lang", "tok")


@query(f"SELECT lang, tok, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 8) AS share FROM (SELECT lang, unnest({WORDS}) AS tok FROM documents) GROUP BY lang, tok")
def relative_freq(spark, sf):
    c = keyed.counts(tokens(table(spark, sf, "documents").select("lang", "text")), "lang", "tok")
    return keyed.normalize(c, ["lang"], "cnt").select("lang", "tok", F.round("share", 8).alias("share"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def group_by_key(spark, sf):
    g = keyed.group_by_key(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], out="types")
    return g.select("user_id", F.array_join("types", ">").alias("path"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def group_by_key_set(spark, sf):
    g = keyed.group_by_key(table(spark, sf, "events"), "user_id", "event_type", distinct=True, out="types")
    return g.select("user_id", F.array_join("types", ",").alias("types"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, event_type FROM events")
def ungroup(spark, sf):
    g = keyed.group_by_key(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], out="types")
    return keyed.ungroup(g, "user_id", "types", "event_type")


@query(f"SELECT tok, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS tok FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) GROUP BY tok")
def merge_sum_by_key(spark, sf):
    parts = [keyed.counts(tokens(table(spark, sf, t).select("text")), "tok") for t in ("documents", "benchmark")]
    return keyed.merge_sum(parts, ["tok"], "cnt")


@query("SELECT user_id, string_agg(kind, ',' ORDER BY src, ts, event_id) AS kinds FROM (SELECT user_id, event_type AS kind, ts, event_id, 0 AS src FROM events WHERE value < 20 UNION ALL SELECT user_id, event_type, ts, event_id, 1 FROM events WHERE value >= 20) GROUP BY user_id")
def merge_lists_by_key(spark, sf):
    e = table(spark, sf, "events")
    parts = [keyed.group_by_key(e.where(c), "user_id", "event_type", ["ts", "event_id"]) for c in ("value < 20", "value >= 20")]
    return keyed.merge_lists(parts, "user_id", "values").select("user_id", F.array_join("values", ",").alias("kinds"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def sum_by(spark, sf):
    d = table(spark, sf, "lineitem")
    return keyed.sum_by(d, ["l_returnflag", "l_linestatus"], F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue").withColumn("revenue", F.round("revenue", 2))


@query("SELECT l_returnflag, round(avg(l_linenumber), 8) AS mean FROM lineitem GROUP BY l_returnflag")
def avg_int(spark, sf):
    return keyed.average(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber").withColumn("mean", F.round("mean", 8))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0), 8) AS share FROM lineitem")
def normalize(spark, sf):
    d = keyed.normalize(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_quantity")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("share", 8).alias("share"))


@query("SELECT a AS first, b AS second, count(*) AS cnt FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b")
def sliding_pairs(spark, sf):
    return keyed.counts(keyed.sliding_pairs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type"), "first", "second")


@query("SELECT user_id, chunk::BIGINT AS chunk, count(*) AS size FROM (SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chunk FROM events) WHERE event_type <> 'error' GROUP BY user_id, chunk")
def split_where(spark, sf):
    d = keyed.split_where(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return d.groupBy("user_id", "chunk").agg(F.count("*").alias("size"))


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS asked FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) AS answered FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.k, a.k)::INTEGER AS k, asked::INTEGER AS asked, answered::INTEGER AS answered FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.k = a.k""")
def zip_safe_positional(spark, sf):
    """Questions and answers side by side; where one side is longer, its rows have nulls (the strict form is an error there)."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", k.alias("k"), F.length("text").alias(name))
    return keyed.zip_strict(side("user", "asked"), side("assistant", "answered"), ["conv_id"], "k", check=False)


@query("""SELECT e.user_id, e.k::INTEGER AS k, e.event_type, e.value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) AS e""")
def zip_strict(spark, sf):
    """Types and values of the same events, zipped strictly."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return keyed.zip_strict(e.select("user_id", k.alias("k"), "event_type"), e.select("user_id", k.alias("k"), "value"), ["user_id"], "k")


@query("SELECT source, doc_id, running::BIGINT AS running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000")
def take_sub_budget(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return keyed.take_sub(d, ["source"], ["doc_id"], "n_chars", 50_000).select("source", "doc_id", "running")


@query("SELECT o_custkey, sign(count(*) FILTER (o_totalprice > 150000) - 5)::INTEGER AS sign FROM orders GROUP BY o_custkey")
def count_compare(spark, sf):
    return keyed.count_compare(table(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice") > 150_000, 5)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, max(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM events) WHERE k = 1")
def drop_right_while(spark, sf):
    return keyed.drop_right_while(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view").select("user_id", "event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3 AS first_part FROM events")
def split_at(spark, sf):
    return keyed.split_at(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "first_part")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 6 AND (r - 1) % 2 = 0")
def history_lag(spark, sf):
    return keyed.history(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 6, 1).select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderkey AS v FROM orders), g AS (SELECT *, v - row_number() OVER (PARTITION BY o_custkey ORDER BY v) AS g FROM d),
r AS (SELECT o_custkey, min(v) AS lo, max(v) AS hi FROM g GROUP BY o_custkey, g)
SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM r GROUP BY o_custkey""")
def range_islands(spark, sf):
    return keyed.range_string(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


@query("SELECT n_nationkey, v::INTEGER AS v FROM (SELECT n_nationkey, unnest([n_nationkey, n_nationkey + 2, n_nationkey + 3, n_nationkey + 4] || range(n_nationkey + 8, 41)) AS v FROM nation)")
def range_parse(spark, sf):
    n = F.col("n_nationkey")
    text = F.concat(n.cast("string"), F.lit(", "), (n + 2).cast("string"), F.lit("-"), (n + 4).cast("string"), F.lit(","), (n + 8).cast("string"), F.lit("-"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(keyed.parse_range(text, 40)).alias("v"))


@query(f"SELECT tok, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS tok FROM documents) WHERE tok NOT IN (SELECT unnest({WORDS}) FROM benchmark) GROUP BY tok")
def item_drop_antijoin(spark, sf):
    from ..operators.counts import Counts, drop_items

    docs = Counts.of(tokens(table(spark, sf, "documents").select("text")), "tok")
    gone = tokens(table(spark, sf, "benchmark").select("text")).select(F.col("tok").alias("item"))
    return drop_items(gone)(docs).df.select(F.col("item").alias("tok"), F.col("cnt").cast("long").alias("cnt"))


@query("SELECT event_type, round(ln(sum(value)), 6) AS log_sum FROM events WHERE value > 0 GROUP BY event_type")
def log_add_reduce(spark, sf):
    e = table(spark, sf, "events").where("value > 0").select("event_type", to_log(F.col("value")).alias("lv"))
    return log_sum(e, ["event_type"], "lv").withColumn("log_sum", F.round("log_sum", 6))


@query("""SELECT o_orderkey, round(a + b, 4) AS total, round(abs(a - b), 4) AS gap, round(a * b, 2) AS product, a = b AS same
FROM (SELECT o_orderkey, o_totalprice AS a, 1000.0 + o_custkey AS b FROM orders)""")
def log_arithmetic(spark, sf):
    a, b = to_log(F.col("o_totalprice")), to_log(F.lit(1000.0) + F.col("o_custkey"))
    hi, lo = F.greatest(a, b), F.least(a, b)
    return table(spark, sf, "orders").select("o_orderkey", F.round(from_log(log_add(a, b)), 4).alias("total"), F.round(from_log(log_sub(hi, lo)), 4).alias("gap"), F.round(from_log(a + b), 2).alias("product"), approx(a, b, 1e-15).alias("same"))
