"""Queries of array and map forms, of plain numbers against logarithms, and of draws by hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logprob as L
from ..functions import text as X
from ..operators import keyed
from .keyed_queries import WORDS
from .registry import query, table

#: The words of a document, as an array.
LIST_SQL = f"(SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)"


def words(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w"))


@query(f"SELECT doc_id, w[1] AS a, w[2] AS b, w[3] AS c FROM {LIST_SQL} WHERE len(w) >= 3")
def to_tuple(spark, sf):
    d = words(spark, sf).where("size(w) >= 3").select("doc_id", keyed.to_tuple(F.slice("w", 1, 3), 3).alias("t"))
    return d.select("doc_id", F.col("t._1").alias("a"), F.col("t._2").alias("b"), F.col("t._3").alias("c"))


@query(f"SELECT doc_id, array_to_string(['first'] || w || ['last'], ' ') AS t FROM {LIST_SQL}")
def prepend_append(spark, sf):
    both = keyed.append(keyed.prepend(F.lit("first"), F.col("w")), F.lit("last"))
    return words(spark, sf).select("doc_id", F.array_join(both, " ").alias("t"))


@query(f"SELECT doc_id, (len(w) + 2)::INTEGER AS n, array_to_string(list_transform([NULL] || w || [NULL], lambda x: coalesce(x, '#')), ' ') AS t FROM {LIST_SQL}")
def ended(spark, sf):
    e = keyed.ended(F.col("w"))
    return words(spark, sf).select("doc_id", F.size(e).alias("n"), F.array_join(e, " ", "#").alias("t"))


@query("SELECT conv_id, turn, len(string_split(rtrim(s, '|'), '|'))::INTEGER AS n, string_split(rtrim(s, '|'), '|')[1] AS first FROM (SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[.]'), lambda x: CASE WHEN x = '.' THEN '|' ELSE x || ' ' END), '') AS s FROM conversations) WHERE rtrim(s, '|') <> ''")
def array_split(spark, sf):
    """The words between full stops: empty chunks at the end don't count, others do."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([A-Za-z]+|[.])")).alias("w"))
    c = t.select("conv_id", "turn", keyed.array_split(F.col("w"), lambda x: x == ".").alias("c")).where("size(c) > 0")
    return c.select("conv_id", "turn", F.size("c").alias("n"), F.array_join(F.transform(F.element_at("c", 1), lambda x: F.concat(x, F.lit(" "))), "").alias("first"))


@query(f"SELECT doc_id, array_to_string(w, ' ') AS a, array_to_string(list_transform(w, lambda x: len(x)), ' ') AS b FROM {LIST_SQL}")
def unzip(spark, sf):
    pairs = words(spark, sf).select("doc_id", F.transform("w", lambda x: F.struct(x.alias("a"), F.length(x).alias("b"))).alias("p"))
    u = pairs.select("doc_id", keyed.unzip(F.col("p")).alias("u"))
    return u.select("doc_id", F.array_join("u.a", " ").alias("a"), F.array_join(F.transform("u.b", lambda x: x.cast("string")), " ").alias("b"))


@query("SELECT o_custkey, upper(o_orderstatus) || '!' AS k, count(*) * 10 AS v FROM orders GROUP BY o_custkey, o_orderstatus")
def map_keys_values(spark, sf):
    """Counts as a map, with its keys and values changed."""
    m = keyed.to_map(keyed.counts(table(spark, sf, "orders"), "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "cnt")
    m = m.withColumn("map", keyed.map_values(keyed.map_keys(F.col("map"), lambda k: F.concat(F.upper(k), F.lit("!"))), lambda v: v * 10))
    return m.select("o_custkey", F.explode("map").alias("k", "v"))


@query(f"SELECT doc_id, unnest(list_transform(w, lambda x: x || '=' || len(x) || '/1')) AS t FROM {LIST_SQL}")
def map_to(spark, sf):
    """Each item with a function of it, and with a constant."""
    p = keyed.map_to_value(keyed.map_to(F.col("w"), F.length), F.lit(1))
    t = F.transform(p, lambda x: F.concat(x["_1"]["_1"], F.lit("="), x["_1"]["_2"].cast("string"), F.lit("/"), x["_2"].cast("string")))
    return words(spark, sf).select("doc_id", F.explode(t).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS total FROM lineitem")
def map_tuples(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("t"))
    mapped = keyed.map_tuples(F.col("t"), ["l_linenumber", "l_partkey", "l_suppkey"], lambda n, p, s: F.struct(n.alias("n"), (p + s).alias("total")))
    return d.select("l_orderkey", F.explode(mapped).alias("x")).select("l_orderkey", F.col("x.n").alias("l_linenumber"), "x.total")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS place FROM documents")
def shuffle(spark, sf):
    """Every row's place in an order that a seed fixes."""
    return keyed.shuffled_places(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "place")


@query("SELECT n_nationkey, n_regionkey IN (1, 3) AS listed, true AS anything FROM nation")
def universal_set(spark, sf):
    r = F.col("n_regionkey")
    return table(spark, sf, "nation").select("n_nationkey", keyed.member(r, [1, 3]).alias("listed"), keyed.member(r, None).alias("anything"))


@query("SELECT l_orderkey, l_linenumber, ascii(l_returnflag) * 2 AS x FROM lineitem")
def memo_map(spark, sf):
    """A function that is evaluated once for each distinct value."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return keyed.memoized(d, "l_returnflag", lambda c: F.ascii(c) * 2, "x").select("l_orderkey", "l_linenumber", F.col("x").cast("long").alias("x"))


# --- logarithms against plain numbers ---


@query("SELECT o_orderkey, sign(o_totalprice - 150000)::INTEGER AS sign, o_totalprice > 150000 AS more, round(greatest(o_totalprice, 150000), 2) AS top, round(least(o_totalprice, 150000), 2) AS low FROM orders")
def log_compare(spark, sf):
    a = L.to_log(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", L.compare(a, 150_000).alias("sign"), (L.compare(a, 150_000) > 0).alias("more"), F.round(L.from_log(L.log_max(a, 150_000)), 2).alias("top"), F.round(L.from_log(L.log_min(a, 150_000)), 2).alias("low"))


@query("SELECT o_orderkey, round(o_totalprice + 5, 2) AS plus, round(1e7 - o_totalprice, 2) AS minus, round(o_totalprice * 2, 2) AS times, round(o_totalprice * 8, 1) AS over, round(sqrt(o_totalprice), 4) AS root FROM orders")
def log_mixed(spark, sf):
    """Logarithms and plain numbers in one expression, on either side."""
    a = L.to_log(F.col("o_totalprice"))
    out = lambda x, n=2: F.round(L.from_log(x), n)
    return table(spark, sf, "orders").select("o_orderkey", out(L.plus(a, 5)).alias("plus"), out(L.minus(1e7, a)).alias("minus"), out(L.times(2, a)).alias("times"), out(L.over(a, 0.125), 1).alias("over"), out(L.log_pow(a, 0.5), 4).alias("root"))


@query("SELECT event_type, round(sum(value), 4) AS total, 0.0::DOUBLE AS none, 1.0::DOUBLE AS one FROM events GROUP BY event_type")
def log_zero_one(spark, sf):
    """Sums from the zero on and products with the one change nothing."""
    e = table(spark, sf, "events").select("event_type", L.log_mul(L.log_add(L.to_log(F.col("value")), F.lit(L.ZERO)), F.lit(L.ONE)).alias("v"))
    return L.log_sum(e, ["event_type"], "v").select("event_type", F.round(F.exp("log_sum"), 4).alias("total"), F.exp(F.lit(L.ZERO)).alias("none"), F.exp(F.lit(L.ONE)).alias("one"))


@query("SELECT user_id, round(sum(value) * 2 - 1, 4) AS total FROM events GROUP BY user_id")
def accumulate(spark, sf):
    """What a mutable number would go through, as one fold over an ordered array: added to, then doubled and lessened."""
    g = keyed.group_by_key(table(spark, sf, "events").withColumn("value", F.col("value").cast("double")), "user_id", "value", ["ts", "event_id"])
    return g.select("user_id", F.round(keyed.accumulate(F.col("values"), 0.0, lambda a, x: a + x) * 2 - 1, 4).alias("total"))


# --- numbers and families in strings ---


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::INTEGER END AS i, CASE WHEN doc_id % 3 = 1 THEN doc_id + 0.5 END::DOUBLE AS d FROM documents")
def number_patterns(spark, sf):
    k = F.col("doc_id")
    s = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", X.parse_int(F.col("s")).alias("i"), F.when(F.col("s").contains("."), X.parse_double(F.col("s"))).alias("d"))


@query(r"SELECT page_id, (len(regexp_extract_all(html, '&(?:quot|amp|gt|lt);')))::INTEGER AS entities, (len(regexp_extract_all(html, '-{2,}|―')))::INTEGER AS separators FROM pages")
def family_counts(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.count_family(h, "entity").alias("entities"), X.count_family(h, "separator").alias("separators"))
