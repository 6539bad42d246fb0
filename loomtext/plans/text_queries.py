"""Queries of text functions, trees, grammar, and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate, ccg
from ..sources import corpora
from .keyed_queries import WORDS, tokens
from .registry import query, table

LEXICON = [
    "zel := np", "mip := np", "tov := n", "the := np/n", "big := n/n", "runs := s\\np", "sees := (s\\np)/np", "very := (n/n)/(n/n)", "and := (np\\np)/np", "near := (n\\n)/np",
]


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '([?!()\";|\[\].,''])', ' \1 ', 'g')), '\s+'), lambda x: x <> ''))::INTEGER AS n, list_filter(regexp_split_to_array(trim(regexp_replace(text, '([?!()\";|\[\].,''])', ' \1 ', 'g')), '\s+'), lambda x: x <> '')[-1] AS last FROM conversations")
def simple_tokenize(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.simple_tokenize(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query()
def twokenize(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.social_tokenize_to_string(F.col("text")).alias("tokens"))


@query()
def treebank_tokenize(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.treebank_tokenize(F.col("text")).alias("tokens"))


@query()
def porter_stem(spark, sf):
    t = tokens(table(spark, sf, "documents").select("text")).groupBy("tok").agg(F.count("*").alias("cnt"))
    return X.with_stems(t, "tok").groupBy("stem").agg(F.sum("cnt").alias("cnt"))


@query("SELECT page_id, replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM pages")
def entity_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normalize_entities(F.col("html")).alias("t"))


@query("SELECT doc_id, regexp_replace(text || '  ', '\\s+$', '') AS t FROM documents")
def rtrim_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.rtrim(F.concat("text", F.lit("  "))).alias("t"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_POSITIVE = ", ".join(f"'{w}'" for w in X.POSITIVE_WORDS)


@query(f"SELECT tok, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS tok FROM documents) WHERE tok NOT IN ({_STOP}) GROUP BY tok")
def stopword_filter(spark, sf):
    t = tokens(table(spark, sf, "documents").select("text")).groupBy("tok").agg(F.count("*").alias("cnt"))
    return X.without_words(t, "tok", X.lexicon(spark, X.STOP_WORDS)).select("tok", "cnt")


@query(f"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest({WORDS}) AS tok FROM documents) WHERE tok IN ({_POSITIVE}) GROUP BY doc_id")
def lexicon_hits(spark, sf):
    t = tokens(table(spark, sf, "documents").select("doc_id", "text"))
    return X.only_words(t, "tok", X.lexicon(spark, X.POSITIVE_WORDS)).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("SELECT event_id, '{\"k\":' || ((props->>'$.k')::INTEGER + 1) || '}' AS props FROM events")
def json_roundtrip(spark, sf):
    k = F.from_json("props", "k int").getField("k")
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct((k + 1).alias("k"))).alias("props"))


@query("SELECT p_partkey, p_name AS name FROM part")
def xml_names(spark, sf):
    """Texts of the elements of a name in XML that is made from the part names."""
    safe = F.replace(F.col("p_name"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<r><o>x</o><name>"), safe, F.lit("</name></r>"))
    return table(spark, sf, "part").select("p_partkey", F.element_at(corpora.xml_text(xml, "name"), 1).alias("name"))


@query("SELECT event_id, value AS latitude, value / 2 AS longitude FROM events WHERE event_type <> 'error' AND event_type <> 'view'")
def tweet_coordinates(spark, sf):
    """Tweets made from events: errors become notices of deletion, views have no place."""
    e = table(spark, sf, "events")
    geo = F.when(F.col("event_type") != "view", F.struct(F.lit("Point").alias("type"), F.array("value", F.col("value") / 2).alias("coordinates")))
    line = F.when(F.col("event_type") == "error", F.lit('{"delete":{}}')).otherwise(F.to_json(F.struct(F.col("event_type").alias("text"), F.lit(False).alias("retweeted"), F.lit("now").alias("created_at"), geo.alias("geo"))))
    t = corpora.tweets(e.select("event_id", line.alias("value")))
    return t.where("size(geo.coordinates) = 2").select("event_id", F.col("geo.coordinates")[0].alias("latitude"), F.col("geo.coordinates")[1].alias("longitude"))


@query()
def ccg_parse(spark, sf):
    """A small grammar over sentences that are made from the nations: each picks its words by number."""
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.col("n_nationkey") + k, F.lit(len(words))).cast("int"))
    s = F.concat_ws(" ", pick(["the big tov", "zel", "mip", "the very big tov near mip"], 0), pick(["sees", "runs"], 1), pick(["mip", "the tov", ""], 2))
    d = table(spark, sf, "nation").select("n_nationkey", F.trim(s).alias("sentence"))
    return ccg.parse_sentences(d, "n_nationkey", "sentence", LEXICON, "all").select("n_nationkey", F.array_join("categories", ";").alias("categories"), "error")


@query()
def english_pipeline(spark, sf):
    d = annotate.Pipeline().run(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", "sent", F.size("tokens").alias("n_tokens"), F.array_join("tags", " ").alias("tags"), F.size("chunks").alias("n_chunks"), F.size("persons").alias("n_persons"))


_CLUSTER_DRAW = lambda k: f"('0x' || substr(md5('4:{k}:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH i AS (SELECT range AS id FROM range((SELECT count(*) FROM embeddings))), d AS (SELECT id, (id % 3)::INTEGER AS gold, sqrt(-2 * ln(1 - {_CLUSTER_DRAW(0)})) AS r, {_CLUSTER_DRAW(1)} * 2 * pi() AS a FROM i)
SELECT id, gold, round([-1, 6, -2][gold + 1] + r * cos(a), 6) AS x, round([-1, 4, 8][gold + 1] + r * sin(a), 6) AS y FROM d""")
def generated_clusters(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return corpora.generated_clusters(spark, n, seed=4).select("id", "gold", F.round(F.col("coord")[0], 6).alias("x"), F.round(F.col("coord")[1], 6).alias("y"))
