"""Queries of counts, smoothing, distributions, n-grams and tag dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logprob import to_log
from ..operators import counts as C
from ..operators import keyed, ngram, tagdict
from .registry import query, table

#: Events as tagged tokens: the sequence is the user's, the tag the type, the symbol a bucket of the value.
TAGGED_SQL = "tagged AS (SELECT user_id AS seq_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS pos, 'b' || floor(value / 7)::INTEGER AS sym, event_type AS tag FROM events)"
NEXT_SQL = "nxt AS (SELECT event_type AS cond, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS item FROM events)"


def tagged(spark, sf) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    sym = F.concat(F.lit("b"), F.floor(F.col("value") / 7).cast("int").cast("string"))
    return table(spark, sf, "events").select(F.col("user_id").alias("seq_id"), pos.cast("long").alias("pos"), sym.alias("sym"), F.col("event_type").alias("tag"))


def next_types(spark, sf) -> DataFrame:
    return keyed.sliding_pairs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select(F.col("first").alias("cond"), F.col("second").alias("item"))


def listed(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


VALID = [("view",), ("click",), ("refund",)]
PAIRS = [("view", "click"), ("view", "purchase"), ("click", "view"), ("refund", "view")]
PAIRS_SQL = "v AS (SELECT * FROM (VALUES ('view', 'click'), ('view', 'purchase'), ('click', 'view'), ('refund', 'view')) AS t(cond, item))"


@query("""WITH c AS (SELECT event_type AS item, count(*)::DOUBLE AS cnt FROM events GROUP BY event_type), v AS (SELECT * FROM (VALUES ('view'), ('click'), ('refund')) AS t(i))
SELECT coalesce(item, i) AS item, CASE WHEN i IS NULL THEN 0.0::DOUBLE ELSE coalesce(cnt, 1.5::DOUBLE) END AS cnt FROM c FULL JOIN v ON item = i""")
def constrain_counts(spark, sf):
    c = C.Counts.of(table(spark, sf, "events"), "event_type", total_add=2.0, default_cnt=1.5)
    return C.constrain(listed(spark, VALID, "item string"))(c).df


@query("""WITH c AS (SELECT event_type AS item, count(*) + 0.5 AS cnt FROM events GROUP BY event_type)
SELECT item, round(cnt / (SELECT sum(cnt) + 0.5 FROM c), 8)::DOUBLE AS p FROM c UNION ALL SELECT '(other)', round(0.5 / (SELECT sum(cnt) + 0.5 FROM c), 8)::DOUBLE""")
def add_lambda_counts(spark, sf):
    p, d = C.freq_dist(C.add_lambda(0.5)(C.Counts.of(table(spark, sf, "events"), "event_type")))
    return p.unionByName(d.select(F.lit("(other)").alias("item"), F.col("default_p").alias("p"))).withColumn("p", F.round("p", 8))


@query(f"""WITH {NEXT_SQL}, {PAIRS_SQL}, c AS (SELECT cond, item, count(*)::DOUBLE AS cnt FROM nxt WHERE item IS NOT NULL GROUP BY cond, item),
i AS (SELECT item FROM c UNION SELECT item FROM v), k AS (SELECT DISTINCT cond FROM v)
SELECT k.cond, i.item, CASE WHEN v.cond IS NULL THEN 0.0 ELSE coalesce(c.cnt, 0.0) END::DOUBLE AS cnt FROM k CROSS JOIN i LEFT JOIN c ON c.cond = k.cond AND c.item = i.item LEFT JOIN v ON v.cond = k.cond AND v.item = i.item""")
def cond_constrain_zero(spark, sf):
    c = C.CondCounts.of(next_types(spark, sf), "cond", "item")
    return C.cond_constrain(listed(spark, PAIRS, "cond string, item string"))(c).cells


@query(f"""WITH {NEXT_SQL}, {PAIRS_SQL}, c AS (SELECT cond, item, count(*)::DOUBLE AS cnt FROM nxt WHERE item IS NOT NULL GROUP BY cond, item)
SELECT c.cond, c.item, CASE WHEN v.cond IS NULL AND c.item IN (SELECT item FROM v) THEN 0.0 ELSE cnt END::DOUBLE AS cnt FROM c LEFT JOIN v ON v.cond = c.cond AND v.item = c.item""")
def cond_constrain_keep(spark, sf):
    c = C.CondCounts.of(next_types(spark, sf), "cond", "item")
    return C.cond_constrain(listed(spark, PAIRS, "cond string, item string"), zero_defaults=False)(c).cells


SYM_CELLS = f"{TAGGED_SQL}, c AS (SELECT tag AS cond, sym AS item, count(*)::DOUBLE AS cnt FROM tagged GROUP BY tag, sym), grid AS (SELECT * FROM (SELECT DISTINCT cond FROM c) CROSS JOIN (SELECT DISTINCT item FROM c)), f AS (SELECT grid.cond, grid.item, coalesce(cnt, 0) AS cnt FROM grid LEFT JOIN c ON grid.cond = c.cond AND grid.item = c.item)"


@query(f"WITH {SYM_CELLS} SELECT cond, item, round((cnt + 0.1) / (sum(cnt + 0.1) OVER (PARTITION BY cond) + 0.1), 8)::DOUBLE AS p FROM f")
def add_lambda_cond(spark, sf):
    d = C.cond_dist(C.cond_add_lambda(0.1)(C.CondCounts.of(tagged(spark, sf), "tag", "sym")))
    return d.cells.withColumn("p", F.round("p", 8))


EISNER_SQL = f"""{SYM_CELLS}, b AS (SELECT item, (sum(cnt) + 1) / ((SELECT sum(cnt) FROM c) + (SELECT count(DISTINCT item) FROM c) + 1) AS pb FROM c GROUP BY item),
o AS (SELECT cond, 2.0 * (count(*) FILTER (cnt > 0.5 AND cnt < 1.5) + 1e-100) AS l, sum(cnt) AS n FROM c GROUP BY cond)"""


@query(f"WITH {EISNER_SQL} SELECT f.cond, f.item, round((f.cnt + l * pb) / (n + l), 8) AS p FROM f JOIN b ON f.item = b.item JOIN o ON o.cond = f.cond")
def eisner_cond(spark, sf):
    d = C.cond_dist(C.eisner(2.0, C.add_lambda(1.0))(C.CondCounts.of(tagged(spark, sf), "tag", "sym")))
    return d.cells.withColumn("p", F.round("p", 8))


@query(f"""WITH {EISNER_SQL}, w AS (SELECT cond, item FROM (SELECT DISTINCT tag AS cond FROM tagged UNION ALL SELECT 'unseen') CROSS JOIN (SELECT DISTINCT sym AS item FROM tagged UNION ALL SELECT 'never')),
t AS (SELECT sum(cnt) AS n, (SELECT count(DISTINCT item) FROM c) AS v FROM c), a AS (SELECT sum(l) AS l FROM o), i AS (SELECT item, sum(cnt) AS n FROM c GROUP BY item)
SELECT w.cond, w.item, round(CASE WHEN o.cond IS NOT NULL THEN (coalesce(c.cnt, 0) + o.l * (coalesce(i.n, 0) + 1) / (t.n + t.v + 1)) / (o.n + o.l)
  ELSE (coalesce(i.n, 0) + a.l * (coalesce(i.n, 0) + 1) / (t.n + t.v + 1)) / (t.n + a.l) END, 8) AS p
FROM w CROSS JOIN t CROSS JOIN a LEFT JOIN o ON w.cond = o.cond LEFT JOIN c ON w.cond = c.cond AND w.item = c.item LEFT JOIN i ON w.item = i.item""")
def backoff_lookup(spark, sf):
    t = tagged(spark, sf)
    conds = t.select(F.col("tag").alias("cond")).union(spark.range(1).select(F.lit("unseen"))).distinct()
    items = t.select(F.col("sym").alias("item")).union(spark.range(1).select(F.lit("never"))).distinct()
    return C.sparse_eisner(C.CondCounts.of(t, "tag", "sym"), conds.crossJoin(items), 2.0).withColumn("p", F.round("p", 8))


@query(f"WITH {NEXT_SQL}, c AS (SELECT cond, item, count(*) AS cnt FROM nxt WHERE item IS NOT NULL GROUP BY cond, item UNION ALL SELECT cond, 'idle', 3 FROM nxt GROUP BY cond) SELECT cond, item, sum(cnt)::DOUBLE AS cnt FROM c GROUP BY cond, item")
def cond_counts_merge(spark, sf):
    n = next_types(spark, sf)
    idle = C.CondCounts.plain(table(spark, sf, "events").select(F.col("event_type").alias("cond"), F.lit("idle").alias("item"), F.lit(3.0).alias("cnt")).distinct())
    return C.CondCounts.of(n, "cond", "item").merge(idle).cells


DRAW = lambda seed, *key: f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 13))::BIGINT"


@query(f"""WITH {NEXT_SQL}, c AS (SELECT cond, item, count(*)::DOUBLE AS cnt FROM nxt WHERE item IS NOT NULL GROUP BY cond, item), g AS (SELECT k.cond, i.item FROM (SELECT DISTINCT cond FROM c) AS k CROSS JOIN (SELECT DISTINCT item FROM c) AS i)
SELECT g.cond, g.item, coalesce(cnt, 0) + {DRAW(0, "g.cond", "g.item")} % 6 AS cnt FROM g LEFT JOIN c ON g.cond = c.cond AND g.item = c.item""")
def random_cond_counts(spark, sf):
    return C.cond_random(5)(C.CondCounts.of(next_types(spark, sf), "cond", "item")).cells


# --- n-grams ---

TURN_SQL = "w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS sym, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM conversations)"
GRAM_SQL = f"{TURN_SQL}, e AS (SELECT conv_id, turn, sym, pos FROM w UNION ALL SELECT conv_id, turn, NULL, max(pos) + 1 FROM w GROUP BY conv_id, turn), g AS (SELECT conv_id, turn, pos, coalesce(lag(sym, 2) OVER d, '<s>') AS a, coalesce(lag(sym, 1) OVER d, '<s>') AS b, coalesce(sym, '</s>') AS c FROM e WINDOW d AS (PARTITION BY conv_id, turn ORDER BY pos))"


def turns(spark, sf) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    return table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("seq_id"), F.posexplode(words).alias("pos", "sym"))


def _named(d: DataFrame) -> DataFrame:
    mark = lambda c, s: F.coalesce(c, F.lit(s))
    return d.select(mark(F.col("cond.w2"), "<s>").alias("w2"), mark(F.col("cond.w1"), "<s>").alias("w1"), mark(F.col("item"), "</s>").alias("word"), F.round("p", 8).alias("p"))


@query(f"WITH {GRAM_SQL} SELECT a AS w2, b AS w1, c AS word, round(count(*) / sum(count(*)) OVER (PARTITION BY a, b), 8) AS p FROM g GROUP BY a, b, c")
def ngram_mle(spark, sf):
    return _named(ngram.train(turns(spark, sf), 3).dist.cells)


@query(f"""WITH {GRAM_SQL}, u AS (SELECT b, c, count(*) AS n FROM g GROUP BY b, c), i AS (SELECT c, sum(n) AS n FROM u GROUP BY c), t AS (SELECT sum(n) AS n, count(*) AS v FROM i), o AS (SELECT b, sum(n) AS n, 1.0 * (count(*) FILTER (n = 1) + 1e-100) AS l FROM u GROUP BY b)
SELECT u.b AS w1, u.c AS word, round((u.n + o.l * (i.n + 1) / (t.n + t.v + 1)) / (o.n + o.l), 8) AS p FROM u JOIN i ON u.c = i.c JOIN o ON u.b = o.b CROSS JOIN t""")
def ngram_smoothed(spark, sf):
    """One-count smoothed bigrams of the seen pairs, by joins only."""
    g = ngram.ngrams(turns(spark, sf), 2)
    c = C.CondCounts.of(g, "cond", "item")
    p = C.sparse_eisner(c, c.cells.select("cond", "item"), 1.0)
    return p.select(F.coalesce("cond.w1", F.lit("<s>")).alias("w1"), F.coalesce("item", F.lit("</s>")).alias("word"), F.round("p", 8).alias("p"))


@query("""WITH s AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, user_id, event_type AS sym FROM events), e AS (SELECT * FROM s UNION ALL SELECT max(pos) + 1, user_id, NULL FROM s GROUP BY user_id),
g AS (SELECT coalesce(lag(sym) OVER (PARTITION BY user_id ORDER BY pos), '<s>') AS b, coalesce(sym, '</s>') AS c FROM e), n AS (SELECT b, c, count(*) AS n FROM g GROUP BY b, c), f AS (SELECT k.b, i.c, coalesce(n.n, 0) + 0.5 AS n FROM (SELECT DISTINCT b FROM n) AS k CROSS JOIN (SELECT DISTINCT c FROM n) AS i LEFT JOIN n ON n.b = k.b AND n.c = i.c)
SELECT b AS w1, c AS word, round(n / (sum(n) OVER (PARTITION BY b) + 0.5), 8)::DOUBLE AS p FROM f""")
def ngram_add_lambda(spark, sf):
    seqs = tagged(spark, sf).select("seq_id", "pos", F.col("tag").alias("sym"))
    d = ngram.train(seqs, 2, C.cond_add_lambda(0.5)).dist.cells
    return d.select(F.coalesce("cond.w1", F.lit("<s>")).alias("w1"), F.coalesce("item", F.lit("</s>")).alias("word"), F.round("p", 8).alias("p"))


@query(f"WITH {GRAM_SQL}, p AS (SELECT a, b, c, count(*) / sum(count(*)) OVER (PARTITION BY a, b) AS p FROM g GROUP BY a, b, c) SELECT conv_id, turn, round(sum(ln(p)), 6) AS logp FROM g JOIN p USING (a, b, c) GROUP BY conv_id, turn")
def ngram_sentence_logprob(spark, sf):
    t = turns(spark, sf)
    return ngram.train(t, 3).score(t).select("seq_id.conv_id", "seq_id.turn", F.round("logp", 6).alias("logp"))


@query()
def ngram_generate(spark, sf):
    m = ngram.train(turns(spark, sf), 2)
    return spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(m.generate(20, 30, 7))], "id int, text string")


@query(f"""WITH p AS (SELECT event_type AS item, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type),
b AS (SELECT item, sum(p) OVER w - p AS lo, sum(p) OVER w AS hi, row_number() OVER (ORDER BY p, item DESC) AS last FROM p WINDOW w AS (ORDER BY p DESC, item ROWS UNBOUNDED PRECEDING)),
u AS (SELECT event_id, {DRAW(3, "event_id")} / 4503599627370496.0::DOUBLE AS u FROM events) SELECT event_id, item FROM u JOIN b ON u >= lo AND (u < hi OR last = 1)""")
def sample_multinomial(spark, sf):
    e = table(spark, sf, "events")
    p, _ = C.freq_dist(C.Counts.of(e, "event_type"))
    return C.sample(p, e.select("event_id"), "event_id", 3).select("event_id", "item")


@query(f"SELECT event_id, CASE WHEN {DRAW(5, 'event_id')} / 4503599627370496.0::DOUBLE < 0.25 THEN 'heads' ELSE 'tails' END AS item FROM events")
def sample_binomial(spark, sf):
    return C.binomial(table(spark, sf, "events").select("event_id"), "event_id", "heads", "tails", 0.25, 5)


@query()
def sample_dirichlet(spark, sf):
    rows = {r["event_type"]: r["count"] for r in table(spark, sf, "events").groupBy("event_type").count().collect()}
    return spark.createDataFrame([(i, k, v) for i, d in enumerate(C.dirichlet(rows, 5, 1)) for k, v in d.items()], "draw int, label string, p double")


@query(f"WITH {GRAM_SQL}, p AS (SELECT a, b, c, count(*) / sum(count(*)) OVER (PARTITION BY a, b) AS p FROM g GROUP BY a, b, c), r AS (SELECT g.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS i FROM g) SELECT conv_id, turn, round(sum(ln(p)), 6) AS logp FROM r JOIN p USING (a, b, c) WHERE i >= 3 AND c <> '</s>' GROUP BY conv_id, turn")
def ngram_seq_logprob(spark, sf):
    """Without boundaries: the n-grams inside a sequence only."""
    t = turns(spark, sf)
    return ngram.train(t, 3).score(t, pad=False).select("seq_id.conv_id", "seq_id.turn", F.round("logp", 6).alias("logp"))


@query("SELECT unnest(['a', 'b', '(other)']) AS item, unnest([0.0, 0.0, 0.0])::DOUBLE AS p")
def freq_dist_empty(spark, sf):
    """A distribution of no counts gives 0 to everything; constraining it to two items leaves these."""
    none = C.Counts(table(spark, sf, "events").where("false").select(F.col("event_type").alias("item"), F.lit(1.0).alias("cnt")))
    p, d = C.freq_dist(C.constrain(listed(spark, [("a",), ("b",)], "item string"))(none))
    return p.unionByName(d.select(F.lit("(other)").alias("item"), F.col("default_p").alias("p")))


# --- tag dictionaries ---


@query(f"WITH {TAGGED_SQL} SELECT DISTINCT sym, tag FROM tagged")
def tagdict_simple(spark, sf):
    return tagdict.simple(tagged(spark, sf)).pairs.select("sym", "tag")


@query(f"""WITH {TAGGED_SQL}, c AS (SELECT sym, tag, count(*) AS n FROM tagged GROUP BY sym, tag), f AS (SELECT s.sym, t.tag, coalesce(n, 0) + 1 AS n FROM (SELECT DISTINCT sym FROM c) AS s CROSS JOIN (SELECT DISTINCT tag FROM c) AS t LEFT JOIN c ON c.sym = s.sym AND c.tag = t.tag)
SELECT sym, tag, round(n / (sum(n) OVER (PARTITION BY sym) + 1), 8) AS weight FROM f""")
def tagdict_weighted(spark, sf):
    return tagdict.weighted(tagged(spark, sf), C.cond_add_lambda(1.0)).pairs.withColumn("weight", F.round("weight", 8))


@query(f"WITH {TAGGED_SQL} SELECT sym, tag FROM tagged GROUP BY sym, tag ORDER BY count(*) DESC, sym, tag LIMIT 20")
def tagdict_top_pairs(spark, sf):
    return tagdict.top_pairs(tagged(spark, sf), 20).pairs.select("sym", "tag")


@query(f"WITH {TAGGED_SQL} SELECT DISTINCT sym, tag FROM tagged WHERE sym IN (SELECT sym FROM tagged GROUP BY sym ORDER BY count(*) DESC, sym LIMIT 4)")
def tagdict_top_syms(spark, sf):
    return tagdict.top_symbols(tagged(spark, sf), 4).pairs.select("sym", "tag")


@query(f"WITH {TAGGED_SQL}, n AS (SELECT tag FROM tagged GROUP BY tag ORDER BY count(DISTINCT sym) DESC, tag LIMIT 2), w AS (SELECT DISTINCT sym FROM tagged UNION ALL SELECT 'unknown') SELECT DISTINCT w.sym, t.tag FROM w JOIN tagged AS t ON w.sym = t.sym UNION ALL SELECT 'unknown', tag FROM n")
def tagdict_default_limit(spark, sf):
    t = tagged(spark, sf)
    wanted = t.select("sym").distinct().union(spark.range(1).select(F.lit("unknown")))
    return tagdict.limit_defaults(tagdict.simple(t), 2).lookup(wanted).select("sym", "tag")


@query(f"WITH {TAGGED_SQL} SELECT tag, round(ln(count(*)::DOUBLE / sum(count(*)) OVER ()), 6) AS logp FROM tagged GROUP BY tag")
def log_distribution(spark, sf):
    p, _ = C.freq_dist(C.Counts.of(tagged(spark, sf), "tag"))
    return p.select(F.col("item").alias("tag"), F.round(to_log(F.col("p")), 6).alias("logp"))
