"""Queries of sequence tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import hmm, tagdict
from ..operators.stored import once
from .count_queries import TAGGED_SQL, tagged
from .keyed_queries import tokens
from .registry import query, table

def named(d, value="cnt"):
    edge = F.lit("(edge)")
    return d.select(F.coalesce("cond", edge).alias("cond"), F.coalesce("item", edge).alias("item"), value)


@query(f"""WITH {TAGGED_SQL}, e AS (SELECT seq_id, pos, tag FROM tagged UNION ALL SELECT seq_id, -1, '(edge)' FROM tagged GROUP BY seq_id UNION ALL SELECT seq_id, max(pos) + 1, '(edge)' FROM tagged GROUP BY seq_id),
n AS (SELECT tag AS cond, lead(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS item FROM e) SELECT cond, item, count(*)::DOUBLE AS cnt FROM n WHERE item IS NOT NULL GROUP BY cond, item""")
def hmm_transition_counts(spark, sf):
    return named(hmm.fix_transitions()(hmm.transition_counts(tagged(spark, sf))).cells)


@query(f"WITH {TAGGED_SQL} SELECT tag AS cond, sym AS item, count(*)::DOUBLE AS cnt FROM tagged GROUP BY tag, sym UNION ALL SELECT '(edge)', '(edge)', 1.0")
def hmm_emission_counts(spark, sf):
    return named(hmm.fix_emissions()(hmm.emission_counts(tagged(spark, sf))).cells)


@query("""WITH t AS (SELECT DISTINCT event_type AS x FROM events UNION ALL SELECT '(edge)'), p AS (SELECT a.x AS cond, b.x AS item FROM t AS a CROSS JOIN t AS b WHERE a.x <> '(edge)' OR b.x <> '(edge)')
SELECT cond, item, round(1.0::DOUBLE / count(*) OVER (PARTITION BY cond), 8) AS p FROM p""")
def hmm_uniform_transitions(spark, sf):
    return named(hmm.uniform_transitions(tagged(spark, sf).select("tag")), "p").withColumn("p", F.round("p", 8))


@query(f"""WITH {TAGGED_SQL}, d AS (SELECT DISTINCT sym, tag FROM tagged WHERE sym IN (SELECT sym FROM tagged GROUP BY sym ORDER BY count(*) DESC, sym LIMIT 20)), n AS (SELECT sym, count(*)::DOUBLE AS n FROM tagged GROUP BY sym), k AS (SELECT sym, count(*) AS k FROM d GROUP BY sym),
known AS (SELECT d.tag, d.sym, coalesce(n.n, 0) / k.k AS cnt FROM d JOIN k USING (sym) LEFT JOIN n USING (sym)), m AS (SELECT tag, sum(cnt) AS m, count(*)::DOUBLE ** 2 AS q FROM known GROUP BY tag),
p AS (SELECT tag, m / (SELECT sum(m) FROM m) * q / (SELECT sum(q) FROM m) AS x FROM m), s AS (SELECT tag, x / (SELECT sum(x) FROM p) AS share FROM p)
SELECT tag AS cond, sym AS item, round(cnt, 6) AS cnt FROM known UNION ALL SELECT s.tag, n.sym, round(n.n * share, 6) FROM s CROSS JOIN n WHERE n.sym NOT IN (SELECT sym FROM d) UNION ALL SELECT '(edge)', '(edge)', 1.0""")
def unsup_emission_est(spark, sf):
    t = tagged(spark, sf)
    return named(hmm.estimated_emissions(t, tagdict.top_symbols(t, 20)).cells).withColumn("cnt", F.round("cnt", 6))


def _smooth(then=C.passthrough):
    return C.cond_add_lambda(1.0, then)


_EDGED = f"{TAGGED_SQL}, tags AS (SELECT DISTINCT tag FROM tagged), e AS (SELECT seq_id, pos, tag FROM tagged UNION ALL SELECT seq_id, -1, '(edge)' FROM tagged GROUP BY seq_id UNION ALL SELECT seq_id, max(pos) + 1, '(edge)' FROM tagged GROUP BY seq_id), n AS (SELECT a, b, count(*) AS n FROM (SELECT tag AS a, lead(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM e) WHERE b IS NOT NULL GROUP BY a, b), ends AS (SELECT tag FROM tags UNION ALL SELECT '(edge)'), ec AS (SELECT tag, sym, count(*) AS n FROM tagged GROUP BY tag, sym)"
#: From tables tr (a, b, lp) and em (tag, sym, lp) of logarithms: the best paths, position by position.
_DECODE = """v AS (SELECT t.seq_id, t.pos, em.tag, tr.lp + em.lp AS score, [em.tag] AS path FROM tagged AS t JOIN em ON em.sym = t.sym JOIN tr ON tr.a = '(edge)' AND tr.b = em.tag WHERE t.pos = 0
UNION ALL SELECT seq_id, pos, tag, score, list_append(path, tag) FROM (SELECT t.seq_id, t.pos, em.tag, arg_min(v.score + tr.lp, (-round(v.score + tr.lp, 9), v.tag)) + any_value(em.lp) AS score, arg_min(v.path, (-round(v.score + tr.lp, 9), v.tag)) AS path FROM v JOIN tagged AS t ON t.seq_id = v.seq_id AND t.pos = v.pos + 1 JOIN em ON em.sym = t.sym JOIN tr ON tr.a = v.tag AND tr.b = em.tag GROUP BY t.seq_id, t.pos, em.tag)),
l AS (SELECT seq_id, max(pos) AS pos FROM tagged GROUP BY seq_id), f AS (SELECT v.seq_id, arg_min(v.path, (-round(v.score + tr.lp, 9), v.tag)) AS path FROM v JOIN l ON v.seq_id = l.seq_id AND v.pos = l.pos JOIN tr ON tr.a = v.tag AND tr.b = '(edge)' GROUP BY v.seq_id)
SELECT t.seq_id, t.pos, t.sym, f.path[t.pos + 1] AS tag FROM tagged AS t JOIN f ON f.seq_id = t.seq_id"""
#: Add-one smoothing of both tables.
VITERBI_SQL = f"""WITH RECURSIVE {_EDGED}, g AS (SELECT x.tag AS a, y.tag AS b, coalesce(n.n, 0) + 1 AS c FROM ends AS x CROSS JOIN ends AS y LEFT JOIN n ON n.a = x.tag AND n.b = y.tag WHERE x.tag <> '(edge)' OR y.tag <> '(edge)'), tr AS (SELECT a, b, ln(c / (sum(c) OVER (PARTITION BY a) + 1)) AS lp FROM g),
em AS (SELECT t.tag, s.sym, ln((coalesce(ec.n, 0) + 1) / (k.n + (SELECT count(DISTINCT sym) FROM tagged) + 1)) AS lp FROM tags AS t CROSS JOIN (SELECT DISTINCT sym FROM tagged) AS s JOIN (SELECT tag, count(*) AS n FROM tagged GROUP BY tag) AS k ON k.tag = t.tag LEFT JOIN ec ON ec.tag = t.tag AND ec.sym = s.sym),
{_DECODE}"""
#: One-count smoothing of both tables with add-one backoff; only seen pairs of symbol and tag.
CONSTRAINED_SQL = f"""WITH RECURSIVE {_EDGED}, tb AS (SELECT b, (sum(n) + 1) / ((SELECT sum(n) FROM n) + (SELECT count(DISTINCT b) FROM n) + 1) AS pb FROM n GROUP BY b), tl AS (SELECT a, count(*) FILTER (n = 1) + 1e-100::DOUBLE AS l, sum(n) AS have FROM n GROUP BY a),
tr AS (SELECT tl.a, tb.b, ln((coalesce(n.n, 0) + l * pb) / (have + l - CASE WHEN tl.a = '(edge)' THEN l * (SELECT pb FROM tb WHERE b = '(edge)') ELSE 0 END)) AS lp FROM tl CROSS JOIN tb LEFT JOIN n ON n.a = tl.a AND n.b = tb.b WHERE tl.a <> '(edge)' OR tb.b <> '(edge)'),
q AS (SELECT (SELECT count(*) FROM tagged) + 2 * (SELECT count(DISTINCT seq_id) FROM tagged) + (SELECT count(DISTINCT sym) FROM tagged) + 2 AS all_n), eb AS (SELECT sym, (count(*) + 1)::DOUBLE / (SELECT all_n FROM q) AS pb FROM tagged GROUP BY sym), el AS (SELECT tag, count(*) FILTER (n = 1) + 1e-100::DOUBLE AS l FROM ec GROUP BY tag),
ex AS (SELECT ec.tag, ec.sym, ec.n + el.l * eb.pb AS x, el.l / (SELECT all_n FROM q) AS more FROM ec JOIN el ON el.tag = ec.tag JOIN eb ON eb.sym = ec.sym), em AS (SELECT tag, sym, ln(x / (sum(x) OVER (PARTITION BY tag) + more)) AS lp FROM ex),
{_DECODE}"""


@query(VITERBI_SQL)
def viterbi_tag(spark, sf):
    t = tagged(spark, sf)
    return hmm.tag(t.select("seq_id", "pos", "sym"), hmm.train_supervised(t, _smooth(), _smooth()))


@query(CONSTRAINED_SQL)
def viterbi_tag_constrained(spark, sf):
    t = tagged(spark, sf)
    d = tagdict.simple(t)
    m = hmm.train_supervised(t, C.eisner(1.0, C.add_lambda(1.0)), hmm.license_emissions(d, C.eisner(1.0, C.add_lambda(1.0))), d)
    return hmm.tag(t.select("seq_id", "pos", "sym"), m)


SCORE_SQL = f"""WITH {TAGGED_SQL}, top AS (SELECT sym FROM tagged GROUP BY sym ORDER BY count(*) DESC, sym LIMIT 20), c AS (SELECT sym, tag, count(*) AS n FROM tagged WHERE sym IN (SELECT sym FROM top) GROUP BY sym, tag), b AS (SELECT sym, tag FROM (SELECT sym, tag, row_number() OVER (PARTITION BY sym ORDER BY n DESC, tag) AS r FROM c) WHERE r = 1),
o AS (SELECT t.tag = coalesce(b.tag, 'view') AS ok, b.sym IS NOT NULL AS known FROM tagged AS t LEFT JOIN b ON t.sym = b.sym)
SELECT count(*) FILTER (ok) AS correct, count(*) AS total, count(*) FILTER (ok AND known) AS known_correct, count(*) FILTER (known) AS known_total, count(*) FILTER (ok AND NOT known) AS unknown_correct, count(*) FILTER (NOT known) AS unknown_total FROM o"""


@query(SCORE_SQL)
def tagger_score(spark, sf):
    """Most frequent tag of each of the 20 most frequent symbols, scored on all."""
    from pyspark.sql import Window

    t = tagged(spark, sf)
    d = tagdict.top_symbols(t, 20)
    train = t.join(d.symbols(), "sym", "left_semi")
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("count"), "tag"))
    best = train.groupBy("sym", "tag").count().withColumn("__r", rank).where("__r = 1").select("sym", "tag")
    out = hmm.rule_tag(t.drop("tag"), best, [], "view")
    return hmm.score(out, t, d)


@query(f"""WITH {TAGGED_SQL}, b AS (SELECT sym, tag FROM (SELECT sym, tag, row_number() OVER (PARTITION BY sym ORDER BY count(*) DESC, tag) AS r FROM tagged GROUP BY sym, tag) WHERE r = 1)
SELECT t.tag AS gold, b.tag AS output, count(*) AS n FROM tagged AS t JOIN b ON t.sym = b.sym WHERE t.tag <> b.tag GROUP BY t.tag, b.tag ORDER BY n DESC, gold, output LIMIT 5""")
def tagger_mistakes(spark, sf):
    from pyspark.sql import Window

    t = tagged(spark, sf)
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("count"), "tag"))
    best = t.groupBy("sym", "tag").count().withColumn("__r", rank).where("__r = 1").select("sym", "tag")
    return hmm.mistakes(hmm.baseline_tag(t.drop("tag"), best), t)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM documents)
SELECT tag, count(*) AS cnt FROM (SELECT CASE WHEN tok IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'every', 'each', 'no', 'some', 'any') THEN 'D' WHEN regexp_full_match(tok, '.*ing') THEN 'G' WHEN regexp_full_match(tok, '.*(ed|en)') THEN 'E' ELSE 'N' END AS tag FROM w) GROUP BY tag""")
def rule_tag(spark, sf):
    w = tokens(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("tok").alias("sym"))
    exact = hmm.closed_class(spark).where("tag = 'D'")
    return hmm.rule_tag(w, exact, [(".*ing", "G"), (".*(ed|en)", "E")], "N").groupBy("tag").agg(F.count("*").alias("cnt"))


@query(f"WITH {TAGGED_SQL}, b AS (SELECT sym, min(tag) AS tag FROM tagged GROUP BY sym) SELECT seq_id, pos, t.sym, b.tag FROM tagged AS t JOIN b ON t.sym = b.sym")
def baseline_tag(spark, sf):
    t = tagged(spark, sf)
    return hmm.baseline_tag(t.select("seq_id", "pos", "sym"), t.groupBy("sym").agg(F.min("tag").alias("tag"))).select("seq_id", "pos", "sym", "tag")


@query()
def em_train(spark, sf):
    """Type-supervised: raw events and a dictionary of the 20 most frequent symbols; the tags that the model gives."""
    t = once(tagged(spark, sf))
    m = hmm.train_type_supervised(t.select("seq_id", "pos", "sym"), tagdict.top_symbols(t, 20), _smooth(), _smooth(), iterations=3)
    return hmm.tag(t.select("seq_id", "pos", "sym"), m)


@query()
def em_semisupervised(spark, sf):
    """All events as raw tokens, and the first ten of each user as gold."""
    t = once(tagged(spark, sf))
    m = hmm.train_type_supervised(t.select("seq_id", "pos", "sym"), tagdict.simple(t), _smooth(), _smooth(), iterations=2, gold=t.where("pos < 10"))
    return hmm.tag(t.select("seq_id", "pos", "sym"), m)


@query(f"WITH {TAGGED_SQL}, d AS (SELECT DISTINCT sym, tag FROM tagged WHERE sym IN (SELECT sym FROM tagged GROUP BY sym ORDER BY count(*) DESC, sym LIMIT 20)) SELECT t.seq_id, t.pos, t.sym, d.tag FROM tagged AS t JOIN d ON d.sym = t.sym UNION ALL SELECT t.seq_id, t.pos, t.sym, g.tag FROM tagged AS t CROSS JOIN (SELECT DISTINCT tag FROM tagged) AS g WHERE t.sym NOT IN (SELECT sym FROM d)")
def tag_options(spark, sf):
    """Raw tokens with the tags that a dictionary allows them."""
    t = tagged(spark, sf)
    return tagdict.top_symbols(t, 20).lookup(t.select("seq_id", "pos", "sym")).select("seq_id", "pos", "sym", "tag")


SIMPLE_SQL = f"""WITH {TAGGED_SQL}, e AS (SELECT seq_id, pos, tag FROM tagged UNION ALL SELECT seq_id, -1, '(edge)' FROM tagged GROUP BY seq_id UNION ALL SELECT seq_id, max(pos) + 1, '(edge)' FROM tagged GROUP BY seq_id),
c AS (SELECT a, b, count(*) AS n FROM (SELECT tag AS a, lead(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM e) WHERE b IS NOT NULL GROUP BY a, b), u AS (SELECT b, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY b), r AS (SELECT a, sum(n) AS have, count(*) FILTER (n = 1) + 2.0 AS l FROM c GROUP BY a)"""


@query(f"{SIMPLE_SQL} SELECT r.a AS cond, u.b AS item, round((coalesce(c.n, 0) + r.l * u.share) / (r.have + r.l), 8)::DOUBLE AS p FROM r CROSS JOIN u LEFT JOIN c ON c.a = r.a AND c.b = u.b")
def hmm_simple_transitions(spark, sf):
    return named(hmm.simple_transitions(tagged(spark, sf), 2.0), "p").withColumn("p", F.round("p", 8))


@query(f"""WITH {TAGGED_SQL}, w AS (SELECT sym, count(*) + 1 AS n FROM tagged GROUP BY sym), t AS (SELECT (SELECT sum(n) FROM w) + (SELECT count(DISTINCT seq_id) FROM tagged) + 2 AS total), c AS (SELECT tag, sym, count(*) AS n FROM tagged GROUP BY tag, sym), o AS (SELECT tag, count(*) FILTER (n = 1) + 2.0 AS l FROM c GROUP BY tag),
x AS (SELECT c.tag, c.sym, c.n + o.l * w.n / t.total AS x, o.l / t.total AS other FROM c JOIN o ON c.tag = o.tag JOIN w ON w.sym = c.sym CROSS JOIN t), s AS (SELECT tag, sum(x) + 2.0 AS s, any_value(other) AS other FROM x GROUP BY tag)
SELECT x.tag AS cond, x.sym AS item, round(x / s.s, 8)::DOUBLE AS p FROM x JOIN s ON x.tag = s.tag UNION ALL SELECT tag, '(other)', round(other / s, 8)::DOUBLE FROM s""")
def hmm_simple_emissions(spark, sf):
    cells, other = hmm.simple_emissions(tagged(spark, sf), 2.0)
    both = cells.unionByName(other.select("cond", F.lit("(other)").alias("item"), F.col("default_p").alias("p")))
    return both.withColumn("p", F.round("p", 8))


@query()
def hmm_simple_tag(spark, sf):
    t = tagged(spark, sf)
    return hmm.tag(t.select("seq_id", "pos", "sym"), hmm.train_simple(t, 2.0))


@query(f"WITH {TAGGED_SQL} SELECT seq_id, pos, sym, CASE WHEN length(sym) = 2 THEN 'short' ELSE 'long' END AS tag FROM tagged")
def viterbi_any_score(spark, sf):
    """A score that names the length of a symbol, and none for moves."""
    t = tagged(spark, sf).select("seq_id", "pos", "sym")
    return hmm.decode_any(t, ["long", "short"], lambda before, a, sym, b: 0.0 if sym is None else float((len(sym) == 2) == (b == "short")))
