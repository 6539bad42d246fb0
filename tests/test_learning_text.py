"""Classifiers, clustering, text functions, trees, grammar, sources and streaming on small data with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions import vectors
from loomtext.functions.porter import stem
from loomtext.operators import annotate, ccg, cluster, hmm, maxent, naive_bayes, perceptron, trees
from loomtext.sources import corpora
from loomtext.streaming import counters

TENNIS = """Sunny,Hot,High,Weak,No Sunny,Hot,High,Strong,No Overcast,Hot,High,Weak,Yes Rain,Mild,High,Weak,Yes Rain,Cool,Normal,Weak,Yes Rain,Cool,Normal,Strong,No
Overcast,Cool,Normal,Strong,Yes Sunny,Mild,High,Weak,No Sunny,Cool,Normal,Weak,Yes Rain,Mild,Normal,Weak,Yes Sunny,Mild,Normal,Strong,Yes Overcast,Mild,High,Strong,Yes
Overcast,Hot,Normal,Weak,Yes Rain,Mild,High,Strong,No""".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def tennis(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(TENNIS)], "path string, line_no int, value string")
    named = corpora.attribute_values(corpora.csv_instances(lines), ["Outlook", "Temp", "Humidity", "Wind"])
    return corpora.long_features(named)


def test_naive_bayes(spark, tennis):
    m = naive_bayes.Trainer.of(tennis).model()
    assert {r.label: r.prior for r in m.prior.collect()} == pytest.approx({"Yes": 9 / 14, "No": 5 / 14})
    p = {(r.label, r.feature): r.p for r in m.likelihood().collect()}
    assert p["Yes", "Outlook=Overcast"] == pytest.approx(4 / 36) and p["No", "Humidity=High"] == pytest.approx(4 / 20) and ("No", "Outlook=Overcast") not in p
    docs = tennis.select("doc_id", "feature")
    plain, smooth = m.classify(docs), naive_bayes.Trainer.of(tennis).model(1.0).classify(docs)
    for scores in (plain, smooth):
        sums = scores.groupBy("doc_id").agg(F.sum(F.exp("logp")).alias("s")).collect()
        assert all(r.s == pytest.approx(1) for r in sums)
    assert {r.doc_id: r.logp for r in plain.where("label = 'No'").collect()}[2] == -math.inf
    unknown = spark.createDataFrame([(1, "never")], "doc_id long, feature string")
    assert {math.exp(r.logp) for r in m.classify(unknown).collect()} == {0.5}
    gold = tennis.select("doc_id", "label").distinct()
    r = naive_bayes.evaluate(naive_bayes.best_label(smooth), gold).first()
    assert r.total == 14 and r.correct >= 12


def test_gibbs_learns_from_few_labels(spark):
    words = {"x": ["sun", "beach", "sea"], "y": ["snow", "ski", "ice"]}
    rng = np.random.default_rng(0)
    rows = [(i, k, str(w)) for i in range(40) for k in ["xy"[i % 2]] for w in rng.choice(words[k], 8)]
    d = spark.createDataFrame(rows, "doc_id long, label string, feature string")
    got = {r.doc_id: r.label for r in naive_bayes.gibbs(d.where("doc_id >= 6").select("doc_id", "feature"), d.where("doc_id < 6"), ["x", "y"], 2, 4).collect()}
    assert np.mean([v == "xy"[k % 2] for k, v in got.items()]) > 0.95 and len(got) == 34


@pytest.mark.parametrize("kind", ["binary", "pa", "pa_multi", "pa_shared", "cost_multi", "cost_shared"])
@pytest.mark.parametrize("variant", [0, 1, 2])
def test_perceptrons_separate(kind, variant):
    rng = np.random.default_rng(1)
    classes = 2 if kind in ("binary", "pa") else 3
    ys = [int(y) for y in rng.integers(0, classes, 60)]
    xs = [np.array([0, 1 + y, 5 + int(rng.integers(0, 4))]) for y in ys]
    m = perceptron.Learner(kind, classes, 9, variant=variant).fit(xs, ys, 200)
    assert [m.predict(x) for x in xs] == ys


def test_perceptron_tables(spark, tennis):
    v = perceptron.interned(tennis, "feature")
    data = perceptron.instances(tennis, v, perceptron.interned(tennis, "label", 0)).cache()
    gold = {r.id: r.label for r in data.collect()}
    w = perceptron.train(data, 2, v.count() + 1, "pa", most=300)
    assert {r.id: r["class"] for r in perceptron.classify(data, w, 2, binary=True).collect()} == gold
    mixed = perceptron.train_mixed(data, 2, v.count() + 1, 3, "pa_multi", epochs=20)
    got = {r.id: r["class"] for r in perceptron.classify(data, mixed, 2).collect()}
    assert np.mean([got[k] == gold[k] for k in gold]) > 0.7
    assert perceptron.update_factor(1.0, 0.0, 0, 20) == 0 and perceptron.update_factor(1, 2, 1, 0.1) == 0.1 and perceptron.update_factor(1, 2, 2, 1) == pytest.approx(1 / 2.5)


def square(x, y):
    return [(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)]


def test_kmeans(spark):
    pts = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(square(0, 0) + square(8, 8) + square(0, 8))]
    p = spark.createDataFrame(pts, "id int, coord array<double>")
    disp, centroids = cluster.kmeans(p, 3, restarts=5)
    assert disp == pytest.approx(6.0) and sorted(map(tuple, centroids)) == [(0.5, 0.5), (0.5, 8.5), (8.5, 8.5)]
    a = cluster.assign(p, centroids)
    assert cluster.dispersion(a) == pytest.approx(6.0) and sorted(map(tuple, cluster.means(a))) == sorted(map(tuple, centroids))
    for kind in ("manhattan", "cosine"):
        shifted = p.withColumn("coord", F.transform("coord", lambda x: x + 1))
        step = cluster.lloyd_step(shifted, [np.array([[1.5, 1.5], [1.5, 9.5]])], kind)[0]
        assert step[0] == pytest.approx(cluster.dispersion(cluster.assign(shifted, [[1.5, 1.5], [1.5, 9.5]], kind)))
    assert cluster.kmeans(p.limit(0), 3) == (0.0, [])


def test_scaling_and_components(spark):
    p = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i + (i % 2)]) for i in range(10)], "id int, coord array<double>")
    x = np.array([r.coord for r in cluster.zscore(p).orderBy("id").collect()])
    assert x.mean(0) == pytest.approx([0, 0, 0]) and x.std(0) == pytest.approx([1, 0, 1])
    y = np.array([r.coord for r in cluster.zscore(p, "reference").orderBy("id").collect()])
    assert (y**2).sum(0) == pytest.approx([1, 0, 1])
    moved, kept = cluster.pca(p)
    assert kept.shape[1] == 1 and len(moved.first().coord) == 1
    with pytest.raises(ValueError):
        cluster.transform("nothing", p)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(9.0))
    assert one(spark, vectors.norm(a)) == 5 and one(spark, vectors.dot(a, b)) == 4 and one(spark, vectors.manhattan(a, b)) == 6
    assert one(spark, vectors.euclidean(a, b)) == pytest.approx(math.sqrt(18)) and one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vectors.with_intercept(a)) == [3, 4, 1] and one(spark, vectors.divide(a, 2.0)) == [1.5, 2] and one(spark, vectors.absolute(vectors.scale(a, -1))) == [3, 4]
    with pytest.raises(ValueError):
        vectors.distance("other")


STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "electrical": "electr", "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is", "generalizations": "gener", "oscillators": "oscil"}


def test_lines_of_many_blocks(spark, tmp_path):
    """Numbers of lines don't depend on how a file is cut."""
    want = [f"line {i} " + "x" * (i % 50) for i in range(20_000)] + ["", "  last "]
    for name, text in (("a.txt", "\n".join(want) + "\n"), ("b.txt", "\r\n".join(want)), ("c.txt", "")):
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("50000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = corpora.read_lines(spark, str(tmp_path)).withColumn("name", corpora.base_name(F.col("path"))).collect()
            for name in ("a.txt", "b.txt"):
                assert [r.value for r in sorted((r for r in got if r.name == name), key=lambda r: r.line_no)] == want
            assert len(got) == 2 * len(want) and {r.line_no for r in got} == set(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_helpers(spark):
    top = corpora.temporary_folder()
    inner = corpora.make_folder(corpora.join_path(top, "a", "b"))
    for name in ("x.txt", "y"):
        with open(corpora.join_path(inner, name), "w") as f:
            f.write("1")
    assert corpora.find_files(top) == [f"{inner}/x.txt", f"{inner}/y"] and corpora.make_folder(inner) == inner
    assert corpora.remove(f"{inner}/y") and not corpora.remove(f"{inner}/y") and corpora.find_files(top) == [f"{inner}/x.txt"]
    assert corpora.remove(top) and corpora.find_files(top) == []
    for name, want in (("a/b.tok.tree", "a/b.tok"), ("a.b/c", "a.b/c"), ("x", "x"), (".hidden", ".hidden")):
        assert one(spark, corpora.strip_extension(F.lit(name))) == want


def test_values_are_numbered_in_order(spark):
    words = sorted({f"{a}{i}" for a in ("", "a", "ab", "abc", "é", "z") for i in range(40)} | {""})
    got = perceptron.interned(spark.createDataFrame([(w,) for w in words * 2], "w string"), "w").collect()
    assert {r.value: r.number for r in got} == {w: i for i, w in enumerate(sorted(words, key=str.encode), 1)}


def test_logistic_regression(spark):
    rows = [(i, ["x", "y", "z"][i % 3], [f"f{i % 3}", f"n{i % 7}"]) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, label string, features array<string>")
    out = {r.doc_id: r.output for r in maxent.apply(d.drop("label"), maxent.train(d, iterations=30)).collect()}
    assert out == {i: k for i, k, _ in rows}
    unknown = spark.createDataFrame([(1, ["never"]), (2, [])], "doc_id long, features array<string>")
    assert all(r.output in "xyz" for r in maxent.apply(unknown, maxent.train(d, iterations=5)).collect())


def test_simple_tagger_against_loops(spark):
    import math
    from collections import Counter

    sents = [[("a", "D"), ("b", "N"), ("c", "V")], [("b", "N"), ("c", "V")], [("a", "D"), ("b", "N")], [("d", "N")]]
    t = spark.createDataFrame([(i, j, w, k) for i, s in enumerate(sents) for j, (w, k) in enumerate(s)], "seq_id long, pos long, sym string, tag string")
    pairs, tags, n = Counter(), Counter(), 0
    for s in sents:
        line = [None, *(k for _, k in s), None]
        pairs.update(zip(line, line[1:]))
        tags.update(line[1:])
    n, lam = sum(tags.values()), 0.5
    for r in hmm.simple_transitions(t, lam).collect():
        row = {b: c for (a, b), c in pairs.items() if a == r.cond}
        weight = lam + sum(c == 1 for c in row.values())
        assert math.isclose(r.p, (row.get(r.item, 0) + weight * tags[r.item] / n) / (sum(row.values()) + weight))
    tagged = {r.sym: r.tag for r in hmm.tag(t.select("seq_id", "pos", "sym"), hmm.train_simple(t, lam)).collect()}
    assert tagged == {"a": "D", "b": "N", "c": "V", "d": "N"}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS and stem(None) is None and stem("") == ""
    d = spark.createDataFrame([("running",), ("running",), (None,)], "w string")
    assert [r.stem for r in X.with_stems(d, "w").orderBy("w").collect()] == [None, "run", "run"]


def test_tokenizers(spark):
    assert one(spark, X.simple_tokenize(F.lit("Well, (he said) it's \"fine\"!"))) == ["Well", ",", "(", "he", "said", ")", "it", "'", "s", '"', "fine", '"', "!"]
    social = lambda s: one(spark, X.social_tokenize(F.lit(s)))
    assert social("hello (#hashtag) :) see http://a.com/x?y=1, ok") == ["hello", "(", "#hashtag", ")", ":)", "see", "http://a.com/x?y=1", ",", "ok"]
    assert social("don't  stop @ 12:30 w/ $1.50... <3") == ["don't", "stop", "@", "12:30", "w/", "$", "1.50", "...", "<3"]
    assert social("mail me@example.org (@you)") == ["mail", "me@example.org", "(", "@you", ")"]
    assert social("") == [] and one(spark, X.social_tokenize(F.lit(None).cast("string"))) is None
    assert one(spark, X.normalize_entities(F.lit("a &lt; b &amp;gt;"))) == "a < b &gt;"
    assert social("\"So,\" she said: see www.b.org/c (or b.org), :-( at U.S. Mr. X's e-mail -- 1,000 AT&T &amp; ♫♫ ok?!") == [
        '"', "So", ",", '"', "she", "said", ":", "see", "www.b.org/c", "(", "or", "b.org", ")", ",", ":-(", "at", "U.S.", "Mr.", "X's", "e-mail", "--", "1,000", "AT&T", "&amp;", "♫♫", "ok", "?!"
    ]
    assert social("x -> y <- z => v1.5 note:please (: D: >> a*b*") == ["x", "->", "y", "<-", "z", "=>", "v", "1.5", "note", ":", "please", "(:", "D:", ">>", "a", "*", "b", "*"]
    for long in ("1a'" * 100_000, "a." * 100_000, "a@b." * 100_000, "<-" * 100_000, "é" * 300_000, "12:3" * 50_000):
        assert "".join(social(long)) == long
    assert one(spark, X.social_tokenize_to_string(F.lit("a &lt;3 b"))) == "a <3 b" and one(spark, X.count_family(F.lit("#a #b c"), "hashtag")) == 2
    assert one(spark, X.rtrim(F.lit(" this  and that  \n"))) == " this  and that"
    assert one(spark, X.parse_int(F.lit("-12"))) == -12 and one(spark, X.parse_int(F.lit("1.5"))) is None and one(spark, X.parse_double(F.lit("1.5"))) == 1.5


TREEBANK = {
    "eng": {
        "He can't say \"no\", Mr. Smith.": "He can n't say \"@ no @\" , Mr. Smith .",
        "He won't go (now).": "He will n't go -LRB- now -RRB- .", "a well-known fact": "a well @-@ known fact", "We're done!": "We 're done !",
        "caf&eacute; 1,000.50 &#8217;": "café 1,000.50 ’", "it costs 5kg, 5%": "it costs 5 kg , 5 %", "Is it so?! Yes...": "Is it so ?! Yes ...",
        "5-10 and/or 12:30": "5 @-@ 10 and @/@ or 12 @:@ 30", "Cannot AIN'T I'm": "Can not IS N'T I 'm", "See http://a.com/x?y=1.": "See http://a.com/x?y=1 .",
        "J. Smith of the U.S. left.": "J. Smith of the U.S. left .", "": "",
    },
    "fra": {"l'homme d'accord, aujourd'hui": "l' homme d' accord , aujourd'hui"}, "kin": {"n'umwana": "n' umwana"}, "mlg": {"an'ny": "an' ny"},
}


def test_treebank_tokens(spark):
    for lang, cases in TREEBANK.items():
        for text, tokens in cases.items():
            assert one(spark, X.treebank_tokenize(F.lit(text), lang)) == tokens
    assert one(spark, X.treebank_tokenize(F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError):
        X.treebank_tokenize(F.lit("x"), "xyz")


def test_trees(spark):
    nodes, warn, err, rest = trees.parse("(a b)")
    assert (warn, err, rest) == (0, 0, "") and trees.canonical(nodes) == "(a b)"
    assert trees.parse("(a b c)")[2] == 2 and trees.parse("(a)")[2] == 2 and trees.parse("(a b))")[3] == ")" and trees.parse("((a b)")[0] == []
    nodes = trees.parse("(b (a-H 1)(c 2))")[0]
    assert trees.canonical(nodes) == "(b (a-H 1) (c 2) )" and trees.pretty(nodes) == "\n(b \n  (a-H 1) \n  (c 2) )"
    assert one(spark, trees.token_line_tree(F.lit("Two words (here) . <EOS>"))) == "(TOP\n    (S (x Two) (x words) (x -LRB-here-RRB-) (. .) ) )"
    assert one(spark, trees.token_line_tree(F.lit(""))) == "(TOP )"
    d = spark.createDataFrame([("f", "(a (b-H 1) (c 2))\n(d 3)"), ("g", ""), ("h", None)], "path string, text string")
    got = trees.parse_trees(d, "path", "text", several=True).orderBy("tree").collect()
    assert [r.canonical for r in got] == ["(a (b-H 1) (c 2) )", "(d 3)"]
    t = trees.parse_trees(d.where("path = 'f'"), "path", "text").select(F.lit(1).alias("id"), "nodes")
    lines = spark.createDataFrame([(1, ["1", "x", "y"])], "id int, tokens array<string>")
    assert {(r.pos, r.problem) for r in trees.check_tokens(t, lines, "id").collect()} == {(1, "different"), (2, "missing in tree")}
    assert [r.canonical for r in trees.merge(d.where("path = 'f'")).collect()] == ["(a (b-H 1) (c 2) )", "(d 3)"]
    with pytest.raises(Exception, match="too many errors"):
        trees.merge(spark.createDataFrame([("x", "(a)")], "path string, text string")).collect()


GRAMMAR = ["# words", "", "zog := np", "blick := (s\\np)/np", "runs := s\\np", "the := np/n", "cat := n", "big := n/n", "must := (s\\np)/(s\\np)", "quickly := (s\\np)\\(s\\np)"]


def test_grammar(spark):
    lex = ccg.lexicon(GRAMMAR)
    parse = lambda s, r="AB": {str(c) for c in ccg.chart_parse(s.split(), lex, ccg.RULES[r])}
    assert "s" in parse("zog blick the big cat") and parse("the zog") == set() and "s" in parse("zog must blick zog")
    assert parse("the big") == set() and "np/n" in parse("the big", "harmonic")
    assert "(s\\np)/np" in parse("blick", "all") and "s\\np" in parse("blick zog quickly", "all")
    with pytest.raises(ccg.UnknownWord):
        parse("nothing")
    u = lambda a, b, **k: ccg.unify(ccg.parse_category(a), ccg.parse_category(b), **k)
    assert u("np[case=nom]", "np[case=X]") == {"X": "nom"} and u("np[case=nom]", "np[case=acc]") is None and u("np", "np[a=b]") == {}
    assert u("np[a=X,b=X]", "np[a=1,b=2]") is not None and u("np[a=X,b=X]", "np[a=1,b=2]", strict=True) is None
    c = ccg.parse_category("(s\\np)/np[a=b]")
    assert str(c) == "(s\\np)/np[a=b]" and c.arity == 3 and ccg.equal(c, ccg.parse_category("(s\\np)/np"))
    for bad in ("s/", "(s", "s)", "np[a]"):
        with pytest.raises(ccg.CategoryError):
            ccg.parse_category(bad)
    d = spark.createDataFrame([("zog runs",), ("*runs zog",), ("zog odd",)], "line string")
    assert {r.sentence: r.success for r in ccg.testbed(d, "line", GRAMMAR).collect()} == {"zog runs": True, "runs zog": True, "zog odd": False}


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("###/###\na/b/D\ndog/N\n###/###\nruns/V\n###/###\n")
    lines = corpora.read_lines(spark, str(tmp_path / "t.txt"))
    assert sorted((r.seq_id, r.pos, r.sym, r.tag) for r in corpora.tagged_stream(lines).collect()) == [(1, 0, "a/b", "D"), (1, 1, "dog", "N"), (2, 0, "runs", "V")]
    mk = lambda *xs: spark.createDataFrame([("p", i, x) for i, x in enumerate(xs)], "path string, line_no int, value string")
    assert sorted((r.seq_id, r.sym) for r in corpora.raw_stream(mk("a", "b", "###", "c")).collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert [(r.sym, r.tag) for r in corpora.tagged_lines(mk("a|b|D c|N")).orderBy("pos").collect()] == [("a|b", "D"), ("c", "N")]
    assert corpora.attachments(mk("1 eat pizza with fork V")).first().asDict() == {"sent_no": 1, "verb": "eat", "noun1": "pizza", "prep": "with", "noun2": "fork", "label": "V"}
    assert corpora.sentiment(mk("4;;3;;Mon;;q;;u;;hi;;there")).first().text == "hi;;there"
    assert tuple(corpora.point_lines(mk("New  Place 1.5 -2"), 2).first())[1:] == ("New  Place", [1.5, -2.0])
    assert tuple(corpora.edges(mk("a\tb")).first()) == ("a", "b")
    t = corpora.tweets(mk('{"more":1,"geo":{"coordinates":[1.0,2.0],"type":"Point"},"text":"x"}', "", '{"delete":{}}', '{"text":"y"}', "broken"))
    assert sorted(r.text for r in t.where("text IS NOT NULL").collect()) == ["x", "y"] and tuple(corpora.coordinates(t).first()) == (1.0, 2.0, "x")
    assert one(spark, corpora.xml_text(F.lit("<a><b>1</b><c><b>2</b></c></a>"), "b")) == ["1", "2"]
    assert corpora.join_path("/a/", "/b", "c/") == "/a/b/c" and one(spark, corpora.base_name(F.lit("a/b.c"))) == "b.c" and one(spark, corpora.parent(F.lit("/a/b/"))) == "/a"
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 1)], "k int, l string, n int")
    assert [tuple(r) for r in corpora.majority_votes(votes, "k", "l", "n").collect()] == [(1, "a")]
    parts = corpora.split_thirds(spark.range(10), "id").orderBy("id").collect()
    assert [r.part for r in parts] == [i * 3 // 10 for i in range(10)]
    g = corpora.generated_clusters(spark, 3000, seed=2).groupBy("gold").agg(F.avg(F.col("coord")[0]).alias("x")).collect()
    assert {r.gold: round(r.x) for r in g} == {0: -1, 1: 6, 2: -2}
    assert corpora.find_binary("sh") and corpora.find_binary("no-such-program") is None
    assert [r.output for r in corpora.pipe(mk("a", "b"), "value", ["tr", "a-z", "A-Z"]).orderBy("line_no").collect()] == ["A", "B"]
    corpora.write_lines(mk("q"), "value", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["q"]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "b", "x")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, label string, feature string").write.parquet(src)
    spark.createDataFrame([(3, "a", "x")], "doc_id long, label string, feature string").write.mode("append").parquet(src)
    stream = spark.readStream.schema("doc_id long, label string, feature string").option("maxFilesPerTrigger", 1).parquet(src)
    bayes = counters.OnlineBayes(spark, str(tmp_path / "counts"))
    bayes.start(stream, str(tmp_path / "ck")).awaitTermination()
    whole = naive_bayes.Trainer.of(spark.read.parquet(src)).model(1.0)
    read = lambda m: {(r.label, r.feature): round(r.p, 9) for r in m.likelihood().collect()}
    assert read(bayes.model()) == read(whole)
    q = counters.running_counts(stream, "feature").writeStream.outputMode("complete").format("memory").queryName("n").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.feature: r.cnt for r in spark.table("n").collect()} == {"x": 3, "y": 1}
    assert counters.windowed_counts(stream.withColumn("ts", F.current_timestamp()), "ts", "1 minute", "5 minutes", "label").isStreaming
    assert counters.tokenized(stream.select(F.col("feature").alias("value"))).isStreaming and counters.filtered_tweets(stream.select(F.col("feature").alias("value"))).isStreaming


def test_annotator(spark):
    d = spark.createDataFrame([(1, "Mr. Smith met Jane Doe in Paris. She was happy! Was it the big red dog?"), (2, ""), (3, None)], "doc_id int, text string")
    got = annotate.Pipeline().run(d, "doc_id").orderBy("sent").collect()
    assert [r.sentence for r in got] == ["Mr. Smith met Jane Doe in Paris.", "She was happy!", "Was it the big red dog?"]
    assert "Jane Doe" in got[0].persons and "the big red dog" in got[2].chunks
