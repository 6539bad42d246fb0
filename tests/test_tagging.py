"""Hidden-Markov tagging on small corpora with known answers."""

import math

import pytest

from loomtext.operators import counts as C
from loomtext.operators import hmm, tagdict


def corpus(spark, sentences):
    rows = [(i, j, *t.rsplit("/", 1)) for i, s in enumerate(sentences) for j, t in enumerate(s.split())]
    return spark.createDataFrame(rows, "seq_id int, pos int, sym string, tag string")


def raw(spark, sentences):
    return spark.createDataFrame([(i, j, w) for i, s in enumerate(sentences) for j, w in enumerate(s.split())], "seq_id int, pos int, sym string")


def read(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.seq_id, r.pos)):
        out.setdefault(r.seq_id, []).append(r.tag)
    return [out[k] for k in sorted(out)]


@pytest.fixture(scope="module")
def train(spark):
    return corpus(spark, [" ".join(f"{w}/{t}" for w, t in zip(s.split(), "DNV.", strict=True)) for s in ("the dog walks .", "the cat walks .", "a dog barks .")])


def test_counts(spark, train):
    t = {(r.cond, r.item): r.cnt for r in hmm.fix_transitions()(hmm.transition_counts(train)).cells.collect()}
    assert t == {(None, "D"): 3, ("D", "N"): 3, ("N", "V"): 3, ("V", "."): 3, (".", None): 3}
    e = {(r.cond, r.item): r.cnt for r in hmm.emission_counts(train).cells.collect()}
    assert e[None, None] == 6 and e["D", "the"] == 2
    fixed = {(r.cond, r.item): r.cnt for r in hmm.fix_emissions()(hmm.emission_counts(train)).cells.collect()}
    assert fixed[None, None] == 1 and fixed["N", "dog"] == 2


def test_boundary_never_follows_itself(spark):
    c = C.CondCounts.plain(spark.createDataFrame([(None, None, 8.0), (None, "a", 2.0)], "cond string, item string, cnt double"))
    assert {(r.cond, r.item): r.cnt for r in hmm.fix_transitions()(c).cells.collect()} == {(None, None): 0, (None, "a"): 2}


def test_supervised(spark, train):
    plain = hmm.train_supervised(train)
    assert read(hmm.tag(raw(spark, ["the dog walks .", "a cat walks ."]), plain)) == [["D", "N", "V", "."]] * 2
    smooth = C.eisner(1.0, C.add_lambda(1.0))
    model = hmm.train_supervised(train, smooth, smooth)
    assert read(hmm.tag(raw(spark, ["a cat meows .", "this bird chirps ."]), model)) == [["D", "N", "V", "."]] * 2


def test_impossible_sequences_get_tags_or_none(spark, train):
    m = hmm.train_supervised(train)
    assert len(m.decode(["unknown", "words"])) == 2 and m.decode(["unknown"], never_none=False) is None and m.decode([]) == []


def test_decoder_for_any_scores():
    edges = {(None, "D"): 1, ("D", "A"): 0.25, ("D", "N"): 0.75, ("A", "N"): 1, ("N", "N"): 0.45, ("N", "V"): 0.55, ("V", None): 1}
    score = lambda ps, pt, s, t: math.log(edges[pt, t]) if (pt, t) in edges else float("-inf")
    words = "the big dog walks".split()
    assert hmm.viterbi(words, ["D", "A", "N", "V"], score) == ["D", "N", "N", "V"]
    options = {"the": ["D"], "big": ["A"], "dog": ["N"], "walks": ["N", "V"]}
    assert hmm.viterbi(words, [], score, options.__getitem__) == ["D", "A", "N", "V"]
    assert hmm.viterbi(["the", "odd"], [], score, lambda s: {"the": ["D"]}.get(s, [])) is None
    assert hmm.viterbi(words, ["D", "A", "N", "V"], score, follows={None: {"D"}, "D": {"A"}, "A": {"N"}, "N": {"V"}, "V": {None}}) == ["D", "A", "N", "V"]


def test_decoding_agrees_with_trying_all_paths(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    m = hmm.Model(["a", "b", "c"], np.log(rng.dirichlet(np.ones(4), 4)), {w: np.log(rng.random(3)) for w in "xyz"}, np.log(np.full(3, 1e-3)))
    for _ in range(20):
        words = [str(w) for w in rng.choice(list("xyzu"), rng.integers(1, 6))]

        def logp(path, words=words):
            s = m.trans[3, path[0]] + m.trans[path[-1], 3]
            return s + sum(m.trans[p, q] for p, q in itertools.pairwise(path)) + sum(m.emission(w)[p] for w, p in zip(words, path, strict=True))

        paths = list(itertools.product(range(3), repeat=len(words)))
        best = max(paths, key=logp)
        assert m.decode(words) == [m.tags[i] for i in best]
        trans, emits, total = m.expect(words)
        assert total == pytest.approx(np.logaddexp.reduce([logp(p) for p in paths]))
        assert trans.sum() == pytest.approx(len(words) + 1) and all(x.sum() == pytest.approx(1) for _, _, x in emits)


def test_estimated_emissions(spark):
    d = tagdict.simple(spark.createDataFrame([tuple(x.split("/")) for x in "the/D dog/N saw/N saw/V".split()], "sym string, tag string"))
    tokens = spark.createDataFrame([(w,) for w in "the the dog saw saw new".split()], "sym string")
    got = {(r.cond, r.item): r.cnt for r in hmm.estimated_emissions(tokens, d).cells.collect()}
    mass, squares = {"D": 2, "N": 2, "V": 1}, {"D": 1, "N": 4, "V": 1}
    x = {t: mass[t] / 5 * squares[t] / 6 for t in mass}
    share = {t: v / sum(x.values()) for t, v in x.items()}
    assert got == pytest.approx({("D", "the"): 2, ("N", "dog"): 1, ("N", "saw"): 1, ("V", "saw"): 1, (None, None): 1} | {(t, "new"): share[t] for t in share})


def test_type_supervised_learns(spark):
    sentences = ["the dog walks", "a cat walks", "the cat saw a dog", "a dog saw the cat", "the man walks", "a man saw the dog"] * 2
    d = tagdict.simple(spark.createDataFrame([(w, t) for w, ts in {"the": "D", "a": "D", "dog": "N", "cat": "N", "walks": "V", "saw": "NV"}.items() for t in ts], "sym string, tag string"))
    smooth = C.eisner(1.0, C.add_lambda(1.0))
    seen = []
    text = raw(spark, sentences)
    start = hmm.build(hmm.uniform_transitions(d.all_tags()), C.cond_dist(hmm.estimated_emissions(text, d, 1.0, 1.0)), d)
    hmm.estimate(text, start, 5, hook=lambda i, m, logp: seen.append(logp))
    assert seen == sorted(seen)
    model = hmm.train_type_supervised(text, d, smooth, smooth, iterations=5)
    assert read(hmm.tag(raw(spark, ["the man saw a cat", "a dog walks"]), model)) == [list("DNVDN"), list("DNV")]


def test_semi_supervised_uses_gold(spark, train):
    d = tagdict.simple(train)
    smooth = C.eisner(1.0, C.add_lambda(1.0))
    model = hmm.train_type_supervised(raw(spark, ["the dog barks .", "a cat walks ."]), d, smooth, smooth, iterations=2, gold=train)
    assert read(hmm.tag(raw(spark, ["a cat barks ."]), model)) == [["D", "N", "V", "."]]


def test_score_and_other_taggers(spark, train):
    words = spark.createDataFrame([tuple(x.split("/")) for x in ("the/D", "dog/V")], "sym string, tag string")
    out = hmm.rule_tag(train.drop("tag"), words, [("[.]", "."), (".*s", "V")], "N")
    s = hmm.score(out, train, tagdict.simple(words)).first().asDict()
    assert s == {"correct": 9, "total": 12, "known_correct": 2, "known_total": 4, "unknown_correct": 7, "unknown_total": 8}
    assert [tuple(r) for r in hmm.mistakes(out, train).collect()] == [("N", "V", 2), ("D", "N", 1)]
    with pytest.raises(Exception, match="baseline_tag"):
        hmm.baseline_tag(train.drop("tag"), words).collect()
