"""Language identification, token counts, packing, and the quality classifier."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from fixtures import LONG, ROWS, TEXT, awkward, empty
from loomtext.llm import language_id, packing, pu_quality, token_count
from loomtext.llm.common import n_words

SF = "/root/testdata/sf0.001"


# --- language identification ---


def test_languages_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language_id.fit_dictionaries(docs)
    assert sorted(dictionaries) == ["de", "en", "es", "fr"] and all(len(d) <= language_id.DICTIONARY_BYTES for d in dictionaries.values())

    def brute(text):
        sizes = {}
        for lang, d in dictionaries.items():
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = len(c.compress(text.encode()))
        (a, best), (b, _) = sorted((n, k) for k, n in sizes.items())[:2]
        return best if (b - a) / b >= language_id.MARGIN else None

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in language_id.query(spark, SF).collect()}
    assert got.keys() == texts.keys()
    agree = np.mean([got[k].language == brute(t) for k, t in texts.items() if t])
    assert agree > 0.97  # a prepared dictionary may cut its hash chains in another way


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.where("doc_id < 500"), docs.where("doc_id >= 500")
    got = language_id.identify_languages(rest, language_id.fit_dictionaries(train)).collect()
    long = [r for r in got if r.accepted]
    assert len(long) / len(got) > 0.9 and np.mean([r.language == r.declared for r in long]) > 0.97


def test_languages_awkward(spark):
    d = {"en": TEXT.encode() * 20, "de": b"Der schnelle braune Fuchs springt ueber den faulen Hund und rennt weg. " * 20}
    got = language_id.identify_languages(awkward(spark), d).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].language == "en" and not by[4].accepted and not by[5].accepted and by[4].margin == 0
    assert not any(r.accepted for r in language_id.identify_languages(awkward(spark), {}).collect())
    assert all(r.accepted for r in language_id.identify_languages(awkward(spark).where("length(text) > 3"), {"en": d["en"]}).collect())
    assert language_id.identify_languages(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [300_000, 800_000, 3_000_000])
def test_long_texts_keep_their_language(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    identify = language_id.Identifier(language_id.fit_dictionaries(docs.where("doc_id < 500")))
    texts = {}
    for r in docs.where("doc_id >= 500 AND lang IS NOT NULL AND text <> ''").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    for lang, own in texts.items():
        rng = np.random.default_rng(size)
        text = ""
        while len(text) < size:
            text += "\n" + "\n".join(own[i] for i in rng.permutation(len(own)))
        got = identify(text.encode()[:size])
        assert got[0] == lang and got[4] > 3 * language_id.MARGIN


# --- token counts ---


def test_token_counts_against_a_public_encoder(spark):
    import tiktoken

    path = f"{token_count.TOKENIZERS}/{token_count.VOCABULARY}"
    enc = tiktoken.Encoding("own", pat_str=token_count.PATTERN, mergeable_ranks=token_count.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in token_count.query(spark, SF).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_symbols, r.n_merges) == (len(enc.encode_ordinary(t)), len(t.encode()), len(t.encode()) - len(enc.encode_ordinary(t)))


def test_equal_hashes_are_compared(monkeypatch):
    """Pre-tokens that share a hash are counted apart."""
    monkeypatch.setattr(token_count, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    c = token_count.Counter(token_count.load_ranks(f"{token_count.TOKENIZERS}/{token_count.VOCABULARY}"))
    texts = ["the cat zqxjv", "zqxjv " + "ab" * 100, "", None, "ba" * 100]
    assert c.column(pa.array(texts)).tolist() == [len(encoder().encode_ordinary(t or "")) for t in texts]


def test_beginnings_end_with_a_pretoken():
    c, enc = token_count.Counter(token_count.load_ranks(f"{token_count.TOKENIZERS}/{token_count.VOCABULARY}")), encoder()
    text = "Déjà vu: it's 12345  words\n\nof 中文 xyzzyplugh!"
    n = len(enc.encode_ordinary(text))
    for most in range(n + 2):
        got = c.beginning(text, most)
        assert text.startswith(got) and len(enc.encode_ordinary(got)) <= most
        rest = token_count.pretokens(text)[len(token_count.pretokens(got)) :]
        assert not rest or rest[0].isspace() or len(enc.encode_ordinary(got + rest[0])) > most


def test_cuts_follow_the_pattern():
    import random

    import regex

    pattern, rng = regex.compile(token_count.PATTERN), random.Random(4)
    letters = [*"abst'''mdrevl  \n\t 　!?.19٣Ⅷ½éß中文\U0001f600́_-\x1c\x85\xa0", "'s", "'re", "'ll", " ' ", "'ve"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        assert token_count.pretokens(text) == pattern.findall(text), repr(text)


def test_merges_against_rescanning():
    import random

    rng = random.Random(2)
    ranks = {bytes([c]): c for c in range(97, 101)}
    words = [bytes(rng.choices(b"abcd", k=rng.randint(2, 4))) for _ in range(60)]
    ranks |= {w: 300 + i for i, w in enumerate(dict.fromkeys(words))}

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not options:
                return len(parts)
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(2000):
        word = bytes(rng.choices(b"abcd", k=rng.randint(0, 20)))
        assert token_count.merged_count(word, ranks) == slow(word)


def test_long_texts_are_counted_in_parts(monkeypatch):
    ranks = token_count.load_ranks(f"{token_count.TOKENIZERS}/{token_count.VOCABULARY}")
    text = "It's a long, long text with Öl, 123 and  blanks.\n" * 2000
    whole = token_count.Counter(ranks).count(text)
    monkeypatch.setattr(token_count, "LONG_TEXT", 500)
    small = token_count.Counter(ranks, most=10)
    assert small.count(text) == whole and len(small.new) <= 10


def test_token_counts_awkward(spark):
    got = token_count.token_counts(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert all(r.n_tokens == r.n_symbols == r.n_merges == 0 for r in got if r.doc_id in (4, 5))
    assert next(r.n_symbols for r in got if r.doc_id == 8) == len(LONG) and token_count.token_counts(empty(spark)).count() == 0


# --- packing ---


def test_best_filling_against_all_fillings():
    rng = np.random.default_rng(1)
    for _ in range(50):
        value, slots = rng.random(5), int(rng.integers(1, 9))
        f = packing.best_filling(value, slots)
        best = max(sum(value[i] * c for i, c in enumerate(x)) for x in itertools.product(range(slots + 1), repeat=5) if sum((i + 1) * c for i, c in enumerate(x)) <= slots)
        assert (f * np.arange(1, 6)).sum() <= slots and (f * value).sum() == pytest.approx(best)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    histogram = rng.integers(0, 400, 64) * (rng.random(64) < 0.5)
    packed, bound = packing.plan(histogram.astype(np.int64), 64)
    placed = sum((f * n for f, n in packed), np.zeros(64, np.int64))
    assert (placed == histogram).all() and all((f * np.arange(1, 65)).sum() <= 64 for f, _ in packed)
    fillings, x = packing.solve(histogram.astype(np.int64), 64)
    assert ((np.array(fillings).T @ x)[histogram > 0] >= histogram[histogram > 0] * (1 - 1e-9)).all()  # the fractions cover all
    assert bound <= sum(n for _, n in packed) <= np.ceil(x.sum()) + 2


def check_packing(rows, tokens, capacity):
    got, seqs = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        seqs[r.sequence] = seqs.get(r.sequence, 0) + r.n_tokens
    assert max(seqs.values(), default=0) <= capacity
    assert {k: sum(r.n_tokens for r in v) for k, v in got.items()} == {k: n for k, n in tokens.items() if n}
    packed = [s for s in seqs if s >= 0]
    assert sorted(packed) == list(range(len(packed)))
    assert all(seqs[s] == capacity for s in seqs if s < 0)
    return len(seqs)


def check_sequences(rows, capacity):
    """Parts follow each other in their sequences and in their documents without gaps."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence, []).append((r.offset, r.n_tokens))
        docs.setdefault((r.doc_id, r.copy), []).append((r.part, r.begin, r.n_tokens))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    for own in docs.values():
        if len({p for p, _, _ in own}) == len(own):  # not so where rows of one id differ in text
            at = 0
            for i, (part, begin, n) in enumerate(sorted(own)):
                assert (part, begin) == (i, at)
                at += n


def encoder():
    import tiktoken

    path = f"{token_count.TOKENIZERS}/{token_count.VOCABULARY}"
    return tiktoken.Encoding("own", pat_str=token_count.PATTERN, mergeable_ranks=token_count.load_ranks(path), special_tokens={})


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    enc = encoder()
    tokens = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in docs}
    rows = packing.query(spark, SF).collect()
    n = check_packing(rows, tokens, packing.CAPACITY)
    check_sequences(rows, packing.CAPACITY)
    assert n <= sum(tokens.values()) / packing.CAPACITY * 1.05 + 2
    assert sorted((r.doc_id, r.part) for r in rows) == sorted((k, i) for k, t in tokens.items() for i in range(-(-t // packing.CAPACITY)))


def test_content_rebuilds_the_tokens(spark):
    """Of every sequence, from a public encoder's tokens of the documents."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["déjà vu 中文 " * 300, "a", "", None, "xyzzyplugh" * 200, "word " * 90, "word " * 90])] + [(5, "word " * 90)], "doc_id long, text string")
    enc, texts = encoder(), {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, 64, content=True).collect()
    check_sequences(rows, 64)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])[r.begin : r.begin + r.n_tokens]
        assert b"".join(enc.decode_single_token_bytes(i) for i in ids) == r.content
    assert {(r.doc_id, r.copy) for r in rows} == {(0, 0), (1, 0), (4, 0), (5, 0), (5, 1), (6, 0)}


def test_packing_awkward(spark):
    rows = packing.pack(awkward(spark), 64, count=n_words).collect()
    tokens = {}
    for r in ROWS:
        tokens[r[0]] = tokens.get(r[0], 0) + len((r[1] or "").split())
    check_packing(rows, tokens, 64)
    check_sequences(rows, 64)
    assert packing.pack(empty(spark)).count() == 0 and packing.pack(awkward(spark).where("doc_id = 4")).count() == 0
    assert packing.pack(empty(spark), content=True).columns == [*packing.pack(empty(spark)).columns, "content"]


def test_packing_uses_the_room_of_every_token(spark):
    short = spark.range(4096).selectExpr("id AS doc_id", "'word' AS text")
    assert check_packing(packing.pack(short, count=n_words).collect(), dict.fromkeys(range(4096), 1), packing.CAPACITY) == 2
    pairs = spark.range(60).selectExpr("id AS doc_id", "repeat('a ', IF(id % 2 = 0, 1025, 1023)) AS text")
    assert check_packing(packing.pack(pairs, count=n_words).collect(), {i: 1025 - i % 2 * 2 for i in range(60)}, packing.CAPACITY) == 30


def test_program_against_its_optimum():
    """The fractional program of small histograms against a linear program over all fillings, solved by enumeration of bases."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        sizes = sorted(rng.choice(np.arange(3, 12), 3, replace=False).tolist())
        histogram = np.zeros(20, np.int64)
        for k in sizes:
            histogram[k - 1] = rng.integers(200, 900)
        options = [o for o in itertools.product(*(range(20 // k + 1) for k in sizes)) if 0 < sum(a * b for a, b in zip(o, sizes, strict=True)) <= 20]
        need, best = histogram[[k - 1 for k in sizes]].astype(float), np.inf
        for basis in itertools.combinations(options, 3):
            m = np.array(basis, float).T
            if abs(np.linalg.det(m)) > 1e-9 and ((x := np.linalg.solve(m, need)) >= -1e-9).all():
                best = min(best, x.sum())
        _, x = packing.solve(histogram, 20)
        assert best - 1e-6 <= x.sum() <= best * (1 + packing.GAP) + 1


# --- positive-unlabelled classifier ---


def test_features():
    x = pu_quality.features(pa.array([None, "", " ", "a a b", "Hi!", LONG]))
    assert (x[:3] == 0).all() and x.shape == (6, pu_quality.WIDTH)
    assert x[3, -4] == pytest.approx(1 / 3) and x[3, -3] == pytest.approx(2 / 3) and np.isfinite(x).all()
    assert (pu_quality.features(pa.array(["Hi!"])) == x[4]).all()


def test_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (600, 6))
    hidden = rng.random(3000) < 0.7
    unlabelled = np.where(hidden[:, None], rng.normal(1.5, 1, (3000, 6)), rng.normal(-1.5, 1, (3000, 6)))
    m = pu_quality.fit(positive, unlabelled)
    assert abs(m.prior - 0.7) < 0.1
    new_p, new_n = rng.normal(1.5, 1, (2000, 6)), rng.normal(-1.5, 1, (2000, 6))
    assert (m.score(new_p) >= m.cut).mean() > 0.97 and (m.score(new_n) < m.cut).mean() > 0.9
    assert pu_quality.fit(positive[:2], unlabelled) is None


def test_marks_and_long_characters_are_classes_of_their_own():
    kinds = pu_quality._CLASS
    assert len({int(kinds[ord(c)]) for c in " \n\t.,!?'\"|*$%&#-aA0"}) == 19 and kinds.max() == pu_quality.CLASSES - 1
    assert not {int(kinds[b]) for b in "äß中".encode()} & {int(kinds[b]) for b in range(128)}


def test_prior_is_of_all_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.fit_from(docs, labels)
    score, rows = pu_quality.histogram(docs, model)
    texts = [r.text for r in docs.collect()]
    brute = np.round(np.clip(model.score(pu_quality.features(pa.array(texts))), -100, 100), 2)
    assert rows.sum() == len(texts) and np.allclose(np.sort(np.repeat(score, rows.astype(int))), np.sort(brute), atol=0.0101)
    a, b = np.random.default_rng(1).normal(1, 1, 500), np.round(np.random.default_rng(2).normal(0, 1, 5000), 1)
    values, n = np.unique(b, return_counts=True)
    assert pu_quality.estimate_prior(a, values, weight=n.astype(float)) == pytest.approx(pu_quality.estimate_prior(a, b))


def test_risk_against_its_definition():
    """The descent lowers the non-negative risk to what a plain search finds, and its gradient is that of finite differences."""
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(1, 1, (80, 2)), rng.normal(-0.2, 1.3, (200, 2)), 0.4

    def risk(v):
        zp, zu = p @ v[:2] + v[2], u @ v[:2] + v[2]
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    w, b = pu_quality._descend(p, u, prior, 1500, 0.02, 0.0, True)
    best = min(risk(np.array([x, y, z])) for x in np.arange(-1, 3.1, 0.25) for y in np.arange(-1, 3.1, 0.25) for z in np.arange(-3, 3.1, 0.25))
    assert risk(np.append(w, b)) <= best + 0.02


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.fit_from(docs, labels.where("doc_id % 2 = 0"))
    keep = {r.doc_id: r.keep for r in pu_quality.classify(docs, labels, model).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([keep[r.doc_id] for r in rest if r.quality == 1]) > 0.98
    assert np.mean([not keep[r.doc_id] for r in rest if r.quality == 0]) > 0.7


def test_classifier_awkward(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(2, 1, None), (3, None, 0), (None, 1, 0), (2, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.keep for r in pu_quality.classify(docs, labels).collect()] == [True] * len(ROWS)  # too few positives: no model
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = pu_quality.fit_from(real, spark.read.parquet(f"{SF}/labels.parquet"))
    got = pu_quality.classify(docs, labels, model).collect()
    assert len(got) == len(ROWS) and len({r.score for r in got if r.doc_id in (4, 5)}) == 1 and all(r.keep == (r.score >= model.cut) for r in got)
    assert pu_quality.classify(empty(spark), labels).count() == 0
    kept = pu_quality.stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(ROWS) and pu_quality.stage(spark, empty(spark), SF).count() == 0
