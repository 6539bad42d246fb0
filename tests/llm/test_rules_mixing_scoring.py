"""Quality rules, mixing and language-model scores: against SQL on tables, and on awkward rows."""

import math
from collections import Counter

import pytest

from compare import assert_same, database
from fixtures import LONG, ROWS, awkward, empty
from loomtext.llm import lm_score, mixing, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], database(SF))


# --- rules ---


def test_ledger_of_awkward_rows(spark):
    led = {(r.doc_id, r.n_words): r for r in quality_rules.ledger(awkward(spark), "doc_id").collect()}
    bit = quality_rules.BIT
    assert led[1, 16].fail_bits == 0 and led[4, 0].fail_bits == led[5, 0].fail_bits == bit["no_words"] | bit["few_words"]
    assert led[9, 6].fail_bits & bit["symbols"] and led[11, 16].fail_bits & bit["capitals"]
    assert led[8, 240_000].fail_bits == bit["low_diversity"]
    assert quality_rules.ledger(empty(spark), "doc_id").count() == 0


def test_rules_stage_keeps_columns_and_rows(spark):
    docs = awkward(spark)
    kept = quality_rules.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, 2: 1, 3: 1, 7: 1, 8: 1, 10: 1, None: 1})


def test_stage_evaluates_each_rule_once(spark):
    plan = quality_rules.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") <= 2


def test_ablations_add_up(spark):
    led = quality_rules.ledger(awkward(spark), "doc_id").cache()
    for r in quality_rules.ablations(led).collect():
        mask, bit = quality_rules.POLICIES[r.policy], quality_rules.BIT[r.rule]
        bits = [x.fail_bits for x in led.collect()]
        assert (r.n_fail, r.n_only, r.n_rejected, r.n_rows) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(bool(b & mask) for b in bits), len(bits))
    assert all(r.n_rows == 0 for r in quality_rules.ablations(quality_rules.ledger(empty(spark), "doc_id")).collect())


def test_policies_apply_to_the_stored_ledger(spark, tmp_path, monkeypatch):
    """A new policy and the ablations read no text; rules that changed, other files and an unfinished ledger aren't taken for the stored one."""
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    led, kept = quality_rules.stored(spark, str(tmp_path)), quality_rules.query(spark, str(tmp_path))
    assert Counter(led.collect()) == Counter(quality_rules.ledger(awkward(spark), "doc_id").collect()) == Counter(kept.select(led.columns).collect())
    assert all("documents" not in f for f in kept.inputFiles())
    monkeypatch.setattr(quality_rules, "ledger", None)
    monkeypatch.setitem(quality_rules.POLICIES, 3, quality_rules.BIT["few_words"])
    cells = {(r.policy, r.rule): r for r in quality_rules.ablation_query(spark, str(tmp_path)).collect()}
    assert cells[3, "few_words"].n_fail == cells[3, "few_words"].n_rejected == sum(r.n_words < 5 for r in led.collect())
    monkeypatch.undo()
    before = set(led.inputFiles())
    with monkeypatch.context() as m:
        m.setattr(quality_rules, "RULES", quality_rules.RULES[:-1] + (("low_diversity", "n_words >= 3"),))
        assert not before & set(quality_rules.stored(spark, str(tmp_path)).inputFiles())
    empty(spark).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert quality_rules.stored(spark, str(tmp_path)).count() == 0 and led.count() == len(ROWS)
    led = quality_rules.stored(spark, str(tmp_path), folder=f"{tmp_path}/kept")
    (done,) = (tmp_path / "kept").glob("*/*/_SUCCESS")
    done.unlink()
    assert quality_rules.stored(spark, str(tmp_path), folder=f"{tmp_path}/kept").inputFiles() != led.inputFiles()


# --- mixing ---


def test_budgets_are_exact(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 7 + 1)) for i in range(300)] + [(i, None, "w w") for i in range(300, 310)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(docs, {"s0": 3.0, "s1": 1.0}, 2.0, total=4000).select("__row.doc_id", "__row.source", "epoch", "start", "taken").collect()
    weights = {"s0": 3.0, "s1": 1.0, "s2": 2.0, None: 2.0}
    for s, w in weights.items():
        mine = sorted((r for r in out if r.source == s), key=lambda r: r.start)
        assert sum(r.taken for r in mine) == math.floor(4000 * w / 8.0)
        at = 0
        for r in mine:
            assert r.start == at
            at += r.taken
        full = Counter(r.epoch for r in mine)
        assert all(full[e] == full[0] for e in range(max(full)))
    assert max(r.epoch for r in out if r.source is None) > 10


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    n = {s: sum(len((r[1] or "").split()) for r in ROWS if r[3] == s) for s in ("s", None)}
    got = {r.source: r.n for r in mixing.mix_sources(docs, {}).groupBy("__row.source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert got == {s: sum(n.values()) // 2 for s in n}
    assert sum(len((r.text or "").split()) for r in out.collect()) > 0
    odd = spark.createDataFrame([(1, "a b", None), (2, "c d", "\0"), (3, "e f", "")], "doc_id long, text string, source string")
    assert {r.source: r.n for r in mixing.mix_sources(odd, {}).groupBy("__row.source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()} == {None: 2, "\0": 2, "": 2}
    assert mixing.stage(spark, empty(spark), "").count() == 0
    assert mixing.mix_sources(docs.where("doc_id = 5")).count() == 0


# --- language-model scores ---


def brute_scores(texts, alpha=0.4, least=2):
    seqs = [(t or "").split() for t in texts]
    c = [Counter(), Counter(), Counter(), Counter()]
    for s in seqs:
        for k in (1, 2, 3):
            c[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    n, out = sum(map(len, seqs)), []
    for s in seqs:
        logp = backs = 0
        for i in range(len(s)):
            k, b = min(3, i + 1), 0
            while k > 1 and c[k][tuple(s[i - k + 1 : i + 1])] < least:
                k, b = k - 1, b + 1
            below = c[k - 1][tuple(s[i - k + 1 : i])] if k > 1 else n
            logp += math.log(c[k][tuple(s[i - k + 1 : i + 1])] / below) + b * math.log(alpha)
            backs += b
        out.append((len(s), backs, logp))
    return out


@pytest.mark.parametrize("chunk_bytes", [lm_score.CHUNK_BYTES, 50_000, 40])
def test_scores_of_awkward_rows(spark, chunk_bytes):
    """Against brute force; small chunks cut every text, and the longest into many pieces."""
    rows = [r if chunk_bytes > 40 or r[1] != LONG else (r[0], "alpha beta gamma delta " * 300, *r[2:]) for r in ROWS]
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, logp_sum string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_backoff, round(r.logp_sum, 4)) for r in lm_score.lm_scores(docs, chunk_bytes=chunk_bytes).collect()))
    want = sorted((r[0] is None, r[0] or 0, n, b, round(x, 4)) for r, (n, b, x) in zip(rows, brute_scores([r[1] for r in rows]), strict=True))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-3)


def test_scores_do_not_depend_on_chunks_or_buckets(spark):
    docs = awkward(spark)
    one = sorted((str(r.doc_id), round(r.logp_sum, 3)) for r in lm_score.lm_scores(docs).collect())
    many = sorted((str(r.doc_id), round(r.logp_sum, 3)) for r in lm_score.lm_scores(docs, chunk_bytes=100_000, bucket_keys=100).collect())
    assert one == many and lm_score.lm_scores(empty(spark)).count() == 0


def test_pieces_of_a_text():
    words = [f"w{i}" for i in range(500)] + ["x" * 5000, "end"]
    for text in (" ".join(words), "  \n".join(words) + "\t"):
        for most in (1, 50, 3000, 10**6):
            pieces = lm_score.cut(text.encode(), most, 3)
            assert [w for before, p in pieces for w in p.decode().split()[before:]] == words
            at = 0
            for before, p in pieces:
                got = p.decode().split()
                assert before == min(3, at) and got[:before] == words[at - before : at]
                at += len(got) - before
    assert lm_score.cut(b"", 5, 3) == [(0, b"")]


def test_packed_keys_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for top in (1, 10, 1 << 20, 1 << 40, (1 << 63) - 1):
        x = rng.integers(0, top, 500, dtype=np.uint64)
        assert (lm_score.unpack(lm_score.pack(x), 500) == x).all()
    keys = np.unique(rng.integers(0, 1 << 63, 400_000, dtype=np.uint64)) * np.uint64(2)
    size = []
    for buckets in (256, 2048):  # bytes of a key don't depend on the number of buckets, but for what each row adds
        b = lm_score.bucket_of(keys, buckets)
        size.append(sum(len(lm_score.pack(np.diff(keys[b == k], prepend=np.uint64(0)))) for k in range(buckets)) / len(keys))
    assert b.max() == 2047 and size[0] < 6.3 and size[1] < size[0] * 1.1
