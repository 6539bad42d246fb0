"""What stays bounded, or keeps its order, on larger tables."""

import numpy as np
import pyarrow as pa
import pytest

from compare import assert_same, database
from loomtext import catalog
from loomtext.operators import hmm, naive_bayes, ngram, trees
from loomtext.sources import corpora


@pytest.fixture
def collected(spark, monkeypatch):
    """The numbers of rows that reach the driver as Python objects."""
    kind, sizes = type(spark.range(1)), []
    plain = kind.collect

    def collect(self):
        rows = plain(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    return sizes


def test_gibbs_gathers_no_words(spark, collected):
    rows = [(i, "xy"[i % 2], f"{'xy'[i % 2]}{(i * 7 + k) % 20}") for i in range(60) for k in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, label string, feature string")
    got = naive_bayes.gibbs(d.where("doc_id >= 20").select("doc_id", "feature"), d.where("doc_id < 20"), ["x", "y"], 2, 4)
    assert max(collected) <= 2
    assert np.mean([r.label == "xy"[r.doc_id % 2] for r in got.collect()]) > 0.95
    with pytest.raises(ValueError, match="y"):
        naive_bayes.gibbs(d.select("doc_id", "feature"), d, ["x"], 1, 1)


@pytest.mark.parametrize("name", ["tagged_stream_read", "raw_stream_read", "tagged_lines_read"])
def test_streams_of_many_users(spark, tmp_path, name):
    e = spark.range(6000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "(id * 7919) % 3001 AS user_id", "CASE WHEN id % 3 = 0 THEN 'view' ELSE 'click' END AS event_type", "(id % 97) * 1.0D AS value", "'{}' AS props")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert "dense_rank" not in df._jdf.queryExecution().executedPlan().toString()
    assert_same(df, catalog.SQL[name], database(tmp_path))


def test_sentences_across_ranges_of_lines(spark):
    rows = [(p, i, "###" if i % 7 == 3 else f"{p}{i}") for p in "ab" for i in range(500)]
    got = corpora.raw_stream(spark.createDataFrame(rows, "path string, line_no int, value string").repartition(5)).collect()
    assert {(r.path, r.seq_id, r.pos, r.sym) for r in got} == {(p, (i + 4) // 7, i if i < 3 else (i + 3) % 7, v) for p, i, v in rows if v != "###"}


@pytest.mark.parametrize("several", [False, True])
def test_parsed_trees_leave_in_bounded_batches(several):
    texts = ["(S " + " ".join(f"(x w{k})" for k in range(100)) + " )"] * 1000
    batches = list(trees._parsed(several)(iter([pa.RecordBatch.from_pydict({"key": list(range(1000)), "text": texts})])))
    assert max(len(b.column("nodes").flatten()) for b in batches) <= trees.MOST_NODES + 201
    assert [k for b in batches for k in b.column("key").to_pylist()] == list(range(1000))


def test_generation_gathers_no_cells(spark, collected):
    rows = [(i, k, f"w{(i * 31 + k * k * 7) % (11 + i % 5)}") for i in range(80) for k in range(1 + i % 9)]
    m = ngram.train(spark.createDataFrame(rows, "seq_id int, pos int, sym string"), 2)
    got = m.generate(6, 5, 3)
    assert max(collected) <= 30
    table, rng, wanted = {}, np.random.default_rng(3), []
    for r in sorted(m.dist.cells.collect(), key=lambda r: (-r.p, r.item is not None, str(r.item))):
        table.setdefault(r.cond[0], []).append((r.p, r.item))
    for _ in range(6):
        seq = []
        while len(seq) < 5:
            p = np.cumsum([x for x, _ in table[seq[-1] if seq else None]])
            item = table[seq[-1] if seq else None][int(np.searchsorted(p, rng.random() * p[-1], "right"))][1]
            if item is None:
                break
            seq.append(item)
        wanted.append(seq)
    assert got == wanted


def test_batches_of_sequences_give_what_each_gives():
    rng = np.random.default_rng(5)
    with np.errstate(divide="ignore"):
        trans = np.log(np.where(rng.random((5, 5)) < 0.2, 0, rng.random((5, 5))))
        emit = {f"s{i}": np.log(np.where(rng.random(4) < 0.3, 0, rng.random(4))) for i in range(6)}
    legal = {"s0": np.array([1, 3]), "s1": np.array([2]), "s5": np.array([], int)}
    m = hmm.Model(list("abcd"), trans, emit, np.log(np.full(4, 0.1)), legal, np.array([0, 1, 2, 3]))
    seqs = [[f"s{k}" for k in rng.integers(0, 8 if i % 9 == 0 else 5, int(rng.integers(0, 9)))] for i in range(300)]
    for never_none in (True, False):
        assert hmm.Batch(m, seqs).decode(never_none) == [m.decode(s, never_none) for s in seqs]
    b = hmm.Batch(m, [s for s in seqs if s and "s5" not in s])
    trans, emits, total = b.expect()
    each = [m.expect(s) for s in seqs if s and "s5" not in s]
    assert np.allclose(trans, sum(e[0] for e in each)) and total == sum(e[2] for e in each)
    by = {s: np.zeros(4) for s in b.syms}
    for _, found, _ in each:
        for s, o, x in found:
            by[s][o] += x
    assert np.allclose(emits, [by[s] for s in b.syms])


@pytest.mark.parametrize("name", ["perceptron_score", "composite_evaluation", "maxent_classify"])
def test_words_are_split_once(spark, name):
    """What is read again and again is stored: the last plan doesn't go back to the texts."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
