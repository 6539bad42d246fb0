"""Every stage of the pipeline against an independent computation on its own input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from compare import database
from fixtures import awkward, empty
from loomtext.llm import mixing, packing, pu_quality, quality_rules
from test_learned_and_packed import check_packing, check_sequences, encoder
from test_near_duplicates import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "mixing", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        out.write.parquet(str(tmp_path / name / "documents.parquet"))
        return spark.read.parquet(str(tmp_path / name / "documents.parquet"))

    a = step("quality rules", docs)
    wanted = {r[0] for r in database(SF).execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE keep_v1").fetchall()}
    assert a.columns == columns and {r.doc_id for r in a.collect()} == wanted and a.count() < docs.count()

    b = step("quality classifier", a)
    model = pu_quality.fit_from(a, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = a.collect()
    score = model.score(pu_quality.features(pa.array([r.text for r in rows])))
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {r.doc_id for r, s in zip(rows, score, strict=True) if s >= model.cut}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & {r.doc_id for r in rows}
    assert len(good & {r.doc_id for r in b.collect()}) >= 0.98 * len(good)

    c = step("near-duplicates", b)
    rows = {r.doc_id: r.text for r in b.collect()}
    roots, _ = brute(rows)
    assert c.columns == columns and {r.doc_id for r in c.collect()} == rows.keys() - roots.keys()

    d = step("mixing", c)
    enc = encoder()
    count = lambda t: len(enc.encode_ordinary(t or ""))
    have, got, longest = {}, {}, 0
    for r in c.collect():
        have[r.source] = have.get(r.source, 0) + count(r.text)
        longest = max([longest, *map(len, (r.text or "").split())])
    for r in d.collect():
        got[r.source] = got.get(r.source, 0) + count(r.text)
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s, n in have.items() if n}
    assert d.columns == columns and got.keys() == weight.keys()
    for s, w in weight.items():
        budget = int(sum(have.values()) * w / sum(weight.values()))
        assert budget - longest <= got[s] <= budget

    e = stages["packing"](spark, d, SF).collect()
    tokens, texts = {}, {}
    for r in d.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + count(r.text)
        texts.setdefault(r.doc_id, set()).add(r.text)
    n = check_packing(e, tokens, packing.CAPACITY)
    check_sequences(e, packing.CAPACITY)
    assert n <= sum(tokens.values()) / packing.CAPACITY * 1.05 + 2
    for r in e:
        ids = [enc.encode_ordinary(t)[r.begin : r.begin + r.n_tokens] for t in texts[r.doc_id]]
        assert r.content in [b"".join(map(enc.decode_single_token_bytes, i)) for i in ids]


def test_run_on_awkward_tables(spark, tmp_path):
    for name, docs, labels in (
        ("empty", empty(spark), True),
        ("awkward", awkward(spark), True),
        ("no labels", awkward(spark), False),
        ("all rejected", awkward(spark).withColumn("text", F.lit("### $$$ %%% &&&")), True),
        ("nulls", awkward(spark).withColumn("text", F.lit(None).cast("string")), True),
    ):
        folder = str(tmp_path / name)
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").where(F.lit(labels)).write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) > 0) == (name in ("awkward", "no labels"))
        check_sequences(rows, packing.CAPACITY)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "copy", "part", "begin", "n_tokens", "sequence", "offset", "content"] and out.count() > 0
    seqs = {}
    for r in out.collect():
        seqs[r.sequence] = seqs.get(r.sequence, 0) + r.n_tokens
    assert max(seqs.values()) <= packing.CAPACITY and np.mean(list(seqs.values())) > 0.9 * packing.CAPACITY
