"""Circulant MinHash against its definition, and near-duplicates against all pairs."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from fixtures import ROWS, TEXT, awkward, empty
from loomtext.llm import kernels, minhash

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=minhash.SHINGLE):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(texts, threshold=minhash.THRESHOLD):
    """{id: lowest id of its component} over all pairs at or above the threshold, and those pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items() if shingle_set(t)}
    root, pairs = {k: k for k in sets}, []

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            pairs.append((a, b))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets if find(k) != k}, pairs


def test_signature_is_shifted_permutation():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    rows, k = np.array([0, 10, 10, 40]), 12
    rg = np.random.Generator(np.random.PCG64(minhash.SEED))
    sigma, pi = rg.permutation(minhash.DOMAIN), rg.permutation(minhash.DOMAIN)
    got = minhash.signatures(grams, rows, k)
    for i, j in itertools.product(range(3), range(k)):
        own = [int(pi[(sigma[int(g) % minhash.DOMAIN] + j) % minhash.DOMAIN]) for g in grams[rows[i] : rows[i + 1]]]
        assert got[i, j] == min(own, default=0xFFFFFFFF)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(400 * 2 * share / (1 + share))
        other = np.concatenate([base[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)])
        a, b = minhash.signatures(np.concatenate([base, other]), np.array([0, 400, 800]), 512)
        assert np.mean(a == b) == pytest.approx(n / (800 - n), abs=0.09)


def test_word_hashes_do_not_depend_on_place():
    data, offsets = kernels.string_bytes(pa.array(["a bb ccc", None, "", "bb", " ccc  a\n"]))
    h, rows = kernels.word_hashes(data, offsets)
    assert rows.tolist() == [0, 3, 3, 3, 4, 6] and h[1] == h[3] and h[2] == h[4] and h[0] == h[5] and len(set(h.tolist())) == 3
    long = "word%d " * 1 % 7 + " ".join(f"w{i}" for i in range(60_000))
    data, offsets = kernels.string_bytes(pa.array([long]))
    h, _ = kernels.word_hashes(data, offsets)
    assert len(set(h.tolist())) == 60_001


def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.duplicate_of for r in minhash.query(spark, SF).collect()} == brute(texts)[0]


def morse(a, b, n=4096):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_alike_hashes_are_not_equal_words(spark):
    """Words that polynomial hashes can't tell apart."""
    rows = [(1, "x y z " + morse("a", "b")), (2, "x y z " + morse("b", "a")), (3, "p q " + morse("0", "1", 16)), (4, "p q " + morse("1", "0", 16))]
    assert minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_exact_sets(k):
    rng = np.random.default_rng(k)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, n)) for n in (0, 1, 2, 3, 9, 40, 2, 0, 30)] + ["w1 w2", ""]
    sets, want = minhash.exact_sets([t.encode() for t in texts], k), [shingle_set(t, k) for t in texts]
    for (a, x), (b, y) in itertools.combinations(list(zip(sets, want, strict=True)), 2):
        assert len(np.intersect1d(a, b)) == len(x & y) and len(a) == len(x) and len(b) == len(y)


def test_blocks_lose_no_link(spark):
    """One group with everything in it: chains, copies of the centre and unlike texts, in blocks of 4 and in one."""
    rng, texts = np.random.default_rng(5), {}
    base = [f"b{x}" for x in range(30)]
    for i in range(60):
        mine = list(base) if i % 3 else [f"c{x + i}" for x in range(30)]  # each of the latter overlaps the next ones
        for p in rng.integers(0, 30, i % 5):
            mine[p] = f"r{rng.integers(9)}"
        texts[i] = " ".join(mine)
    member = spark.createDataFrame([(0, i) for i in texts], "centre long, rep long")
    held = spark.createDataFrame(list(texts.items()), "__id long, __text string")
    for block in (4, 256):
        edges = minhash.edges_of(member, held, 3, 0.5, block)
        found = {(r.other_id, r.doc_id) for r in edges.collect()}
        want, pairs = brute(texts)
        assert found <= set(pairs)
        assert {r.node: r.root for r in minhash.components(edges, "doc_id", "other_id").collect()} == want


def test_links_against_all_pairs():
    """Chains, copies, few words and nothing, at thresholds that aren't exact in binary."""
    rng = np.random.default_rng(7)
    for n, words, threshold in itertools.product((1, 2, 30, 120), (6, 25, 200), (0.3, 0.5, 0.7)):
        texts = {int(i): " ".join(f"w{x}" for x in rng.integers(0, words, rng.integers(0, 12))) for i in rng.permutation(n)}
        for i in range(0, n, 3):
            texts[i] = texts[i - i % 5] + f" u{i}"
        ids = list(texts)
        edges, parts = minhash.link(ids, minhash.exact_sets([t.encode() for t in texts.values()], 1), threshold)
        sets = {k: shingle_set(t, 1) for k, t in texts.items()}
        assert all(a > b and s == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold for a, b, s in edges)
        root = {ids[i]: min(ids[j] for j in p) for p in parts for i in p}
        want = {k: k for k in ids}
        for _ in ids:
            for a, b in itertools.combinations(ids, 2):
                if sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
        assert root == want and len(edges) == n - len(parts)


def unlike(n):
    """Texts that share a third of their words and are all below the threshold."""
    rng = np.random.default_rng(2)
    return {i: " ".join([*(f"p{x}" for x in range(12)), *(f"v{x}" for x in rng.integers(0, 10**6, 24))]) for i in range(n)}


def test_unlike_texts_of_a_group_are_not_all_compared(monkeypatch):
    compared, similar = [], minhash.similar
    monkeypatch.setattr(minhash, "similar", lambda *a: compared.append(a) or similar(*a))
    texts = unlike(1500)
    edges, parts = minhash.link(list(texts), minhash.exact_sets([t.encode() for t in texts.values()], 3), 0.5)
    assert not edges and len(parts) == 1500 and len(compared) < 1500


def test_texts_of_a_group_are_not_copied_for_each_block(spark, monkeypatch):
    """A group of a few hundred unlike texts is one block: no text is sent again for pairs of blocks."""
    monkeypatch.setattr(minhash, "_across", None)
    texts = unlike(700)
    texts[700] = texts[699] + " more"
    member = spark.createDataFrame([(0, i, len(t)) for i, t in texts.items()], "centre long, rep long, bytes long")
    edges = minhash.edges_of(member, spark.createDataFrame(list(texts.items()), "__id long, __text string"), 3, 0.5)
    assert [(r.doc_id, r.other_id) for r in edges.collect()] == [(700, 699)]


def test_blocks_cut_by_bytes_lose_no_link(spark):
    texts = unlike(40)
    for i in range(20, 40):
        texts[i] = texts[i - 20 + i % 3] + f" more{i}"
    member = spark.createDataFrame([(0, i, len(t)) for i, t in texts.items()], "centre long, rep long, bytes long")
    held = spark.createDataFrame(list(texts.items()), "__id long, __text string")
    edges = minhash.edges_of(member, held, 3, 0.5, block_bytes=1000)
    assert {r.node: r.root for r in minhash.components(edges, "doc_id", "other_id").collect()} == brute(texts)[0]


def test_planted_copies(spark):
    rng = np.random.default_rng(0)
    rows, near = [], set()
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        for c in range(40 if g == 0 else 5):
            mine = list(words)
            for p in rng.choice(80, 3, replace=False)[: c % 4]:
                mine[p] = "changed"
            rows.append((g * 100 + c, " ".join(mine)))
            near |= {g * 100 + c} if c else set()
    rows += [(5000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for i in range(50)]
    rows += [(6000 + i, "same text again and again") for i in range(300)]
    near |= {6000 + i for i in range(1, 300)}
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got.keys() & near) >= 0.99 * len(near) and got.keys() <= near
    assert all(r.duplicate_of == (6000 if r.doc_id >= 6000 else r.doc_id // 100 * 100) for r in got.values())


def test_awkward_rows(spark):
    got = {r.doc_id: (r.duplicate_of, r.similarity) for r in minhash.near_duplicates(awkward(spark)).collect()}
    assert got == {2: (1, pytest.approx(14 / 15)), 3: (1, 1.0)}
    kept = minhash.stage(spark, awkward(spark), "")
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 10, 11, None, None]))
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.stage(spark, empty(spark), "").count() == 0
    assert len(TEXT.split()) == 16 and len(ROWS) == 14


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 65)} | {101: 100}
