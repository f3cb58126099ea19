import numpy as np
import pytest
import xxhash

from strandlake.llm import simhash_dedup as N
from strandlake.llm.common import lookup_groups, min_label_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_bit_counting():
    for t in ("", "a", "a b", "a b c", "The quick brown fox jumps over the lazy dog", "x " * 500, "é ü ö ß"):
        assert N.fingerprint(t.encode()) == brute_fingerprint(t)


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, n // 3), dtype=np.uint64)
    return np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1] ^ flips[2]]))


def brute_groups(points, radius=3):
    g = N.Groups(len(points))
    for i in range(len(points)):
        j = np.nonzero(np.bitwise_count(points ^ points[i]) <= radius)[0]
        g.link(np.full(len(j), i), j)
    return g.roots()


def test_local_tree_links_what_brute_force_links():
    p = clustered(1500)
    assert (N.link_shard(p, np.ones(len(p), bool), 3) == brute_groups(p)).all()


def test_every_pair_within_the_radius_meets_in_a_shard():
    p = clustered(900)
    tree = N.shard_tree(p, 12)
    home, reached = np.zeros(len(p), int), [set() for _ in p]
    for shard, at, lives in N.route(tree, p, 3):
        home[at[lives]] = shard
        for i in at:
            reached[i].add(shard)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p ^ p[i]) <= 3)[0]:
            assert home[j] in reached[i]


@pytest.mark.parametrize("visitors", [1 << 20, 25])
def test_components_over_many_shards(spark, monkeypatch, visitors):
    monkeypatch.setattr(N, "LEAST_ROWS", 60)
    monkeypatch.setattr(N, "VISITORS", visitors)
    p = clustered(900)
    df = spark.createDataFrame([(int(x.astype(np.int64)),) for x in p], "fp long")
    labels = {r.node: r.label for r in min_label_components(N.fingerprint_links(df, len(p), 3)).collect()}
    root = brute_groups(p)
    signed = p.astype(np.int64)
    for i, x in enumerate(signed):
        want = signed[root == root[i]].min()
        assert labels.get(int(x), int(x)) == want


def test_chains_and_hot_cells_settle(spark):
    rows = [(i, f"c{i}") for i in range(30)] + [(i + 1, f"c{i}") for i in range(30)] + [(1000 + i, "hot") for i in range(500)]
    got = {r.node: r.label for r in min_label_components(spark.createDataFrame(rows, "node long, cell string")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[1000 + i] == 1000 for i in range(500))


def test_lookup_covers_hot_and_cold_groups(spark):
    rows = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (3, "zz")], "x int, k string")
    groups = spark.createDataFrame([("a", 50, 7), ("b", 1, 8)], "k string, n int, v int")
    got = sorted((r.k, r.v) for r in lookup_groups(rows, groups, "k", "n", 2000).collect())
    assert got == [("a", 7)] * 50 + [("b", 8), ("zz", None)]


def test_documents(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = N.near_copies(odd_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{brute_fingerprint(r.text):016x}") for r in rows)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    kept = N.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({(r.component_id, r.fingerprint if r.component_id is None else "") for r in got})
    assert N.near_copies(no_docs).count() == 0 and N.drop_near_copies(no_docs).count() == 0
