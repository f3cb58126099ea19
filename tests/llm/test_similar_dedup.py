import random

import numpy as np

import corpus_pipeline as P
from strandlake.llm import similar_dedup as S


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a | b else True


def brute_kept(rows):
    """Ids that stay: the smallest of each component of pairs of similarity 0.8."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up[root(i)] = root(j)
    return sorted({min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))})


def planted(seed=8):
    """Texts, and copies of each with some words changed: similarities from 0.4 to 1."""
    rng = random.Random(seed)
    rows = []
    for _ in range(90):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        rows.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            rows.append("  ".join(copy))
    return list(enumerate(rows))


def test_the_stage_drops_what_brute_force_drops(spark, tmp_path):
    rows = [*planted(), (9000, None), (9001, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == brute_kept(rows)


def test_large_cells_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    monkeypatch.setattr(S, "BLOCK_ROWS", 11)
    monkeypatch.setattr(S, "_SERVED", 3)
    monkeypatch.setattr(S, "BROADCAST_TAGS", 2)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    hot = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(150)] = f"y{i}"
        hot.append((5000 + i, " ".join(copy)))
    rows = planted(5) + hot
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(r.doc_id for r in S.drop_similar(docs).collect()) == brute_kept(rows)


def test_odd_rows(odd_docs, no_docs):
    kept = S.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns and S.drop_similar(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "5", "6", "7", "9", "None"])


def test_wide_fingerprint_counts_bits():
    hashes = S.shingle_set(b"one two three four five six seven eight nine ten")
    words = S.wide_fingerprint(hashes)
    assert int(words[0]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in hashes) > len(hashes))
    assert len(set(words.tolist())) == 8 and not S.wide_fingerprint(np.zeros(0, np.uint64)).any()
    assert S.jaccard(hashes, hashes[:5]) == 5 / 6 and S.jaccard(np.zeros(0), np.zeros(0)) == 1


def test_similar_sets_stay_within_the_radii():
    rng, narrow, wide = np.random.default_rng(3), [], []
    for _ in range(3000):
        shared = int(rng.integers(32, 400))
        a, b = (int(x) for x in rng.multinomial(shared // 4, [0.5, 0.5]))
        x = rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, shared + a + b).astype(np.uint64)
        one, two = S.wide_fingerprint(x[: shared + a]), S.wide_fingerprint(np.concatenate([x[:shared], x[shared + a :]]))
        bits = np.bitwise_count(one ^ two)
        narrow.append(int(bits[:2].sum()))
        wide.append(int(bits.sum()))
    assert max(narrow) <= S.RADIUS and max(wide) <= S.WIDE_RADIUS - 4
    assert abs(np.mean(wide) - 78) < 3 and np.std(wide) < 9


def test_a_shared_passage_links_nothing_and_hides_nothing(spark, tmp_path, monkeypatch):
    """Every text holds one long passage, so its shingles are large cells; short ends differ or nearly agree."""
    monkeypatch.setattr(S, "CELL_ROWS", 16)
    rng, passage, rows = random.Random(4), " ".join(f"p{k}" for k in range(60)), []
    for i in range(60):
        end = [f"e{rng.randrange(10**6)}" for _ in range(rng.choice([4, 30, 120]))]
        rows.append((len(rows), f"{passage} {' '.join(end)}"))
        if i % 3 == 0:
            rows.append((len(rows), f"{passage} {' '.join(end[:-1])} other"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(r.doc_id for r in S.drop_similar(docs).collect()) == brute_kept(rows)


def test_the_tree_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    flips = np.packbits(rng.random((900, 128)) < 0.06, axis=1, bitorder="little").view(np.uint64)
    points = base[rng.integers(0, 40, 900)] ^ flips
    hi, lo, asks = points[:, 0], points[:, 1], rng.random(900) < 0.5
    got = set()
    for i, j in S.tree_pairs(hi, lo, asks, 14):
        got |= set(zip(i.tolist(), j.tolist()))
    far = S.distance(hi[:, None], lo[:, None], hi, lo)
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(far <= 14))) if asks[i]}
    assert got == want


def test_similarities_equal_the_pairwise_ones():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in (0, 0, 1, 20, 60, 60, 200)]
    got = S.similarities(sets[:4], sets, width=7)
    assert np.allclose(got, [[S.jaccard(a, b) for b in sets] for a in sets[:4]])


def test_a_loose_family_in_large_cells(spark, tmp_path, monkeypatch):
    """Copies of one text, each about 0.6 to 0.9 like the others: no pivot reaches all, most rows ask."""
    monkeypatch.setattr(S, "CELL_ROWS", 10)
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    rng, base, rows = random.Random(12), [f"w{k}" for k in range(120)], []
    for i in range(110):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert sorted(r.doc_id for r in S.drop_similar(docs).collect()) == brute_kept(rows)


def test_a_long_chain_is_one_component(spark):
    from strandlake.llm.common import min_label_components

    n = 400
    rows = [(k * 7919 % n, f"c{k}") for k in range(n)] + [((k + 1) * 7919 % n, f"c{k}") for k in range(n - 1)] + [(1000, "x"), (1001, "x"), (2000, "y")]
    got = {r.node: r.label for r in min_label_components(spark.createDataFrame(rows, "node long, cell string")).collect()}
    assert got == {**{k: 0 for k in range(n)}, 1000: 1000, 1001: 1000, 2000: 2000}


def test_components_of_pairs_equal_those_of_memberships(spark):
    """Chains, stars, loops and repeated links: the same labels, and no row for what only meets itself."""
    from strandlake.llm.common import min_label_components, pair_components

    rng = random.Random(6)
    links = [(k * 7919 % 400, (k + 1) * 7919 % 400) for k in range(399)]
    links += [(1000 + 3 * k, 2999) for k in range(300)] + [(3000 + rng.randrange(500), 3000 + rng.randrange(500)) for _ in range(260)]
    links += links[:5] + [(b, a) for a, b in links[400:420]] + [(9000, 9000)]
    pairs = spark.createDataFrame(links, "a long, b long")
    members = [(x, f"{i}") for i, link in enumerate(links) if link[0] != link[1] for x in link]
    want = {r.node: r.label for r in min_label_components(spark.createDataFrame(members, "node long, cell string")).collect()}
    got = pair_components(pairs).collect()
    assert len(got) == len(want) and {r.node: r.label for r in got} == want
    assert pair_components(pairs.limit(0)).collect() == []


def test_scratch_tables_are_written_in_small_batches(spark):
    """Texts of 40 MB in all reach the worker in batches of about 8 MB, and the session's setting comes back."""
    import pyarrow as pa

    from strandlake.llm.common import BATCH_BYTES, materialise, trimmed

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 10000) AS text")
    got = [r.n for r in materialise(texts.mapInArrow(trimmed(sizes), "n long"), "sizes").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 1.5 * BATCH_BYTES and spark.conf.get(key) == before
