import math

import numpy as np
import pytest

from strandlake.llm import sharding as S


def test_matrix_rows_have_the_given_sums():
    ends, cells = np.array([0, 7, 7, 20, 50]), np.array([10, 5, 0, 35])
    rows = np.array([S.matrix_row(3, ends, cells, p) for p in range(4)])
    assert (rows.sum(0) == cells).all() and (rows.sum(1) == np.diff(ends)).all()


def test_large_hypergeometric_draws_follow_the_law(monkeypatch):
    monkeypatch.setattr(S, "_NUMPY_MOST", 0)
    rng = np.random.default_rng(1)
    x = np.array([S.draw_hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(x.mean() - 6) < 0.15 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert S.draw_hypergeometric(rng, 5, 0, 3) == 3 and S.draw_hypergeometric(rng, 0, 5, 3) == 0


def test_shards_are_exact_and_slots_gapless(spark, odd_docs, no_docs):
    out = S.shard_rows(odd_docs, 5)
    assert set(out.columns) == {*odd_docs.columns, "shard", "slot"}
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.shard_rows(no_docs, 5).count() == 0


def test_every_row_reaches_every_place_alike(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    first = [0] * 4
    for seed in range(24):
        for r in S.shard_rows(t, 4, seed=seed, cell_rows=3).collect():
            if r.id < 10:
                first[r.shard] += 1
    assert all(abs(x - 60) < 6 * math.sqrt(60) for x in first)


def test_other_counts_raise():
    kernel = S._deal(1, np.array([0, 1]), np.array([1]))
    with pytest.raises(Exception):
        list(kernel(iter([])))


def test_small_cells_by_bytes_keep_the_law(spark, odd_docs):
    rows = S.shard_rows(odd_docs, 3, cell_bytes=50).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == odd_docs.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_the_table_is_drawn_exactly():
    """Every 2 x 2 table of the communication matrix comes as often as a uniform shuffle gives it (brute force)."""
    from collections import Counter
    from itertools import permutations

    ends, cells = np.array([0, 2, 5]), np.array([3, 2])
    want = Counter()
    for p in permutations(range(5)):
        want[sum(1 for place in p[:2] if place < 3)] += 1 / 120
    got = Counter(int(S.matrix_row(seed, ends, cells, 0)[0]) for seed in range(3000))
    assert all(abs(got[k] / 3000 - want[k]) < 0.04 for k in want) and set(got) <= set(want)
