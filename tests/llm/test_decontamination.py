import random

import numpy as np

from strandlake.llm import decontamination as D

WORDS = [f"w{i}" for i in range(400)]


def brute(text, items):
    words = D.words_of(text)
    shingles = D.shingles_of(words)
    found = {}
    for i, (_, item) in enumerate(items):
        s = D.shingles_of(D.words_of(item))
        if not s or not shingles:
            continue
        if len(s[0]) < 5:
            if any(tuple(words[k : k + len(s[0])]) == s[0] for k in range(len(words))):
                found[i] = 1.0
            continue
        size = min(len(s), len(shingles))
        best = max(D.similarity(D.Counter(shingles[k : k + size]), D.Counter(s)) for k in range(len(shingles) - size + 1))
        if best >= 0.8:
            found[i] = best
    return found


def planted():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, text(rng.randint(12, 60))) for i in range(25)] + [(25, "just three words"), (26, None), (28, "just three words"), (29, "w7 w9"), (27, "")]
    docs = []
    for i in range(60):
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            item[rng.randrange(len(item))] = "changed"
        docs.append(f"{text(rng.randint(0, 80))} {' '.join(item).upper()}, {text(rng.randint(0, 80))}")
    return items, [*docs, text(500), "Just three words!", f"{text(40)} just, three words {text(30)}", "", None, "a b"]


def test_windows_against_brute_force():
    items, docs = planted()
    b = D.Benchmark(items)
    known = [(i, t) for i, t in items if D.words_of(t)]
    for t in docs:
        assert {k: round(v[0], 9) for k, v in b.matches(t).items()} == {k: round(v, 9) for k, v in brute(t, known).items()}


def test_multi_index_returns_all_within_the_radius_and_prunes(monkeypatch):
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 32, (600, 4), dtype=np.uint32)
    flips = np.packbits(rng.random((200, 128)) < 0.3, axis=1, bitorder="little").view(np.uint32)
    marks = prints[:200] ^ flips
    far = np.bitwise_count(marks[:, None] ^ prints[None]).sum(2)
    index = D.MultiIndex(prints)
    monkeypatch.setattr(D, "_CELLS", 5000)
    m, e = index.within(marks)
    assert list(zip(m.tolist(), e.tolist())) == [tuple(x) for x in np.argwhere(far <= D.RADIUS).tolist()] and len(m) > 50
    a, b = index.candidates(rng.integers(0, 1 << 32, (400, 4), dtype=np.uint32))
    assert len(a) < 0.12 * 400 * 600


def test_fingerprints_of_similar_windows_stay_within_the_radius():
    """Bits that differ at similarity 0.8, against the radius."""
    rng, bits = random.Random(1), []
    for _ in range(400):
        size = rng.choice([9, 12, 30, 80])
        a = [tuple([f"s{rng.randrange(10**9)}"]) for _ in range(size)]
        b = a[: size - size // 9] + [tuple([f"t{rng.randrange(10**9)}"]) for _ in range(size // 9)]
        assert D.similarity(D.Counter(a), D.Counter(b)) >= 0.8
        x, y = (D.window_prints(D.vote_sums(D.shingle_hashes(t)), np.zeros(1, np.int64), size)[0] for t in (a, b))
        bits.append(int(np.bitwise_count(x ^ y).sum()))
    assert max(bits) <= D.RADIUS and np.mean(bits) < 22


def test_every_window_that_shares_a_shingle_is_fingerprinted(monkeypatch):
    items, docs = planted()
    b, seen = D.Benchmark(items), []
    real = D.window_prints
    monkeypatch.setattr(D, "window_prints", lambda sums, starts, size: seen.append((size, len(starts))) or real(sums, starts, size))
    b.matches(docs[0])
    words = D.words_of(docs[0])
    shingles = D.shingles_of(words)
    want = 0
    for m in b.sizes:
        size = min(m, len(shingles))
        want += sum(any(s in b.known for s in shingles[k : k + size]) for k in range(len(shingles) - size + 1))
    assert sum(n for _, n in seen) == want > 0


def test_items_in_blocks_of_bytes_and_clashing_columns(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "word salad " * 40), (3, "äö straße")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS similarity")
    docs = odd_docs.selectExpr("*", "1 AS item_id", "2 AS similarity")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.find_leaks(docs, bench).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("2", "1"), ("5", "3"), ("6", "3"), ("7", "None")])
    assert D.drop_leaks(docs, bench).columns == docs.columns and D.drop_leaks(docs, bench).count() == docs.count() - 6


def test_documents(spark, odd_docs, no_docs):
    items, texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if D.words_of(t)]
    want = sorted((d, known[k][0]) for d, t in enumerate(texts) for k in brute(t, known))
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == want
    clean = D.drop_leaks(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert D.drop_leaks(odd_docs, bench).count() == odd_docs.count() and D.find_leaks(no_docs, bench).count() == 0
    assert D.drop_leaks(odd_docs, bench.limit(0)).columns == odd_docs.columns


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    items, texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_ITEMS", 6)
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == whole
