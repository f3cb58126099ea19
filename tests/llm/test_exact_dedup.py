import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm.exact_dedup import RadixTrie, SpillingTrie, drop_exact_copies, exact_copies


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12)))
def test_trie_holds_exactly_its_keys(keys):
    trie = RadixTrie()
    for k in keys:
        node = trie.terminal(k)
        node.value = (node.value or 0) + 1
    assert dict(trie.items()) == {k: keys.count(k) for k in keys}


def test_trie_spills_subtrees_into_few_files_and_loses_nothing(tmp_path):
    rng = random.Random(1)
    heads = [bytes(rng.choices(b"abc", k=30)) for _ in range(6)]
    keys = [rng.choice(heads) + bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(6000)] + [b"", b"", b"z" * 300_000]
    tries = SpillingTrie(lambda a, b: a + b, 200_000, str(tmp_path / "spill"))
    for k in keys:
        tries.add(k, 1)
    n_files = len(list((tmp_path / "spill").iterdir()))
    assert 2 <= n_files <= 60 and all(not a.startswith(b) for a in tries.files for b in tries.files if a != b)
    found = defaultdict(int)
    for k, v in tries.drain():
        assert k not in found
        found[k] += v
    assert dict(found) == {k: keys.count(k) for k in set(keys)}
    assert not list((tmp_path / "spill").iterdir())


def test_an_owner_holds_many_texts_in_one_trie(spark, tmp_path, monkeypatch):
    """Owners are partitions by length and content; texts of one share their prefixes in its trie."""
    from strandlake.llm import exact_dedup as E

    rows = [(i, f"a common beginning of every text {i % 700}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    got = exact_copies(spark.read.parquet(str(tmp_path / "d")), budget=40_000).collect()
    want = {i: max(j for j, _ in rows if j % 700 == i % 700) for i, _ in rows}
    assert {r.doc_id: r.keep_id for r in got} == want and sum(r.kept for r in got) == 700


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "x", 5, 6, 7, 8), (2, "X", 5, 6, 7, 8), (3, "y", 5, 6, 7, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, best_tag long, __tag long, __kept long, __TAG_ long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[2]]


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    return lower, groups


def test_copies_against_brute_force(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    lower, groups = brute(rows)
    got = exact_copies(odd_docs).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(r["doc_id"]), str(max((i for i in groups[lower(r["text"])] if i is not None), default=None)), len(groups[lower(r["text"])]), hashlib.sha256(lower(r["text"]).encode()).hexdigest())
        for r in rows
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_small_budget_gives_the_same(odd_docs):
    key = lambda r: (str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256, r.kept)
    a, b = exact_copies(odd_docs).collect(), exact_copies(odd_docs, budget=600).collect()
    assert [k[:4] for k in sorted(map(key, a))] == [k[:4] for k in sorted(map(key, b))]
    assert sum(r.kept for r in b) == sum(r.kept for r in a)


def test_drop_keeps_one_row_of_each_group_and_all_columns(odd_docs, no_docs):
    rows = odd_docs.collect()
    lower, groups = brute(rows)
    kept = drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(lower(r["text"]) for r in kept.collect()) == sorted(groups)
    assert drop_exact_copies(no_docs).count() == 0 and exact_copies(no_docs).count() == 0
    smallest = {lower(r["text"]): r["doc_id"] for r in drop_exact_copies(odd_docs, keep="min").collect()}
    assert smallest["hello world one two three four five six"] == 1
