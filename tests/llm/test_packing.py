import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandlake.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "İstanbul ΑΣ ὈΔΥΣΣΕΎΣ Σ.", "it's I'LL we're ’s 1234 ½²३ x́é Å", "<|endoftext|> b <|startoftext|>", "a​b c　d", "日本語テスト🙂🙂!!", "a\x1cb \x1f c\x85d e", "x" * 5000, "_x__y 1½²"]


def test_ids_equal_the_tokenizers():
    own, its = P.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for t in ODD:
        assert own.ids(t).tolist() == [*its.encode(t, add_special_tokens=False).ids, P.END]


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    s = P.SumOfSquares(32)
    for _ in range(3000):
        size = int(rng.integers(1, 32))
        level = s.place(size)
        best = []
        for h in range(32 - size + 1):
            if h and not s.open[h]:
                continue
            n = s.open.copy()
            if h:
                n[h] -= 1
            if h + size < 32:
                n[h + size] += 1
            best.append((int((n[1:32] ** 2).sum()), h))
        assert (dict((h, v) for v, h in best))[level] == min(best)[0]
        if level:
            s.take(level)
        s.put(level + size, 0)


def test_packer_places_every_token_once_without_padding():
    rng = np.random.default_rng(1)
    p = P.Packer(64)
    sizes = [int(x) for x in rng.integers(1, 200, 300)]
    for i, n in enumerate(sizes):
        p.add(i, n)
    p.finish()
    spans, windows = {}, {}
    for r, start, n, sequence, offset in p.done:
        spans.setdefault(r, []).append((start, n))
        windows.setdefault(sequence, []).append((offset, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, k in sorted(spans[i]):
            assert start == at
            at += k
        assert at == n
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_documents_round_trip(odd_docs, no_docs):
    its = Tokenizer.from_file(PATH)
    ids = [(r.doc_id, [*its.encode(r.text or "", add_special_tokens=False).ids, P.END]) for r in odd_docs.collect()]
    got = P.pack_documents(odd_docs, PATH).collect()
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    sums = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for r in got for d, x in ids if d == r.doc_id and len(x) == r.doc_tokens}
    assert {r.ids_crc32 for r in got} <= sums
    assert P.pack_documents(no_docs, PATH).count() == 0


def test_memory_is_bounded_by_bytes(monkeypatch):
    its, own = Tokenizer.from_file(PATH), P.WordTokenizer(PATH)
    monkeypatch.setattr(P, "MEMORY_BYTES", 4000)
    for k in range(60):
        text = f"words {k} of many kinds {'q' * (50 + k)} more{k}"
        assert own.ids(text).tolist() == [*its.encode(text, add_special_tokens=False).ids, P.END]
        assert sum(150 + 4 * len(c) + len(b) for c, b in own.known.items()) <= 4000 and all(len(c) <= P.MEMORY_CHUNK for c in own.known)


def test_the_rules_share_grows_with_the_documents():
    rng = np.random.default_rng(5)
    shares = []
    for n in (100, 1000, 10_000):
        p, ruled = P.Packer(256), 0
        for i, size in enumerate(rng.integers(1, 200, n).tolist()):
            p.add(i, size)
        ruled = sum(k[2] for k in p.done)
        p.finish()
        shares.append(ruled / sum(k[2] for k in p.done))
    assert shares[0] < shares[1] < shares[2] and shares[2] > 0.8
