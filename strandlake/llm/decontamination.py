"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item of m word shingles is compared with each run of m shingles of a document (the whole document where
it is shorter). A window that shares no shingle with any item has similarity 0 to all of them; every other window gets a
SimHash of 128 bits, which a multi-index of the items of that size answers: fingerprints are cut into blocks, and block
radii that sum to radius - blocks + 1 guarantee that a fingerprint within the radius lies within its block's radius in
one block at least. Candidates are verified by the exact similarity of the two multisets of shingles: sum of least
counts over sum of greatest counts. At similarity 0.8 about 19 bits differ, with a deviation of 4, so the radius of 40
passes over no similar window but for a chance below one in a million.

An item of fewer words than a shingle is one shingle of its own width, and found wherever those words stand.

Items go to the tasks in blocks of at most BLOCK_ITEMS items and about BLOCK_BYTES bytes, a bounded query set against all
rows. Defined cases: null or empty texts and items match nothing; documents of fewer words than a shingle form one
shingle of all their words; texts of any length are searched whole; of equally similar windows the first is reported;
repeated rows and items match alike; nulls in ids are carried; input columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import trimmed

WIDTH = 5
SIMILARITY = 0.8
#: Bits, of 128, by which fingerprints of similar windows may differ, and the blocks of the index.
RADIUS = 40
BLOCKS = 4
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20
#: Cells of a table that a look-up holds at a time.
_CELLS = 1 << 21
_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORDS(text.lower()) if text else []


def shingles_of(words: list[str], width: int = WIDTH) -> list[tuple]:
    """Runs of `width` words; all the words as one shingle where there are fewer."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    least = sum(min(n, b[k]) for k, n in a.items() if k in b)
    most = sum(a.values()) + sum(b.values()) - least
    return least / most if most else 0.0


def shingle_hashes(shingles: list[tuple]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(" ".join(s).encode()) for s in shingles), np.uint64, len(shingles))


def vote_sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of each of 128 bits: those of the hashes, and those of the hashes mixed."""
    x = hashes.copy()
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, x ^ (x >> np.uint64(31))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def window_prints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash, as a row of four 32-bit blocks, of hashes[s : s + size] for every start: sign of the summed bit votes."""
    votes = (sums[starts + size] - sums[starts]) * 2 > size
    return np.packbits(votes, axis=1, bitorder="little").view(np.uint32)


class MultiIndex:
    """Fingerprints by block values; `within` finds every entry within the radius of each mark."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        n = prints.shape[1]
        # If every block differed by more than its radius, the whole would differ by more than radius bits.
        most = max(radius - n + 1, 0)
        self.near = [most // n + (b < most % n) for b in range(n)]
        # Of each block: its distinct values, and the entries that hold each.
        self.tables = []
        for b in range(n):
            values, at = np.unique(prints[:, b], return_inverse=True)
            self.tables.append((values, np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))])))

    def candidates(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (mark, entry) that are near in one block at least."""
        codes = []
        for b, (values, entry, ends) in enumerate(self.tables):
            m, v = np.nonzero(np.bitwise_count(marks[:, b, None] ^ values) <= self.near[b])
            times = ends[v + 1] - ends[v]
            offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            codes.append(np.repeat(m, times) * len(self.prints) + entry[np.repeat(ends[v], times) + offset])
        found = np.unique(np.concatenate(codes))
        return found // len(self.prints), found % len(self.prints)

    def within(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mark, entry) of every pair within the radius, in order."""
        step, out = max(1, _CELLS // len(self.prints)), []
        for i in range(0, len(marks), step):
            m, e = self.candidates(marks[i : i + step])
            keep = np.bitwise_count(marks[i + m] ^ self.prints[e]).sum(1) <= self.radius
            out.append((i + m[keep], e[keep]))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


_MARKS = 24


def _mix(codes: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A number below 2 ** _MARKS for each run of `width` word codes, and whether all its codes are known ones."""
    mixed, live = codes[:n].copy(), codes[:n] > 0
    for k in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        live &= codes[k : k + n] > 0
    return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _MARKS), live


class Benchmark:
    """The items of one block, indexed."""

    def __init__(self, items: list[tuple[int, str]], least: float = SIMILARITY, width: int = WIDTH):
        self.least, self.width = least, width
        self.items: list[tuple[int, Counter]] = []
        self.vocabulary: dict[str, int] = {}
        self.known: set = set()
        #: Items of fewer words than a shingle: width -> words -> positions of items.
        self.short: dict[int, dict[tuple, list[int]]] = {}
        self.marked = np.zeros(1 << _MARKS, bool)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles = shingles_of(words, width)
            if len(words) < width:
                self.short.setdefault(len(words), {}).setdefault(shingles[0], []).append(len(self.items))
            else:
                sums = vote_sums(shingle_hashes(shingles))
                by_size.setdefault(len(shingles), []).append((len(self.items), window_prints(sums, np.zeros(1, np.int64), len(shingles))[0]))
                self.known.update(shingles)
                codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
                self.marked[_mix(codes, len(shingles), width)[0]] = True
            self.items.append((item_id, Counter(shingles)))
        self.sizes = {m: ([i for i, _ in some], MultiIndex(np.array([p for _, p in some]))) for m, some in sorted(by_size.items())}

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """Items that the text holds: position of the item -> (similarity, first word of the best window, bits)."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for k, table in self.short.items():
            for s in range(len(words) - k + 1):
                for i in table.get(tuple(words[s : s + k]), ()):
                    best.setdefault(i, (1.0, s, 0))
        if len(words) < self.width or not self.sizes:
            return best
        n = len(words) - self.width + 1
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        # A shingle can only be an item's if all its words are some item's and its mixed code is marked.
        mixed, live = _mix(codes, n, self.width)
        hit = np.zeros(n + 1, np.int64)
        for p in np.nonzero(live & self.marked[mixed])[0].tolist():
            hit[p + 1] = tuple(words[p : p + self.width]) in self.known
        if not hit.any():
            return best
        held, at = np.cumsum(hit), np.nonzero(hit)[0] - 1
        shingles, most = shingles_of(words, self.width), min(max(self.sizes), n)
        # Stretches of the document whose windows may hold a hit; their votes are summed once for all sizes.
        for near in np.split(at, np.nonzero(np.diff(at) > 2 * most)[0] + 1):
            low, high = max(int(near[0]) - most + 1, 0), min(int(near[-1]) + most, n)
            sums = vote_sums(shingle_hashes(shingles[low:high]))
            for m, (members, index) in self.sizes.items():
                size = min(m, n)
                starts = np.arange(low, high - size + 1)
                starts = starts[held[starts + size] > held[starts]]
                marks = window_prints(sums, starts - low, size)
                held_by: dict[int, Counter] = {}
                for w, j in zip(*(x.tolist() for x in index.within(marks))):
                    s, i = int(starts[w]), members[j]
                    if w not in held_by:
                        held_by[w] = Counter(shingles[s : s + size])
                    value = similarity(held_by[w], self.items[i][1])
                    if value >= self.least and (i not in best or value > best[i][0]):
                        best[i] = (value, s, int(np.bitwise_count(index.prints[j] ^ marks[w]).sum()))
        return best


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The items in bounded lists."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col))
    sizes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    parts = max(1, -(-sizes[0] // BLOCK_ITEMS), -(-sizes[1] // BLOCK_BYTES))
    for p in range(parts):
        some = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64(text_col, id_col), F.lit(parts)) == p)
        yield sorted(((r[0], r[1]) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _find(items, least: float, width: int):
    def run(batches):
        benchmark = Benchmark(items, least, width)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for i, doc_id in enumerate(ids):
                for k, (value, start, bits) in benchmark.matches(texts[i].as_py()).items():
                    rows.append((doc_id, benchmark.items[k][0], value, start, bits))
            if rows:
                d, b, v, s, h = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float64()), pa.array(s, pa.int64()), pa.array(h, pa.int32())],
                    names=["doc_id", "item_id", "similarity", "start_word", "hamming"],
                )

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, start_word, hamming (of the best window)."""
    pairs = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    out = None
    for block in _blocks(items, item_col, item_text):
        found = pairs.mapInArrow(_find(block, least, width), "doc_id long, item_id long, similarity double, start_word long, hamming int")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(items, text_at: int, least: float, width: int):
    def run(batches):
        benchmark = Benchmark(items, least, width)
        for batch in batches:
            texts = batch.column(text_at)
            yield batch.filter(pa.array([not benchmark.matches(texts[i].as_py()) for i in range(batch.num_rows)], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` that hold no item, columns as they were."""
    for block in _blocks(items, item_col, item_text):
        docs = docs.mapInArrow(trimmed(_clean(block, docs.columns.index(text_col), least, width)), docs.schema)
    return docs
