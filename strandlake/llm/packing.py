"""Sequence packing by the online sum-of-squares rule.

A task tokenises its documents and packs them as they come. A document longer than a window gives off full windows; what
remains is placed, whole, into the open fill level that minimises the sum over levels of the squared number of partially
filled windows, tracked in an array by level; ties go to the fullest level. When a task's rows end, the windows still
open are topped up by cutting the emptiest ones apart, and the last rest is cut into power-of-two sequences, which need
no padding. The windows closed that way are a number that hardly grows with the task, so the rule's own share grows with
the documents of a task.

Tokens come from a public word-level BPE. Merges never cross its pre-tokens, so a text is split by the tokenizer's own
pattern and each distinct pre-token is encoded once.

Defined cases: a null or empty text is a document of the end token alone; a text of any length is tokenised whole; repeated rows and repeated ids are packed as
separate documents; an empty table gives an empty result; only the id and the text are read, whatever other columns are
called. Sequence ids are unique; they are gapless within a task only.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END = 2
#: Fixed value: the pre-token pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of blank-free chunks and their ids that a worker remembers, and the characters of the longest such chunk.
MEMORY_BYTES = 64 << 20
MEMORY_CHUNK = 64
#: Control characters that str.split takes for blanks and the pattern does not.
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + k) for k in range(256))
    return {b: chr(b) if b in own else next(rest) for b in range(256)}


def _memory(path: str) -> tuple[dict, list[int]]:
    """A dictionary that outlives the task in its worker process, and its bytes."""
    held = sys.modules.setdefault("_strandlake_memory", types.ModuleType("_strandlake_memory"))
    return held.__dict__.setdefault(f"ids of {path}", ({}, [0]))


class WordTokenizer:
    """Ids of whole texts by a tokenizers file, one pre-token at a time; chunks between blanks are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.merge = self.inner.model.tokenize
        self.split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}")).findall
        self.letters = byte_letters()
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.known, self.size = _memory(path)
        self.end = np.array([END], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = []
        for part in self.split(chunk):
            ids += [t.id for t in self.merge(part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode())))]
        return array("I", ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text and the end token, as the tokenizer itself gives them."""
        if any(s in text for s in self.special):
            return np.array([*self.inner.encode(text, add_special_tokens=False).ids, END], "<u4")
        # The file's normaliser: NFC, white space to one blank, lower case letter by letter (so no final sigma).
        low = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if any(c in low for c in _ODD_BLANKS):
            return np.frombuffer(self._chunk(low) + self.end, "<u4")
        chunks, known = low.split(), self.known
        fresh = set(chunks).difference(known)
        for c in fresh:
            known[c] = self._chunk(c)
        ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)) + self.end, "<u4")
        for c in fresh:
            if len(c) > MEMORY_CHUNK:
                del known[c]
            else:
                # A dictionary entry costs about 150 bytes besides the text and its ids.
                self.size[0] += 150 + 4 * len(c) + len(known[c])
        if self.size[0] > MEMORY_BYTES:
            known.clear()
            self.size[0] = 0
        return ids


class SumOfSquares:
    """Open windows by fill level; `place` picks the level by the sum-of-squares rule."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.open = np.zeros(window + 1, np.int64)
        self.stacks: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The fill level (0: a new window) whose choice adds least to the sum of squares; ties go to the fullest."""
        w, n = self.window, self.open
        last = w - size
        # Moving a window from h to h + size changes n[h]^2 + n[h+size]^2; levels 0 and w don't count.
        gain = 2 * n[size : w + 1] + 1
        gain[last] = 0
        cost = gain - 2 * n[: last + 1] + 1
        cost[0] = gain[0]
        cost[1:][n[1 : last + 1] == 0] = 1 << 40
        return last - int(np.argmin(cost[::-1]))

    def put(self, level: int, sequence: int) -> None:
        if level < self.window:
            self.open[level] += 1
            self.stacks.setdefault(level, []).append(sequence)

    def take(self, level: int) -> int:
        self.open[level] -= 1
        return self.stacks[level].pop()


class Packer:
    """Packs the documents of one task; pieces are [row, start, length, sequence, offset]."""

    def __init__(self, window: int = WINDOW):
        self.window, self.levels, self.n_sequences = window, SumOfSquares(window), 0
        self.held: dict[int, list[list[int]]] = {}
        self.done: list[list[int]] = []

    def _new(self) -> int:
        self.n_sequences += 1
        return self.n_sequences - 1

    def add(self, row: int, size: int) -> None:
        """Pack a document of `size` tokens; finished windows' pieces appear in `done`."""
        start = 0
        while size - start >= self.window:
            self.done.append([row, start, self.window, self._new(), 0])
            start += self.window
        if start == size:
            return
        n = size - start
        level = self.levels.place(n)
        sequence = self.levels.take(level) if level else self._new()
        pieces = self.held.setdefault(sequence, [])
        pieces.append([row, start, n, sequence, level])
        if level + n == self.window:
            self.done += self.held.pop(sequence)
        else:
            self.levels.put(level + n, sequence)

    def finish(self) -> None:
        """Close the open windows: the emptiest are cut up to fill the fullest; the rest ends in powers of two."""
        order = sorted((sum(p[2] for p in pieces), s) for s, pieces in self.held.items())
        filled = {s: n for n, s in order}
        low, high = 0, len(order) - 1
        while low < high:
            donor, target = order[low][1], order[high][1]
            pieces = self.held[donor]
            room = self.window - filled[target]
            if not room or not pieces:
                high, low = high - (not room), low + (not pieces)
                continue
            row, start, n, _, _ = pieces.pop()
            n_moved = min(n, room)
            if n > n_moved:
                pieces.append([row, start, n - n_moved, donor, 0])
            self.held[target].append([row, start + n - n_moved, n_moved, target, 0])
            filled[target] += n_moved
            filled[donor] -= n_moved
        for _, s in order:
            pieces, total = self.held.pop(s), filled[s]
            if total and total < self.window and low < len(order) and s == order[low][1]:
                self._powers(pieces, total)
                continue
            at = 0
            for p in pieces:
                p[4] = at
                at += p[2]
            self.done += pieces
        self.levels = SumOfSquares(self.window)

    def _powers(self, pieces: list[list[int]], total: int) -> None:
        rest = [list(p) for p in pieces]
        for bit in range(total.bit_length() - 1, -1, -1):
            size = total & 1 << bit
            if not size:
                continue
            sequence, at = self._new(), 0
            while at < size:
                row, start, n, _, _ = rest[0]
                k = min(n, size - at)
                self.done.append([row, start, k, sequence, at])
                at += k
                if k == n:
                    rest.pop(0)
                else:
                    rest[0] = [row, start + k, n - k, 0, 0]


_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(path: str, window: int):
    """Kernel over (id, text). Ids stay, as bytes, until their piece is closed; then only the digest is kept."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        tokenizer, packer = WordTokenizer(path), Packer(window)
        tokens: dict[int, tuple] = {}
        row = 0

        def close():
            rows = []
            for r, start, n, sequence, offset in packer.done:
                doc_id, ids = tokens[r][:2]
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + sequence, offset))
                tokens[r][2] -= n
                if tokens[r][2] == 0:
                    del tokens[r]
            packer.done = []
            return rows

        out = []
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(doc_ids):
                ids = tokenizer.ids(texts[i].as_py() or "")
                tokens[row] = [doc_id, ids, len(ids)]
                packer.add(row, len(ids))
                row += 1
                out += close()
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        packer.finish()
        out += close()
        if out:
            yield _batch(out)

    return run


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(_FIELDS))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs its own rows; a task's rest is less than one window and is not padded, so tasks need not meet.
    """
    pairs = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return pairs.mapInArrow(_pack(tokenizer_path, window), ", ".join(f"{f} long" for f in _FIELDS))
