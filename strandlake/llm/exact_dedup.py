"""Exact deduplication by Patricia-trie owners.

Every input task first folds its own rows into a compressed radix trie, so a text leaves the task once however often it
occurs there. The folded texts go to owners by a hash of length and content; an owner inserts the full byte strings of
its partition into one radix trie, whose terminal nodes hold the row that stays, the count, and one number for each
input task that sent the text. A trie that outgrows its budget spills whole subtrees to files in the shared folder (never
a machine's own), finishes them one at a time in the end, and removes the files.

Defined cases: a null text counts as empty; texts of any length are kept whole (one beyond the budget is held alone); a
null id ranks below every other id; repeated rows (same id and text) are rows of one group, of which exactly one is
kept, as of rows that tie on the id: the last in the scan; an empty table gives an empty result; input columns may have
any name, since the operators work under their own names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import struct
import uuid
from array import array

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import scratch_path, spare_name, trimmed

#: Bytes of text that one task's trie may hold before it spills subtrees.
TRIE_BYTES = 96 << 20
_NO_ID = -(1 << 63)


class Node:
    """A radix-trie node: the bytes on its incoming edge, its children by first byte, and a terminal's value."""

    __slots__ = ("kids", "label", "value")

    def __init__(self, label: bytes, value=None, kids=None):
        self.label, self.value, self.kids = label, value, kids


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTrie:
    """A compressed radix trie over byte strings."""

    def __init__(self, root: Node | None = None):
        self.root = root or Node(b"")

    def terminal(self, key: bytes) -> Node:
        """The node that ends `key`, made if absent (its value is then None)."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                return node
            kids = node.kids
            child = kids.get(key[at]) if kids else None
            if child is None:
                child = Node(key[at:])
                if kids is None:
                    node.kids = kids = {}
                kids[key[at]] = child
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = shared_prefix(label, key[at : at + len(label)])
            fork = Node(label[:n])
            child.label = label[n:]
            fork.kids = {child.label[0]: child}
            kids[key[at]] = fork
            node, at = fork, at + n

    def items(self):
        """(key, value) of every terminal."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            if node.kids:
                stack.extend((kid, prefix) for kid in node.kids.values())


class SpillingTrie:
    """A radix trie under a byte budget; `merge(old, new)` combines values of equal keys.

    Beyond the budget the heaviest subtrees move to files below `folder`, a path or URI that PyArrow can open. Keys that
    come later below a spilled prefix are kept, and spilled again if need be; `drain` rebuilds each spilled prefix alone,
    in a trie of its own that may spill deeper subtrees in turn.
    """

    def __init__(self, merge, budget: int, folder: str):
        self.merge, self.budget, self.folder = merge, budget, folder
        self.trie, self.held, self.n = RadixTrie(), 0, 0
        self.files: dict[bytes, list[str]] = {}

    def add(self, key: bytes, value) -> None:
        node = self.trie.terminal(key)
        if node.value is not None:
            node.value = self.merge(node.value, value)
            return
        node.value = value
        self.held += len(key) + 400
        self.n += 1
        if self.held > self.budget and self.n > 1:
            self._spill()

    def _subtrees(self, most: int):
        """(size, prefix, parent, node) of the subtrees below the root, descending while they hold more than `most` bytes."""
        order, sizes = [self.trie.root], {}
        for node in order:
            order.extend(node.kids.values() if node.kids else ())
        for node in reversed(order):
            own = 400 if node.value is not None else 0
            sizes[id(node)] = own + len(node.label) + sum(sizes[id(k)] for k in (node.kids or {}).values())
        stack = [(self.trie.root, b"")]
        while stack:
            node, prefix = stack.pop()
            for kid in (node.kids or {}).values():
                if sizes[id(kid)] > most and kid.kids:
                    stack.append((kid, prefix + kid.label))
                else:
                    yield sizes[id(kid)], prefix + kid.label, node, kid

    def _spill(self) -> None:
        for _, prefix, parent, node in sorted(self._subtrees(self.budget // 4), key=lambda x: -x[0]):
            if self.held <= self.budget // 2:
                return
            items = list(RadixTrie(Node(prefix, node.value, node.kids)).items())
            del parent.kids[node.label[0]]
            self.held -= sum(len(k) + 400 for k, _ in items)
            self.n -= len(items)
            # Spilled prefixes stay disjoint: an older shorter one takes the file, older longer ones join this one.
            above = [p for p in self.files if prefix.startswith(p)]
            below = [p for p in self.files if p.startswith(prefix) and p != prefix]
            known = self.files.setdefault(above[0] if above else prefix, [])
            for p in below:
                known += self.files.pop(p)
            known.append(self._write(items))

    def _write(self, items: list) -> str:
        store, root = open_store(self.folder)
        store.create_dir(root)
        path = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(path) as out:
            for i in range(0, len(items), 256):
                frame = pickle.dumps(items[i : i + 256])
                out.write(struct.pack("<Q", len(frame)) + frame)
        return path

    def drain(self):
        """(key, value) of everything added, spilled subtrees last; their files go."""
        late: dict[bytes, list] = {p: [] for p in self.files}
        for key, value in self.trie.items():
            below = next((p for p in late if key.startswith(p)), None) if late else None
            if below is None:
                yield key, value
            else:
                late[below].append((key, value))
        self.trie, self.held, self.n = RadixTrie(), 0, 0
        store = open_store(self.folder)[0] if self.files else None
        while self.files:
            prefix, paths = self.files.popitem()
            inner = SpillingTrie(self.merge, self.budget, self.folder)
            for key, value in late.pop(prefix):
                inner.add(key, value)
            for path in paths:
                with store.open_input_file(path) as f:
                    while head := f.read(8):
                        for key, value in pickle.loads(f.read(struct.unpack("<Q", head)[0])):
                            inner.add(key, value)
                store.delete_file(path)
            yield from inner.drain()


def open_store(folder: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def content_slot(text: bytes) -> int:
    """Signed 64-bit hash of length and content: what decides the owner and the slot."""
    n = xxhash.xxh64_intdigest(text, len(text) & 0xFFFFFFFF)
    return n - (1 << 64) if n >= 1 << 63 else n


def _fold(sign: int, with_text: bool, budget: int):
    """Kernel over (id, text): with_text, the folded texts of a task; else a light row for each input row.

    `tag` numbers the rows of the job; `rep` is the tag under which the task sent out the row's text.
    """

    def run(batches):
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 33
        trie, held = RadixTrie(), 0

        def flush():
            rows = []
            for text, (rep, best, best_tag, n) in trie.items():
                rows.append((rep, content_slot(text), text, best, best_tag, n))
                if len(rows) == 512:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows):
            types = (pa.int64(), pa.int64(), pa.large_binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["rep", "slot", "body", "best_id", "best_tag", "n"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            light = []
            for i, row_id in enumerate(ids):
                body = (texts[i].as_py() or b"").lower()
                rank = _NO_ID if row_id is None else sign * row_id
                if held and held + len(body) > budget:
                    # The budget of a task's own trie is spent: what it holds goes out and folding starts afresh.
                    if with_text:
                        yield from flush()
                    trie, held = RadixTrie(), 0
                node = trie.terminal(body)
                if node.value is None:
                    node.value = (tag, rank, tag, 1)
                    held += len(body) + 400
                else:
                    rep, best, best_tag, n = node.value
                    node.value = (rep, *max((best, best_tag), (rank, tag)), n + 1)
                if not with_text:
                    light.append((tag, node.value[0], hashlib.sha256(body).digest()))
                tag += 1
            if light:
                tags, reps, shas = zip(*light)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tags, pa.int64()), pa.array(reps, pa.int64()), pa.array(ids, pa.int64()), pa.array(shas, pa.binary())],
                    names=["tag", "rep", "id", "sha"],
                )
        if with_text:
            yield from flush()

    return run


def _own(budget: int, folder: str):
    """Kernel of an owner: full byte strings into one radix trie; a row out for each folded text in."""

    def merge(a, b):
        a[0], a[1] = max((a[0], a[1]), (b[0], b[1]))
        a[2] += b[2]
        a[3].extend(b[3])
        return a

    def run(batches):
        trie = SpillingTrie(merge, budget, folder)
        for batch in batches:
            rep, body, best, best_tag, n = (batch.column(k) for k in ("rep", "body", "best_id", "best_tag", "n"))
            for i in range(batch.num_rows):
                trie.add(body[i].as_py(), [best[i].as_py(), best_tag[i].as_py(), n[i].as_py(), array("q", [rep[i].as_py()])])
        out = []
        for _, (best, best_tag, n, reps) in trie.drain():
            out += [(r, best, best_tag, n) for r in reps]
            if len(out) >= 4096:
                yield _owned_batch(out)
                out = []
        if out:
            yield _owned_batch(out)

    return run


def _owned_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rep", "best_id", "best_tag", "n"])


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))


def _owners(pairs: DataFrame, sign: int, budget: int) -> DataFrame:
    folded = pairs.mapInArrow(trimmed(_fold(sign, True, budget)), "rep long, slot long, body binary, best_id long, best_tag long, n long")
    folder = scratch_path(pairs.sparkSession, "subtrees")
    return folded.repartition("slot").mapInArrow(trimmed(_own(budget, folder)), "rep long, best_id long, best_tag long, n long")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, texts being equal up to the case of A-Z.

    keep: "max" or "min", which id of a group stays. `docs` is scanned twice and must give the same rows in the same
    order each time, as a table read from files does.
    """
    sign = {"max": 1, "min": -1}[keep]
    pairs = _input(docs, id_col, text_col)
    light = pairs.mapInArrow(trimmed(_fold(sign, False, budget)), "tag long, rep long, id long, sha binary")
    owned = _owners(pairs, sign, budget)
    return light.join(owned, "rep").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("best_id") != _NO_ID, F.col("best_id") * sign).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("best_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with their columns as they were: one row of each group of equal texts.

    A row's number is its place in the scan, which both the owners and the final semi join use, so `docs` must give the
    same rows in the same order each time. No column of `docs` clashes with the operator's own.
    """
    sign = {"max": 1, "min": -1}[keep]
    tag, kept_tag = spare_name(docs, "__tag"), spare_name(docs, "__kept")
    kept = _owners(_input(docs, id_col, text_col), sign, budget).select(F.col("best_tag").alias(kept_tag)).distinct()
    tagged = docs.withColumn(tag, F.monotonically_increasing_id())
    return tagged.join(kept, F.col(tag) == F.col(kept_tag), "left_semi").drop(tag)
