"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint is the majority vote of the 64-bit hashes of its word shingles. Distinct fingerprints are
partitioned into shards by a vantage-point tree in Hamming space, fitted on a bounded sample; every fingerprint is
indexed in its home shard and also sent, as a visitor, to each later shard that its search ball overlaps by the triangle
bounds. Visitors of a shard come in chunks, each met with the shard's own fingerprints in a task of its own, so no group
grows beyond a shard and a chunk. There a local vantage-point tree finds the exact pairs within the radius, and the pairs
shrink to local groups at once. Groups of all shards are joined into components by rounds of smallest labels over written tables.

Defined cases: a null text counts as empty; texts of any length are read whole; a text without words has fingerprint zero, linked like any other; a null id
is never a component's id unless all its members' ids are null; repeated rows are separate members; an empty table gives
an empty result; rows that tie on the id of a component's first row go by their place in the scan; input columns may have
any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import lookup_groups, materialise, min_label_components, spare_name

#: Distinct fingerprints from which the shard tree is fitted, at most; all fingerprints are indexed.
SAMPLE = 8192
#: Fingerprints that a shard holds at most, about, and least, where there are enough shards for every task anyway. More
#: shards mean more visitors, so their number follows the parallelism until shards grow too large.
SHARD_ROWS = 262_144
LEAST_ROWS = 2048
#: Visitors of a chunk, about.
VISITORS = 524_288
_LEAF = 256
#: bit j of each byte value
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit hashes of a text's word shingles; words are runs of anything but ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles: the majority vote of their hashes."""
    hashes = shingle_hashes(text, width, seed)
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.view(np.uint8).reshape(n, 8) + _LANES
    votes = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((votes * 2 > n).ravel(), bitorder="little").tobytes(), "little")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _fingerprints(width: int, seed: int):
    def run(batches):
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            prints = [_signed(fingerprint(texts[i].as_py() or b"", width, seed)) for i in range(batch.num_rows)]
            tags = pa.array(np.arange(tag, tag + batch.num_rows))
            tag += batch.num_rows
            yield pa.RecordBatch.from_arrays([tags, batch.column(0), pa.array(prints, pa.int64())], names=["tag", "id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(tag, id, fp) of every row, written to the shared folder; tag is the row's place in the scan."""
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    return materialise(pairs.mapInArrow(_fingerprints(width, seed), "tag long, id long, fp long"), "fingerprints")


def hamming(a, b):
    """Bits in which arrays of 64-bit values differ."""
    return np.bitwise_count(np.asarray(a, np.uint64) ^ np.asarray(b, np.uint64)).astype(np.int16)


def vantage_point(points: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
    """The candidate whose distances spread most, and the median distance to it."""
    tries = rng.choice(points, min(12, len(points)), replace=False)
    some = points if len(points) <= 512 else rng.choice(points, 512, replace=False)
    best = max(tries, key=lambda v: float(np.var(hamming(some, v))))
    return int(best), int(np.median(hamming(points, best)))


def shard_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> list:
    """Nested [pivot, median, inner, outer]; leaves are shard numbers."""
    rng = np.random.default_rng(seed)
    numbers = iter(range(1 << 30))

    def grow(points, want):
        if want < 2 or len(points) < 8:
            return next(numbers)
        pivot, median = vantage_point(points, rng)
        near = hamming(points, pivot) <= median
        if near.all():
            return next(numbers)
        return [pivot, median, grow(points[near], (want + 1) // 2), grow(points[~near], want // 2)]

    return grow(sample, leaves)


def route(tree, points: np.ndarray, radius: int):
    """Yield (shard, indices, home) for every shard a point's ball overlaps; home marks the points that live there."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            yield node, at, home
            continue
        pivot, median, inner, outer = node
        d = hamming(points[at], np.uint64(pivot))
        near, far = d - radius <= median, d + radius > median
        stack.append((inner, at[near], home[near] & (d[near] <= median)))
        stack.append((outer, at[far], home[far] & (d[far] > median)))


def _send(tree, radius: int):
    """Kernel: a fingerprint's home row, and a visitor's row for each later shard that its ball overlaps."""

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            points = prints.view(np.uint64)
            routed = list(route(tree, points, radius))
            lives = np.zeros(len(points), np.int64)
            for shard, at, home in routed:
                lives[at[home]] = shard
            for shard, at, home in routed:
                take = home | (lives[at] < shard)
                if take.any():
                    k = int(take.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, shard, np.int32)), pa.array(prints[at[take]]), pa.array(home[take])], names=["shard", "fp", "home"]
                    )

    return run


class Groups:
    """Union-find over 0..n-1 that takes pairs in bulk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.roots()
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            np.minimum.at(self.up, a, b)


def link_shard(points: np.ndarray, home: np.ndarray, radius: int, asks: np.ndarray | None = None) -> np.ndarray:
    """Group numbers of the points: linked where an asking point (all, if not given) lies within the radius of a home point, by a local tree."""
    groups, rng = Groups(len(points)), np.random.default_rng(11)

    def search(own, asking):
        """own: home points below this node; asking: points whose ball reaches it."""
        if not len(own) or not len(asking):
            return
        split = None
        if len(own) > _LEAF:
            pivot, median = vantage_point(points[own], rng)
            d_own = hamming(points[own], np.uint64(pivot))
            near = d_own <= median
            if not near.all():
                split = near
        if split is None:
            for i in range(0, len(own), 4096):
                block = own[i : i + 4096]
                for k in range(0, len(asking), 1024):
                    ask = asking[k : k + 1024]
                    x, y = np.nonzero(hamming(points[ask][:, None], points[block][None, :]) <= radius)
                    if len(x):
                        groups.link(ask[x], block[y])
            return
        d_ask = hamming(points[asking], np.uint64(pivot))
        search(own[split], asking[d_ask - radius <= median])
        search(own[~split], asking[d_ask + radius > median])

    search(np.nonzero(home)[0], np.arange(len(points)) if asks is None else np.nonzero(asks)[0])
    return groups.roots()


def _pairs(radius: int):
    """Kernel over one shard: members of the local groups of two or more fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy()
        order = np.argsort(prints, kind="stable")
        prints, home = prints[order], table.column("home").to_numpy()[order]
        chunk = table.column("chunk")[0].as_py()
        # The home points meet each other in the first chunk.
        root = link_shard(prints.view(np.uint64), home, radius, None if chunk == 0 else ~home)
        sizes = np.bincount(root, minlength=len(root))
        keep = sizes[root] > 1
        shard = table.column("shard")[0].as_py()
        cells = [f"{shard}:{chunk}:{prints[r]}" for r in root[keep]]
        return pa.table({"node": pa.array(prints[keep], pa.int64()), "cell": pa.array(cells, pa.string())})

    return run


def fingerprint_links(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """(node, cell): fingerprints of one cell are linked. `prints` has the distinct column fp, a written table of n rows."""
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = max(1, -(-n // SHARD_ROWS), min(width, n // LEAST_ROWS))
    tree = 0
    if leaves > 1:
        every = max(2, n // SAMPLE + 1)
        sample = prints.filter(F.expr(f"pmod(xxhash64(fp), {every}) = 0")).select("fp").limit(2 * SAMPLE).collect()
        tree = shard_tree(np.array(sorted(r[0] for r in sample), np.int64).view(np.uint64), leaves)
    sent = prints.select("fp").mapInArrow(_send(tree, radius), "shard int, fp long, home boolean")
    if leaves == 1:
        return sent.withColumn("chunk", F.lit(0)).groupBy("shard", "chunk").applyInArrow(_pairs(radius), "node long, cell string")
    sent = materialise(sent, "sent")
    # One number for each shard, whatever the fingerprints.
    visitors = {r[0]: r[1] for r in sent.filter("not home").groupBy("shard").count().collect()}
    chunks = {s: -(-k // VISITORS) for s, k in visitors.items() if k > VISITORS}
    of = F.lit(1)
    if chunks:
        table = F.broadcast(prints.sparkSession.createDataFrame(list(chunks.items()), "shard int, of int"))
        sent, of = sent.join(table, "shard", "left"), F.coalesce("of", F.lit(1))
    every = F.when(F.col("home"), F.sequence(F.lit(0), of - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), of).cast("int")))
    dealt = sent.select("shard", "fp", "home", F.explode(every).alias("chunk"))
    return dealt.groupBy("shard", "chunk").applyInArrow(_pairs(radius), "node long, cell string")


def _components(table: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """A row per fingerprint: fp, n, component_id, first (struct of id and tag of the component's first row)."""
    total = table.count()
    first = F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("rank"), "tag")).alias("first")
    groups = materialise(table.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("low"), first), "prints")
    labels = min_label_components(fingerprint_links(groups, groups.count(), radius))
    linked = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = materialise(linked, "linked")
    # Components of one fingerprint need no look-up; of the others, the sizes count fingerprints.
    whole = linked.groupBy("label").agg(F.min("low").alias("component_id"), F.min("first").alias("chosen"), F.count("*").alias("label_n"))
    found = lookup_groups(linked.drop("low", "first"), whole, "label", "label_n", total)
    return materialise(found.select("fp", "n", "component_id", "chosen"), "components"), total


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    table = fingerprint_table(docs, id_col, text_col, width, seed)
    groups, total = _components(table, radius)
    found = lookup_groups(table, groups.select("fp", "n", "component_id"), "fp", "n", total)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of `docs` that stay, columns as they were: the row of the smallest id of each component.

    `docs` is scanned twice and must give the same rows in the same order each time, as a table read from files does.
    """
    groups, _ = _components(fingerprint_table(docs, id_col, text_col, width, seed), radius)
    tag, kept_tag = spare_name(docs, "__tag"), spare_name(docs, "__kept")
    kept = groups.select(F.col("chosen.tag").alias(kept_tag)).distinct()
    tagged = docs.withColumn(tag, F.monotonically_increasing_id())
    return tagged.join(kept, F.col(tag) == F.col(kept_tag), "left_semi").drop(tag)
