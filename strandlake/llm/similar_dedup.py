"""Near copies by similarity of five-word shingles: wide SimHash fingerprints, vantage-point trees below shared shingles, verification.

A document's set of shingles gives a SimHash of 512 bits. Of its first 128 bits about 19 differ at similarity 0.8, with a
deviation of 4 (24 and 4 in the worst case, sets of four and five), so fingerprints within RADIUS of these are candidates;
of all bits about 78 differ, with a deviation of 8, so candidates of WIDE_SET shingles or more must be within WIDE_RADIUS,
too. A pair that is left is linked if the Jaccard similarity of the two sets (of 64-bit shingle hashes) is high enough. A ball of that radius
overlaps nearly every split of one tree over all documents, so the space is first cut by content: a document belongs to
the cell of each of its KEYS smallest shingle hashes. Of the KEYS smallest hashes of two documents' union each is shared
with a chance of at least the similarity, so a similar pair meets in no cell with a chance of at most 0.2 ** 16 (none
at all for sets of up to KEYS hashes). Inside a cell the sizes that can match, and for large cells a vantage-point tree
over the fingerprints, name the pairs within the radius.

Links come in two steps, so that a group of copies costs no square of its rows. First every member of a cell is compared
with the cell's pivot. Then the pairs that the first links left in different components follow: in cells of up to
CELL_ROWS all of them; in larger cells only members with fewer than COLD other cells that are not large (a pair of which
one has COLD cells of its own meets in one of those, but for a chance of 0.2 ** COLD), and of those only rows outside
the cell's largest component ask, in blocks that hold the sets themselves: their exact similarities are a product of
incidence matrices, and a block hands on no more links than it has rows. No group is cut short anywhere.

Defined cases: texts without words (null, empty or blank) are copies of each other; a text of fewer words than a shingle
is one shingle; a text of any length is read whole; a null id ranks above every other, ties of equal ids go to the row
that comes first in the scan; repeated rows are separate members, of which one stays; an empty table gives an empty
result; input columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import lookup_groups, materialise, pair_components, release, spare_name, trimmed
from strandlake.llm.simhash_dedup import Groups, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 38
WIDE_RADIUS = 120
WIDE_SET = 32
#: Smallest shingle hashes of a document that name its cells.
KEYS = 16
#: Rows of a cell whose pairs are all looked at by fingerprint, at most, and the rows of a block of a larger one.
CELL_ROWS = 256
BLOCK_ROWS = 2048
#: Cells of its own (not larger than CELL_ROWS) that spare a document the search in its large cells.
COLD = 10
#: Rows up to which a cell is compared row by row, without a tree.
_LEAF = 128
#: Pairs that one copy of a set of hashes serves in the verification.
_SERVED = 64
#: Numbers of rows that may be broadcast (8 MB) to pick those rows from a scan; more are met by shuffle.
BROADCAST_TAGS = 1_000_000


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """512-bit SimHash of a set of hashes, as eight words; each word votes on the hashes mixed once more."""
    x, words = hashes, [hashes]
    for _ in range(7):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        words.append(x)
    lanes = np.stack(words, axis=1).view(np.uint8).reshape(len(hashes), 64)
    votes = np.zeros(512, np.int64)
    # As many rows at a time as a byte can count.
    for i in range(0, len(hashes), 255):
        votes += np.add.reduce(np.unpackbits(lanes[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _fingerprints(width: int):
    def run(batches):
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            prints, sizes, keys = [], [], []
            for i in range(batch.num_rows):
                hashes = shingle_set(texts[i].as_py() or b"", width)
                prints.append(wide_fingerprint(hashes))
                sizes.append(len(hashes))
                # The smallest hashes; a text without words has the key 0.
                keys.append(hashes[:KEYS].view(np.int64) if len(hashes) else np.zeros(1, np.int64))
            wide = np.array(prints, np.uint64).reshape(-1, 8).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(tag, tag + batch.num_rows)), batch.column(0), pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(sizes, pa.int64()), lists, pa.FixedSizeListArray.from_arrays(pa.array(wide.ravel()), 8).cast(pa.list_(pa.int64()))],
                names=["tag", "id", "hi", "lo", "m", "keys", "wide"],
            )
            tag += batch.num_rows

    return run


def distance(hi, lo, other_hi, other_lo):
    """Bits in which 128-bit fingerprints differ."""
    return (np.bitwise_count(hi ^ other_hi) + np.bitwise_count(lo ^ other_lo)).astype(np.int16)


def tree_pairs(hi, lo, asks, radius: int):
    """Yield (asking, found) index arrays of every pair within the radius, by a vantage-point tree over all points."""
    rng = np.random.default_rng(11)
    stack = [(np.arange(len(hi)), np.nonzero(asks)[0])]
    while stack:
        own, asking = stack.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) > _LEAF:
            tries = own[rng.choice(len(own), min(8, len(own)), replace=False)]
            some = own if len(own) <= 256 else rng.choice(own, 256, replace=False)
            pivot = max(tries.tolist(), key=lambda v: float(np.var(distance(hi[some], lo[some], hi[v], lo[v]))))
            d = distance(hi[own], lo[own], hi[pivot], lo[pivot])
            median = int(np.median(d))
            near = d <= median
            d_ask = distance(hi[asking], lo[asking], hi[pivot], lo[pivot])
            inner, outer = d_ask - radius <= median, d_ask + radius > median
            # A split that prunes nothing only costs: then the points are compared in blocks.
            if not near.all() and inner.sum() + outer.sum() < 1.8 * len(asking):
                stack.append((own[near], asking[inner]))
                stack.append((own[~near], asking[outer]))
                continue
        for i in range(0, len(asking), 1024):
            x = asking[i : i + 1024]
            for k in range(0, len(own), 2048):
                y = own[k : k + 2048]
                r, c = np.nonzero(distance(hi[x][:, None], lo[x][:, None], hi[y], lo[y]) <= radius)
                yield x[r], y[c]


def _fits(m_a, m_b, least: float):
    """Whether sets of two sizes can reach the similarity."""
    return np.minimum(m_a, m_b) >= np.maximum(m_a, m_b) * least - 1e-9


def _cell_pairs(radius: int, least: float):
    """Kernel over rows in order of `cell`: the pairs (a, b) of a cell within the radius, one asking, of different labels."""

    def pairs(cols):
        cell, hi, lo = cols["cell"], cols["hi"].view(np.uint64), cols["lo"].view(np.uint64)
        m, tag, label, asks = cols["m"], cols["tag"], cols["label"], cols["asks"]
        found = []

        def keep(i, j):
            ok = (label[i] != label[j]) & (tag[i] != tag[j]) & _fits(m[i], m[j], least)
            i, j = tag[i[ok]], tag[j[ok]]
            found.append((np.maximum(i, j), np.minimum(i, j)))

        start = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0] if len(cell) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(cell)))
        # Small cells run together: each row against the one `step` places on, while both are of one cell.
        ahead = np.repeat(np.where(size <= _LEAF, start + size, 0), size)
        at, step = np.arange(len(cell)), 1
        while len(at := at[at + step < ahead[at]]):
            i, j = at, at + step
            ok = (asks[i] | asks[j]) & (distance(hi[i], lo[i], hi[j], lo[j]) <= radius)
            keep(i[ok], j[ok])
            step += 1
        for s, n in zip(start[size > _LEAF].tolist(), size[size > _LEAF].tolist()):
            part = slice(s, s + n)
            for i, j in tree_pairs(hi[part], lo[part], asks[part], radius):
                keep(i + s, j + s)
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            held = cols if held is None else {n: np.concatenate([held[n], cols[n]]) for n in cols}
            # The last cell may go on in the next batch.
            cut = int(np.searchsorted(held["cell"], held["cell"][-1]))
            if cut:
                yield pairs({n: x[:cut] for n, x in held.items()})
                held = {n: x[cut:] for n, x in held.items()}
        if held is not None:
            yield pairs(held)

    return run


def _sets(width: int):
    """Kernel over (tag, body): the shingle set of each text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                tags, bodies = batch.column(0).slice(at, 512), batch.column(1).slice(at, 512)
                sets = [shingle_set(bodies[i].as_py() or b"", width).view(np.int64) for i in range(len(bodies))]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([tags, lists], names=["tag", "hashes"])

    return run


def similarities(asking: list[np.ndarray], sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact Jaccard similarity of each asking set to each set, by products of incidence matrices, `width` columns at a time."""
    whole = [*asking, *sets]
    sizes = np.array([len(x) for x in whole], np.int64)
    codes = np.unique(np.concatenate([np.zeros(0, np.int64), *whole]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(whole)), sizes)
    # Only hashes of both sides count.
    held = np.zeros((2, codes.max(initial=-1) + 1), bool)
    held[(row >= len(asking)).astype(int), codes] = True
    both = held.all(0)
    keep = both[codes]
    row, codes = row[keep], (np.cumsum(both) - 1)[codes[keep]]
    order = np.argsort(codes, kind="stable")
    row, codes = row[order], codes[order]
    shared = np.zeros((len(asking), len(sets)), np.float32)
    for low in range(0, int(both.sum()), width):
        a, b = np.searchsorted(codes, [low, low + width])
        block = np.zeros((len(whole), width), np.float32)
        block[row[a:b], codes[a:b] - low] = 1
        shared += block[: len(asking)] @ block[len(asking) :].T
    total = sizes[: len(asking), None] + sizes[None, len(asking) :] - shared.astype(np.float64)
    # Two empty sets are equal.
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def _block_links(least: float):
    """Kernel over rows in order of `cell`: the similar sets of a block, as links (a, b) of a forest over its rows."""

    def links(rows):
        tag, label, asks = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
        at, own = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        near = similarities([rows[i][3] for i in at], [rows[i][3] for i in own]) >= least
        # An asking row stands among the block's own rows too, there or in another block.
        x, y = np.nonzero(near & (label[at][:, None] != label[own]) & (tag[at][:, None] != tag[own]))
        groups = Groups(len(rows))
        groups.link(at[x], own[y])
        root = groups.roots()
        some = np.nonzero(root != np.arange(len(rows)))[0]
        return pa.RecordBatch.from_arrays([pa.array(tag[some], pa.int64()), pa.array(tag[root[some]], pa.int64())], names=["a", "b"])

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            cells, ends = batch.column(0).to_numpy(), batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy()
            tag, label, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for i in range(batch.num_rows):
                if cells[i] != cell:
                    if rows:
                        yield links(rows)
                    cell, rows = cells[i], []
                rows.append((tag[i], label[i], asks[i], values[ends[i] : ends[i + 1]].copy()))
        if rows:
            yield links(rows)

    return run


def _verify(least: float):
    """Kernel over (a, b, left, right): the pairs whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            ends = [batch.column(k).offsets.to_numpy() for k in (2, 3)]
            values = [batch.column(k).values.to_numpy() for k in (2, 3)]
            good = [
                jaccard(values[0][ends[0][i] : ends[0][i + 1]], values[1][ends[1][i] : ends[1][i + 1]]) >= least for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _attach(pairs: DataFrame, side: str, other: str, table: DataFrame, column: str, name: str, total: int) -> DataFrame:
    """The pairs with one side's value of a column: a copy of a value serves _SERVED pairs, so no key fills a task."""
    sizes = pairs.groupBy(side).agg(F.count("*").alias("n"))
    copies = F.ceil(F.col("n") / _SERVED).cast("int")
    dealt = lookup_groups(pairs, sizes, side, "n", total).withColumn("copy", F.pmod(F.xxhash64(other), copies)).drop("n")
    sent = table.withColumnRenamed("tag", side).join(sizes, side).select(side, F.col(column).alias(name), F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)).alias("copy"))
    return dealt.join(sent, [side, "copy"]).drop("copy")


def _picked(rows: DataFrame, tags: DataFrame, key: str, how: str, name: str) -> DataFrame:
    """A semi or anti join of a scan with row numbers, whose size is checked before they are broadcast."""
    tags = materialise(tags, name)
    return rows.join(F.broadcast(tags) if tags.count() <= BROADCAST_TAGS else tags, key, how)


def _similar(pairs: DataFrame, tagged: DataFrame, prints: DataFrame, least: float, width: int, name: str) -> DataFrame:
    """The distinct pairs (a, b) that pass the wide fingerprint and whose sets reach the similarity, as a written table."""
    pairs = materialise(pairs.distinct(), f"{name}_pairs")
    total = pairs.count()
    if not total:
        return pairs
    known = prints.select("tag", F.struct("m", "wide").alias("print"))
    both = materialise(_attach(pairs, "b", "a", known, "print", "right", total), f"{name}_half")
    both = _attach(both, "a", "b", known, "print", "left", total)
    far = F.aggregate(F.zip_with("left.wide", "right.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    pairs = materialise(both.filter((F.least("left.m", "right.m") < WIDE_SET) | (far <= WIDE_RADIUS)).select("a", "b"), f"{name}_near")
    total = pairs.count()
    wanted = pairs.select(F.col("a").alias("tag")).unionByName(pairs.select(F.col("b").alias("tag"))).distinct()
    sets = _picked(tagged, wanted, "tag", "left_semi", f"{name}_wanted").mapInArrow(trimmed(_sets(width)), "tag long, hashes array<long>")
    sets = materialise(sets, f"{name}_sets")
    rows = materialise(_attach(pairs, "b", "a", sets, "hashes", "right", total), f"{name}_rows")
    rows = _attach(rows, "a", "b", sets, "hashes", "left", total).select("a", "b", "left", "right")
    good = materialise(rows.mapInArrow(trimmed(_verify(least)), "a long, b long"), name)
    release(pairs.sparkSession)
    return good


def _within(hi: Column, lo: Column, m: Column, other: str, radius: int, least: float) -> Column:
    """Whether a row can be similar to the struct `other`, as an expression."""
    far = F.bit_count(hi.bitwiseXOR(F.col(f"{other}.hi"))) + F.bit_count(lo.bitwiseXOR(F.col(f"{other}.lo")))
    return (far <= radius) & (F.least(m, F.col(f"{other}.m")) >= F.greatest(m, F.col(f"{other}.m")) * least - 1e-9)


def similar_labels(tagged: DataFrame, prints: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, width: int = WIDTH, cell_rows: int | None = None) -> DataFrame:
    """(node, label): tags of documents that have a near copy, and the smallest tag reachable. `prints` is a written table."""
    cell_rows = cell_rows or CELL_ROWS
    rows = prints.select("tag", "hi", "lo", "m", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    sums = prints.agg(F.sum(F.size("keys")).alias("n")).first()
    cells = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("tag", "hi", "lo", "m")).alias("pivot")).filter("n > 1")
    cells = materialise(cells, "cells")
    shared = materialise(lookup_groups(rows, cells, "key", "n", sums["n"] or 0, "inner"), "shared")
    star = shared.filter(F.col("tag") != F.col("pivot.tag")).filter(_within(F.col("hi"), F.col("lo"), F.col("m"), "pivot", radius, least))
    first = _similar(star.select(F.col("tag").alias("a"), F.col("pivot.tag").alias("b")), tagged, prints, least, width, "similar")
    labels = pair_components(first)
    marked = shared.drop("pivot").join(labels.withColumnRenamed("node", "tag"), "tag", "left").withColumn("label", F.coalesce("label", "tag"))
    marked = materialise(marked, "marked")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    fields = ("cell", "hi", "lo", "m", "tag", "label", "asks")
    small = marked.filter(F.col("n") <= cell_rows).join(mixed, "key", "left_semi").withColumn("asks", F.lit(True)).withColumn("cell", F.col("key"))
    small = small.repartition("cell").sortWithinPartitions("cell").select(*fields)
    rest = _similar(small.mapInArrow(trimmed(_cell_pairs(radius, least)), "a long, b long"), tagged, prints, least, width, "also_similar")
    large = marked.filter(F.col("n") > cell_rows)
    if large.limit(1).count():
        rest = rest.unionByName(_large_cells(large, tagged, least, width))
    if not rest.limit(1).count():
        return labels
    return pair_components(rest.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _large_cells(marked: DataFrame, tagged: DataFrame, least: float, width: int) -> DataFrame:
    """Links (a, b) of the cells beyond CELL_ROWS, as a written table: rows outside a cell's largest component against all, in blocks."""
    hot = marked.groupBy("tag").agg(F.count("*").alias("hot"), F.first("n_keys").alias("of")).filter(F.col("of") - F.col("hot") < COLD).select("tag")
    rows = materialise(marked.select("key", "tag", "label").join(hot, "tag", "left_semi"), "large_cells")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    main = by_label.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("of"), F.max("k").alias("most"))
    main = materialise(main.filter("of > most").select("key", "main", "of", (F.col("of") - F.col("most")).alias("asking")), "main_labels")
    sized = lookup_groups(rows, main, "key", "of", rows.count(), "inner")
    wanted = sized.select("tag").distinct()
    sets = _picked(tagged, wanted, "tag", "left_semi", "large_wanted").mapInArrow(trimmed(_sets(width)), "tag long, hashes array<long>")
    held = materialise(sized.join(materialise(sets, "large_sets"), "tag"), "large_rows")
    ask = F.col("label") != F.col("main")
    blocks, chunks = F.ceil(F.col("of") / BLOCK_ROWS).cast("int"), F.ceil(F.col("asking") / BLOCK_ROWS).cast("int")
    own = held.select(
        "key", "tag", "label", F.lit(False).alias("asks"), "hashes",
        F.pmod(F.xxhash64("tag"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
    )
    asking = held.filter(ask).select(
        "key", "tag", "label", F.lit(True).alias("asks"), "hashes",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("tag"), chunks).cast("int").alias("chunk"),
    )
    dealt = own.unionByName(asking).withColumn("cell", F.xxhash64("key", "block", "chunk"))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell").select("cell", "tag", "label", "asks", "hashes")
    return materialise(dealt.mapInArrow(trimmed(_block_links(least)), "a long, b long"), "large_links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` that stay, columns as they were: the row of the smallest id of each component of near copies.

    `docs` is scanned more than once and must give the same rows in the same order each time, as a table of files does.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body")
    tagged = docs.select(F.monotonically_increasing_id().alias("tag"), body)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), body)
    prints = materialise(pairs.mapInArrow(trimmed(_fingerprints(width)), "tag long, id long, hi long, lo long, m long, keys array<long>, wide array<long>"), "wide_prints")
    labels = similar_labels(tagged, prints, radius, least, width)
    rank = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("rank"), "tag")
    linked = materialise(labels.withColumnRenamed("node", "tag").join(prints.select("tag", "id"), "tag"), "similar_groups")
    chosen = linked.groupBy("label").agg(F.min(rank).alias("first")).select(F.col("first.tag").alias("tag"))
    tag = spare_name(docs, "__tag")
    gone = linked.select("tag").join(chosen, "tag", "left_anti").select(F.col("tag").alias(tag))
    return _picked(docs.withColumn(tag, F.monotonically_increasing_id()), gone, tag, "left_anti", "gone").select(*[F.col(f"`{c}`") for c in docs.columns])
