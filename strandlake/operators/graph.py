"""Distances, nearest-neighbour graphs and message passing over edge tables.

All-pairs work is dealt into blocks: a point goes once to every block pair it takes part in, and a NumPy kernel handles
one pair of blocks, so a task's memory is bounded by the block size and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points in a block of the all-pairs kernels.
BLOCK_ROWS = 2048


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return np.clip(1 - (a @ b.T) / np.maximum(na[:, None] * nb[None, :], 1e-12), 0, 2)
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out + 1e-16) if metric == "euclidean" else out


def _matrix(table: pa.Table, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rows = table.column(column).combine_chunks()
    flat = rows.flatten() if not rows.null_count else pa.array([], pa.float64())
    if not table.num_rows or rows.null_count or flat.null_count or len(flat) % table.num_rows:
        return table.column(0).to_numpy(), np.array(rows.to_pylist(), dtype=np.float64).reshape(table.num_rows, -1)
    return table.column(0).to_numpy(), flat.to_numpy().astype(np.float64).reshape(table.num_rows, -1)


#: Rows and columns of a distance tile inside a block pair, and pairs whose distances are recomputed at once.
TILE, PAIRS = 1024, 2048
#: Squared distances below this share of the squared norms lose too many digits in a matrix product.
CLOSE = 1e-4


def _squares(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, to about 1e-15 of the squared norms."""
    d = a @ b.T
    d *= -2.0
    d += na[:, None]
    d += nb[None, :]
    return np.maximum(d, 0.0, out=d)


def _pair_distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rounded euclidean distances of listed pairs, by the same sums as `_distances`."""
    out = np.empty(len(r))
    for at in range(0, len(r), PAIRS):
        x = a[r[at : at + PAIRS]] - b[c[at : at + PAIRS]]
        x *= x
        # Over the first axis the sum goes element after element, as in `_distances`.
        out[at : at + PAIRS] = np.round(np.sqrt(np.ascontiguousarray(x.T).sum(0) + 1e-16), 6)
    return out


def _tile(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Rounded euclidean distances of a tile; close pairs, which a matrix product gets wrong, by plain differences."""
    d = _squares(a, b, na, nb)
    close = d < CLOSE * (na[:, None] + nb[None, :])
    n = np.count_nonzero(close)
    if n * 8 > d.size:
        return np.round(_distances(a, b, "euclidean"), 6)
    r, c = np.nonzero(close) if n else (None, None)
    d += 1e-16
    np.round(np.sqrt(d, out=d), 6, out=d)
    if n:
        d[r, c] = _pair_distances(a, b, r, c)
    return d


def _tiles(n: int):
    return [slice(at, min(at + TILE, n)) for at in range(0, n, TILE)]


class _Nearest:
    """The k nearest rows of block b for each of the first n rows of block a, by rounded distance, ties by name."""

    def __init__(self, n: int, k: int, a, b, names, slack: float):
        self.n, self.k, self.a, self.b, self.names, self.slack = n, k, a, b, names, slack
        self.bound = np.full(n, np.inf)
        self.r, self.c, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _wider(self, d: np.ndarray) -> np.ndarray:
        """Squares by matrix product of all pairs that may round to distance d or less."""
        return (d + 2e-6) ** 2 + self.slack

    def add(self, rows: slice, columns: slice, d: np.ndarray) -> None:
        """A tile of squares; infinite ones do not count."""
        d = d[: max(0, self.n - rows.start)]
        if not len(d):
            return
        rows = slice(rows.start, rows.start + len(d))
        bound = self.bound[rows]
        if d.shape[1] >= self.k and np.isinf(bound).any():
            some = np.ascontiguousarray(d[:, : max(256, self.k)])
            bound = self.bound[rows] = np.minimum(bound, self._wider(np.sqrt(np.partition(some, self.k - 1, axis=1)[:, self.k - 1])))
        r, c = np.nonzero(d <= np.minimum(bound, np.finfo(np.float64).max)[:, None])
        self.new.append((r + rows.start, c + columns.start, d[r, c]))
        self.waiting += len(r)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        """Sift what waits by its squares, compute the rest by differences, and keep k of each row."""
        r, c, v = (np.concatenate(x) for x in zip(*self.new)) if self.new else (self.r[:0], self.c[:0], self.d[:0])
        order = np.lexsort((v, r))
        last = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) == self.k - 1]
        self.bound[r[last]] = np.minimum(self.bound[r[last]], self._wider(np.sqrt(v[last])))
        near = v <= self.bound[r]
        r, c = r[near], c[near]
        d = _pair_distances(self.a, self.b, r, c)
        self.new, self.waiting = [], 0
        r, c, d = np.concatenate([self.r, r]), np.concatenate([self.c, c]), np.concatenate([self.d, d])
        order = np.lexsort((self.names[c], d, r))
        place = np.arange(len(r)) - np.searchsorted(r[order], r[order])
        last = order[place == self.k - 1]
        self.bound[r[last]] = np.minimum(self.bound[r[last]], self._wider(d[last]))
        keep = order[place < self.k]
        self.r, self.c, self.d = r[keep], c[keep], d[keep]


def _nearest_pair(k: int, i, a, n: int, j, b, m: int, both: bool) -> pa.Table:
    """The k nearest in block b of each of the first n rows of block a; with `both` also those in a of the first m of b.

    Without `both` the blocks are one: rows of equal ids are then no neighbours.
    """
    na, nb = (a * a).sum(1), (b * b).sum(1)
    slack = 1e-13 * float(max(na.max(initial=0), nb.max(initial=0)))
    there, back = _Nearest(n, k, a, b, j, slack), _Nearest(m, k, b, a, i, slack)
    for s in _tiles(len(i)):
        for t in _tiles(len(j)):
            if s.start >= n and (not both or t.start >= m):
                continue
            d = _squares(a[s], b[t], na[s], nb[t])
            if not both:
                d[i[s][:, None] == j[t][None, :]] = np.inf
            there.add(s, t, d)
            if both:
                back.add(t, s, d.T)
    there.settle()
    back.settle()
    return pa.table({"i": np.concatenate([i[there.r], j[back.r]]), "j": np.concatenate([j[there.c], i[back.c]]), "d": np.concatenate([there.d, back.d])})


#: Blocks that a table is cut into at least, where it has enough rows, so that there is a block pair for every core.
LEAST_BLOCKS, BIG_BLOCK = 12, 16384


def _parts(n: int, block_rows: int) -> int:
    """Blocks of a table: few, since every row goes to each of them, but enough for the cores."""
    if block_rows != BLOCK_ROWS:
        return max(1, -(-n // block_rows))
    return max(1, -(-n // BIG_BLOCK), min(LEAST_BLOCKS, -(-n // block_rows)))


def meet_in_pairs(points: DataFrame, kernel, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of (id, vec, ...) in pairs of blocks, each pair of blocks once: kernel(left, right), or kernel(rows, None) of one block.

    A row goes to as many pairs as there are blocks; the kernel hands on what it finds for rows of both sides, in columns
    of type long or double. Equal ids are in one block.
    """
    n = _parts(points.count(), block_rows)
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = points.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumns({"__lo": F.least("__own", "__other"), "__hi": F.greatest("__own", "__other")}).drop("__other")

    def run(table: pa.Table) -> pa.Table:
        own, lo, hi = (table.column(c).to_numpy() for c in ("__own", "__lo", "__hi"))
        if lo[0] == hi[0]:
            return kernel(table, None)
        left, right = table.filter(pa.array(own == lo)), table.filter(pa.array(own == hi))
        if left.num_rows and right.num_rows:
            return kernel(left, right)
        return pa.table({n: pa.array([], {"long": pa.int64(), "double": pa.float64()}[kind]) for n, kind in (c.split() for c in schema.split(","))})

    # Pairs are dealt by number: by their bytes several would go to one task.
    return rows.repartition(n * (n + 1) // 2, "__lo", "__hi").groupBy("__lo", "__hi").applyInArrow(run, schema)


def _block_pairs(metric: str, k: int | None, alone: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        i, a = _matrix(left)
        j, b = _matrix(right)
        if not len(i) or not len(j):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        d = np.round(_distances(a, b, metric), 6)
        # Within one table a row is at distance 0 of itself and not its own neighbour.
        same = (i[:, None] == j[None, :]) & alone
        if k is None:
            d[same] = 0.0
            return pa.table({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "d": d.ravel()})
        d[same] = np.inf
        order = np.lexsort((np.broadcast_to(j, d.shape), d), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(i)), order.shape[1])
        d, j = d[rows, order.ravel()], j[order.ravel()]
        keep = np.isfinite(d)
        return pa.table({"i": i[rows][keep], "j": j[keep], "d": d[keep]})

    return run


def _dealt(left: DataFrame, other: DataFrame | None, metric: str, k: int | None, block_rows: int) -> DataFrame:
    right = left if other is None else other
    nl, nr = max(1, -(-left.count() // block_rows)), max(1, -(-right.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = left.select(F.col("id").cast("long"), "vec", block(nl).alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("bj"))
    # Fresh names keep the sides apart when both come from one table: column pruning would else drop the right side's.
    held = right.select(F.col("id").cast("long").alias("id2"), F.col("vec").alias("vec2"), block(nr).alias("bj2"), F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("bi2"))
    return asked.groupBy("bi", "bj").cogroup(held.groupBy("bi2", "bj2")).applyInArrow(_block_pairs(metric, k, other is None), "i long, j long, d double")


def pairwise_distances(points: DataFrame, metric: str = "euclidean", other: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, d) for every pair of (id, vec) rows; metric euclidean, squared or cosine; the diagonal is 0."""
    return _dealt(points, other, metric, None, block_rows)


def knn(points: DataFrame, k: int, metric: str = "euclidean", other: DataFrame | None = None, block_rows: int = BLOCK_ROWS, asked: str | None = None) -> DataFrame:
    """(i, j, d, rank): the k nearest other rows of each row, ties by id. Each block keeps k, then blocks are merged.

    Euclidean distances are sifted by matrix products, and what may be among the k nearest is computed by differences.
    `asked` names a boolean column: only rows where it is true are given neighbours, from all rows.
    """
    if metric == "euclidean" and other is None and k > 0:

        def sides(table: pa.Table):
            if asked:
                table = table.sort_by([("asked", "descending")])
            return *_matrix(table), int(np.count_nonzero(table.column("asked").to_numpy())) if asked else table.num_rows

        def kernel(left: pa.Table, right: pa.Table | None) -> pa.Table:
            one = sides(left)
            return _nearest_pair(k, *one, *one[:2], 0, False) if right is None else _nearest_pair(k, *one, *sides(right), True)

        rows = points.select(F.col("id").cast("long").alias("id"), "vec", *([F.coalesce(F.col(asked), F.lit(False)).cast("int").alias("asked")] if asked else []))
        some = meet_in_pairs(rows, kernel, "i long, j long, d double", block_rows)
    else:
        some = _dealt(points, other, metric, k, block_rows)
        some = some.join(points.filter(asked).select(F.col("id").alias("i")), "i", "left_semi") if asked else some
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return some.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def kth_distance(points: DataFrame, k: int) -> DataFrame:
    """(id, sigma): the k-th smallest distance of each row to another; none where there are fewer rows."""
    if k < 1:
        return points.select("id", F.lit(0.0).alias("sigma"))
    return knn(points.select("id", "vec"), k).filter(F.col("rank") == k).select(F.col("i").alias("id"), F.col("d").alias("sigma"))


def met_tiles(left: pa.Table, right: pa.Table | None):
    """Tiles of a block pair: (rows, columns, rounded distances, which rows and columns are of one id; None in different blocks)."""
    i, a = _matrix(left)
    j, b = (i, a) if right is None else _matrix(right)
    na, nb = (a * a).sum(1), (b * b).sum(1)
    for s in _tiles(len(i)):
        for t in _tiles(len(j)):
            d, same = _tile(a[s], b[t], na[s], nb[t]), i[s][:, None] == j[t][None, :] if right is None else None
            if same is not None:
                d[same] = 0.0
            yield s, t, d, same


def fuzzy_weights(points: DataFrame, k: int) -> DataFrame:
    """(i, weight, n): each row's sum of fuzzy_membership's weights after symmetrize, and its number of pairs, itself included.

    Blocks hand on sums, so no pair is ever listed.
    """
    from strandlake.session import cut_lineage

    rows = cut_lineage(points.select(F.col("id").cast("long").alias("id"), "vec"))
    rows = cut_lineage(rows.join(kth_distance(rows, k - 1), "id"))

    def kernel(left: pa.Table, right: pa.Table | None) -> pa.Table:
        other = left if right is None else right
        p, q = (np.maximum(x.column("sigma").to_numpy(), 1e-12) for x in (left, other))
        there, back = np.zeros(left.num_rows), np.zeros(other.num_rows)
        for s, t, d, same in met_tiles(left, right):
            w = fuzzy_union(d, p[s], q[t], same)
            there[s] += w.sum(1)
            back[t] += w.sum(0)
        sums = [(left, there, other.num_rows)] + ([(other, back, left.num_rows)] if right is not None else [])
        return pa.table({"i": np.concatenate([x.column("id").to_numpy() for x, _, _ in sums]), "weight": np.concatenate([w for _, w, _ in sums]), "n": np.concatenate([np.full(x.num_rows, n) for x, _, n in sums])})

    met = meet_in_pairs(rows, kernel, "i long, weight double, n long")
    return met.groupBy("i").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def fuzzy_union(d: np.ndarray, p: np.ndarray, q: np.ndarray, same: np.ndarray | None) -> np.ndarray:
    """Symmetrised weights of a tile of distances with the widths of its rows and columns; 0 between a row and itself."""
    a, b = np.exp(-d / p[:, None]), np.exp(-d / q[None, :])
    w = a + b - a * b
    if same is not None:
        w[same] = 0.0
    return w


def fuzzy_membership(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, w): exp(-d / sigma_i) with sigma_i the k-th smallest distance of i, the diagonal 0."""
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    sigma = pairs.withColumn("r", place).filter(F.col("r") == k).select("i", F.col("d").alias("sigma"))
    return pairs.join(sigma, "i").select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.exp(-F.col("d") / F.greatest("sigma", F.lit(1e-12)))).alias("w"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Fuzzy union (i, j, w): a + b - a b of each edge and its reverse."""
    swapped = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return edges.join(swapped, ["i", "j"], "full").select("i", "j", (a + b - a * b).alias("w"))


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    return edges.join(edges.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")


def scatter(messages: DataFrame, nodes: DataFrame, node: str, target: str, value: str, how: str = "sum", eps: float = 1e-8) -> DataFrame:
    """(node, value): messages summed, averaged or maximised at their targets; nodes without one get 0."""
    made = {"sum": F.sum(value), "mean": F.sum(value) / (F.count(value) + eps), "max": F.max(value)}[how]
    got = messages.groupBy(F.col(target).alias("__t")).agg(made.alias("__v"))
    return nodes.join(got, F.col(node) == F.col("__t"), "left").select(node, F.coalesce("__v", F.lit(0.0)).alias("value"))


def global_pool(nodes: DataFrame, graph: str, value: str) -> DataFrame:
    """Sum, mean and maximum of a node value in each graph."""
    return nodes.groupBy(graph).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def edge_softmax(edges: DataFrame, score: str, target: str, name: str = "a", eps: float = 1e-10) -> DataFrame:
    """Attention weights: softmax of the scores of each target's incoming edges."""
    w = Window.partitionBy(target)
    e = edges.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(name, F.col("__e") / (F.sum("__e").over(w) + eps)).drop("__e")


def sinkhorn(cost: DataFrame, epsilon: float = 0.1, rounds: int = 20) -> DataFrame:
    """(i, j, p): entropic transport plan between uniform marginals of a cost table (i, j, c), by log-domain updates.

    Each half-round is a max-shifted log-sum-exp grouped by one side; only the two potential tables change. They are
    written to the shared folder every few rounds, so lineage does not pile up.
    """
    from strandlake.session import cut_lineage

    n = cost.agg(F.countDistinct("i").alias("n"), F.countDistinct("j").alias("m")).first()
    la, lb = -float(np.log(n["n"])), -float(np.log(n["m"]))
    cost = cut_lineage(cost.select("i", "j", (-F.col("c") / epsilon).alias("k")))
    f = cost.select("i").distinct().withColumn("f", F.lit(0.0))
    g = cost.select("j").distinct().withColumn("g", F.lit(0.0))

    def half(potential, on, by, log_mass, name):
        # The greatest term first, then the sum of the shifted ones: no row of the matrix is ever gathered in one buffer.
        t = cost.join(potential, on).withColumn("s", F.col("k") + F.col("g" if name == "f" else "f"))
        top = t.groupBy(by).agg(F.max("s").alias("top"))
        total = t.join(top, by).groupBy(by).agg(F.first("top").alias("top"), F.sum(F.exp(F.col("s") - F.col("top"))).alias("total"))
        return total.select(by, (F.lit(log_mass) - F.col("top") - F.log("total")).alias(name))

    for r in range(rounds):
        f = half(g, "j", "i", la, "f")
        g = half(f, "i", "j", lb, "g")
        if r % 2 == 1:
            f, g = cut_lineage(f), cut_lineage(g)
    return cost.join(f, "i").join(g, "j").select("i", "j", F.exp(F.col("k") + F.col("f") + F.col("g")).alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an undirected edge table (i, j) reaches.

    Rounds contract labels: each hooks to the smallest label next to it, chains of hooks are followed two steps, and the
    edges between different labels go on. The rounds grow with the logarithm of the longest path.
    """
    from strandlake.session import cut_lineage

    pairs = edges.select(F.col("i").alias("a"), F.col("j").alias("b"))
    left = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = left.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        hooks = cut_lineage(left.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("up")).filter("up < label"))
        if not hooks.limit(1).count():
            return labels
        for _ in range(2):
            hooks = hooks.join(hooks.select(F.col("label").alias("up"), F.col("up").alias("top")), "up", "left").select("label", F.coalesce("top", "up").alias("up"))
        hooks = cut_lineage(hooks)
        to = lambda c: hooks.select(F.col("label").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        labels = cut_lineage(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label")))
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        left = cut_lineage(moved.filter("a <> b").distinct())


def distance_sums(points: DataFrame, by: str, block_rows: int = BLOCK_ROWS, within: str | None = None) -> DataFrame:
    """(id, by, total, n): the sum of each point's distances to the other points of each group, and their number.

    Blocks of points meet in pairs as elsewhere here, but a block pair hands on one row a point and group, not its pairs.
    With `within`, a column, only points of equal values there meet.
    """
    rows = points.select(F.col("id").cast("long").alias("id"), "vec", F.col(by).cast("long").alias("g"), (F.col(within) if within else F.lit(0)).cast("long").alias("w"))

    def sums(left: pa.Table, right: pa.Table | None) -> list[tuple]:
        other = left if right is None else right
        i, j = left.column("id").to_numpy(), other.column("id").to_numpy()
        (gi, ci), (gj, cj) = (np.unique(x.column("g").to_numpy(), return_index=True) for x in (left, other))
        ti, ni = np.zeros((len(i), len(gj))), np.zeros((len(i), len(gj)), np.int64)
        tj, nj = np.zeros((len(j), len(gi))), np.zeros((len(j), len(gi)), np.int64)

        def add(total, n, edges, at, d, same):
            """Sums over the columns of a tile, group by group; edges: where the groups of the whole block begin."""
            first, last = np.searchsorted(edges, at.start, "right") - 1, np.searchsorted(edges, at.stop, "left")
            cut = np.maximum(edges[first:last] - at.start, 0)
            total[:, first:last] += np.add.reduceat(d, cut, axis=1)
            n[:, first:last] += np.diff(np.append(cut, d.shape[1]))[None, :]
            if same is not None:
                n[:, first:last] -= np.add.reduceat(same.astype(np.int64), cut, axis=1)

        for s, t, d, same in met_tiles(left, right):
            add(ti[s], ni[s], cj, t, d, same)
            if right is not None:
                add(tj[t], nj[t], ci, s, d.T, None)
        mine = (np.repeat(i, len(gj)), np.tile(gj, len(i)), ti.ravel(), ni.ravel())
        return [mine] if right is None else [mine, (np.repeat(j, len(gi)), np.tile(gi, len(j)), tj.ravel(), nj.ravel())]

    def kernel(left: pa.Table, right: pa.Table | None) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        left, right = left.sort_by([("w", "ascending"), ("g", "ascending")]), None if right is None else right.sort_by([("w", "ascending"), ("g", "ascending")])
        part = lambda x, w: x.filter(pa.array(x.column("w").to_numpy() == w))
        for w in np.unique(left.column("w").to_numpy()):
            mine, theirs = part(left, w), None if right is None else part(right, w)
            if theirs is None or theirs.num_rows:
                found += sums(mine, theirs)
        return pa.table({n: np.concatenate([f[x] for f in found]) for x, n in enumerate(("id", "g", "total", "n"))})

    met = meet_in_pairs(rows, kernel, "id long, g long, total double, n long", block_rows)
    return met.groupBy("id", F.col("g").alias(by)).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
