"""Joins and set operations over keyed tables: as-of, interval, cell-fraction splits, clusters of molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.numeric import hash_order
from strandlake.functions.order import global_running
from strandlake.session import cut_lineage


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, name: str, slices: int = 1) -> DataFrame:
    """The rows of `left` with the value of the latest row of `right` at or before their time, null where there is none.

    Both sides go into one sorted run for each key, so no pair is ever formed. Of rows at the same time the greatest value
    counts. A hot key can be cut into `slices` of time: each slice carries its predecessor's last value.
    """
    a = left.withColumns({"__t": F.col(left_time), "__v": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)})
    b = right.select(*by, F.col(right_time).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__left")).filter("__t is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col("__t"), F.col("__left"), F.col("__v").asc_nulls_last()]
    if slices == 1:
        run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(name, F.last("__v", ignorenulls=True).over(run)).filter("__left = 1").drop("__t", "__v", "__left")
    clock = F.unix_micros(F.col("__t").cast("timestamp")) / 1e6 if right.schema[right_time].dataType.typeName().startswith("timestamp") else F.col("__t").cast("double")
    span = both.agg(F.min(clock).alias("a"), F.max(clock).alias("b")).first()
    width = max((span["b"] - span["a"]) / slices, 1e-9) if span["a"] is not None else 1.0
    both = cut_lineage(both.withColumn("__s", F.floor((clock - F.lit(span["a"] or 0.0)) / width)))
    run = Window.partitionBy(*by, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last("__v", ignorenulls=True).over(run))
    lasts = both.filter("__left = 0").groupBy(*by, "__s").agg(F.max_by("__v", F.struct("__t", "__v")).alias("__last"))
    keys = both.select(*by, "__s").distinct().join(lasts, [*by, "__s"], "left")
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = keys.withColumn("__c", F.last("__last", ignorenulls=True).over(before)).select(*by, "__s", "__c")
    out = inside.filter("__left = 1").join(carried, [*by, "__s"], "left")
    return out.withColumn(name, F.coalesce("__in", "__c")).drop("__t", "__v", "__left", "__s", "__in", "__c")


def interval_join(points: DataFrame, intervals: DataFrame, position: str, start: str, end: str, bin_size: int, by: list[str] | None = None) -> DataFrame:
    """Rows of both sides where start <= position < end, by an equality join on bins of positions.

    An interval is held once in every bin that it touches, so bins should be about as wide as intervals are long.
    """
    by = by or []
    low, high = F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size)
    held = intervals.filter(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(low, high)))
    found = points.withColumn("__bin", F.floor(F.col(position) / bin_size)).join(held, [*by, "__bin"])
    return found.filter((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("__bin")


def interval_counts(points: DataFrame, intervals: DataFrame, key: str, position: str, start: str, end: str, bin_size: int, by: list[str] | None = None) -> DataFrame:
    """(key, n): how many points lie in the intervals of each key; keys without any are left out.

    Points of equal position and equal intervals are counted first, so what meets is the different ones.
    """
    by = by or []
    held = points.groupBy(*by, position).agg(F.count("*").alias("__n"))
    spans = intervals.select(*by, start, end).distinct()
    found = interval_join(held, spans, position, start, end, bin_size, by).groupBy(*by, start, end).agg(F.sum("__n").alias("__n"))
    return intervals.join(found, [*by, start, end]).groupBy(key).agg(F.sum("__n").alias("n"))


def grouping_totals(rows: DataFrame, keys: list[str], value: str, kind: str = "cube") -> DataFrame:
    """Counts and sums for every combination (cube) or prefix (rollup) of the keys; level tells which keys are summed away."""
    grouped = {"cube": rows.cube, "rollup": rows.rollup}[kind](*keys)
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def pivot_counts(rows: DataFrame, key, column: str, values: list[str]) -> DataFrame:
    """Counts by key with a column for each given value; zeros where there is none."""
    return rows.groupBy(key).pivot(column, values).count().na.fill(0, values)


def cell_fraction_split(obs: DataFrame, group: str, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """(group, n, split): groups in hash order go to valid as long as each brings its rows strictly closer to the share.

    The walk is sequential over the groups, of which there is one small row each; they are folded in one array.
    """
    sizes = obs.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).withColumn("h", hash_order(seed, "g"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("h", "g", "n"))).alias("all"), F.sum("n").alias("total"))
    target = F.lit(valid) * F.col("total")
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<string>").alias("names"))

    def step(acc, x):
        fits = F.abs(acc["held"] + x["n"] - target) < F.abs(acc["held"] - target)
        return F.struct(F.when(fits, acc["held"] + x["n"]).otherwise(acc["held"]).alias("held"), F.when(fits, F.concat(acc["names"], F.array(x["g"]))).otherwise(acc["names"]).alias("names"))

    chosen = listed.select(F.explode(F.aggregate("all", start, step)["names"]).alias("g"), F.lit("valid").alias("split"))
    return sizes.join(chosen, "g", "left").select(F.col("g").alias(group), "n", F.coalesce("split", F.lit("train")).alias("split"))


def count_checks(counts: DataFrame, cells: int = 100) -> DataFrame:
    """One row: is_discrete (the first cells' totals are whole numbers) and is_log_transformed (the greatest value is below 15)."""
    first = counts.select("cell_id").distinct().orderBy("cell_id").limit(cells)
    sums = counts.join(F.broadcast(first), "cell_id").groupBy("cell_id").agg(F.sum("value").alias("s"))
    whole = sums.agg(F.coalesce(F.every(F.abs(F.col("s") - F.floor("s")) < 1e-7), F.lit(True)).alias("is_discrete"))
    top = counts.agg((F.max("value") < 15.0).alias("is_log_transformed"))
    return whole.join(top, F.lit(True))


# Molecules
def molecule_classes(bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, bits, n) and (id, cls): classes of molecules of equal bits, named after the greatest id; those without bits are in none."""
    rows = cut_lineage(bits.select("id", F.array_sort(F.array_distinct("bits")).alias("bits")).filter(F.size("bits") > 0))
    classes = cut_lineage(rows.groupBy("bits").agg(F.max("id").alias("cls"), F.count("*").alias("n")))
    return classes, rows.join(classes.select("bits", "cls"), "bits").select("id", "cls")


def similar_molecules(bits: DataFrame, cutoff: float = 0.6, slice_rows: int = 1000) -> DataFrame:
    """(i, j, tanimoto), i < j, of pairs at or above the cutoff; `bits` holds (id, bits array<int>), the bits being distinct.

    Only classes of equal bits are compared; their pairs are then listed by members. Of a class pair one side is cut
    into slices of about `slice_rows` members, so no task lists the pairs of a large class alone.
    """
    classes, members = molecule_classes(bits)
    members = cut_lineage(members)
    apart = _similar_sets(classes.select(F.col("cls").alias("id"), "bits"), cutoff)
    alike = classes.select(F.col("cls").alias("i"), F.col("cls").alias("j"), F.lit(1.0).alias("tanimoto"))
    sized = classes.select(F.col("cls").alias("i"), (F.floor(F.col("n") / slice_rows) + 1).alias("slices"))
    pairs = apart.unionByName(alike.filter(F.lit(cutoff) <= 1.0)).join(sized, "i").withColumnsRenamed({"i": "ci", "j": "cj"})
    left = members.select(F.col("id").alias("a"), F.col("cls").alias("ci")).join(pairs, "ci").withColumn("slice", F.pmod(F.xxhash64("a"), "slices")).drop("slices")
    right = members.select(F.col("id").alias("b"), F.col("cls").alias("cj")).join(pairs.drop("tanimoto"), "cj")
    right = right.select("b", "ci", "cj", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    # A fixed number of parts: by their bytes the few rows of either side would go to one task, which would list all pairs.
    parts = 8 * bits.sparkSession.sparkContext.defaultParallelism
    left, right = left.repartition(parts, "ci", "cj", "slice"), right.repartition(parts, "ci", "cj", "slice")
    found = left.join(right, ["ci", "cj", "slice"]).filter("ci <> cj or a < b")
    return found.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "tanimoto")


def _similar_sets(rows: DataFrame, cutoff: float) -> DataFrame:
    """(i, j, tanimoto), i < j, of pairs at or above the cutoff; `rows` holds (id, bits) with at least one bit, all distinct.

    Prefix filter: a pair at the cutoff must share one of the rarest size - ceil(cutoff * size) + 1 bits of each side, so
    only molecules that share such a bit meet, and of those only sizes that can reach the cutoff are compared.
    """
    often = rows.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("f"))
    ranked = rows.select("id", F.explode("bits").alias("bit")).join(often, "bit").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "bit"))).alias("r"))
    n = F.size("r")
    prefix = F.slice("r", F.lit(1), n - F.ceil(n * F.lit(cutoff) - 1e-9).cast("int") + 1)
    keyed = ranked.select("id", F.transform("r", lambda x: x["bit"]).alias("bits"), F.explode(F.transform(prefix, lambda x: x["bit"])).alias("bit"))
    a = keyed.select(F.col("id").alias("i"), F.col("bits").alias("x"), "bit")
    b = keyed.select(F.col("id").alias("j"), F.col("bits").alias("y"), "bit")
    fits = (F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * F.lit(cutoff) - 1e-9) & (F.col("i") < F.col("j"))
    shared = F.size(F.array_intersect("x", "y"))
    value = shared / (F.size("x") + F.size("y") - shared)
    found = a.join(b, "bit").filter(fits).select("i", "j", value.alias("tanimoto")).filter(F.col("tanimoto") >= F.lit(cutoff) - 1e-12)
    return found.distinct()


def butina_clusters(ids: DataFrame, pairs: DataFrame, copies: str | None = None) -> DataFrame:
    """(id, cluster): every row's cluster by Butina's rule, named after its centre.

    The free row with the most neighbours (ties: the greatest id) takes all that are free. Rounds settle every row that no
    neighbour within two steps outranks, so the centres of a round cannot touch each other's members; the result is the
    same as taking the rows one by one. Neighbour counts are those of the start, as the usual implementation sorts once.
    `copies` names the column of `ids` that says for how many equal rows, neighbours of each other, a row stands (named
    after their greatest id); without it each stands for itself.
    """
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    sized = ids.groupBy("id").agg((F.first(copies) if copies else F.lit(1)).cast("long").alias("m"))
    degree = both.join(sized.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.sum("m").alias("d"))
    free = cut_lineage(sized.join(degree, "id", "left").select("id", (F.coalesce("d", F.lit(0)) + F.col("m") - 1).alias("d")))
    edges, done = cut_lineage(both), None
    rank = lambda d, i: F.struct((-F.col(d)).alias("d"), (-F.col(i)).alias("i"))
    while True:
        alone = free.join(edges.select(F.col("i").alias("id")).distinct(), "id", "left_anti")
        some = alone.select("id", F.col("id").alias("cluster"))
        # Centres: rows that rank first among all rows within two steps.
        e = edges.join(free.select(F.col("id").alias("j"), F.col("d").alias("dj")), "j")
        near = e.groupBy(F.col("i").alias("id")).agg(F.min(rank("dj", "j")).alias("near"))
        best = free.join(near, "id").withColumn("best", F.least(rank("d", "id"), F.col("near")))
        e2 = edges.join(best.select(F.col("id").alias("j"), F.col("best").alias("bj")), "j")
        far = e2.groupBy(F.col("i").alias("id")).agg(F.min("bj").alias("far"))
        centres = best.join(far, "id").filter((F.least("best", "far") == rank("d", "id"))).select("id")
        taken = edges.join(centres.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id"), F.col("i").alias("cluster"))
        some = cut_lineage(some.unionByName(centres.select("id", F.col("id").alias("cluster"))).unionByName(taken))
        done = some if done is None else cut_lineage(done.unionByName(some))
        free = cut_lineage(free.join(some, "id", "left_anti"))
        if not free.limit(1).count():
            return done
        gone = some.select("id")
        edges = edges.join(gone.select(F.col("id").alias("i")), "i", "left_anti").join(gone.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j")
        edges = cut_lineage(edges)


def molecule_clusters(bits: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(id, cluster) by Butina's rule over molecules (id, bits): as butina_clusters over similar_molecules, by classes of equal bits.

    Equal molecules have the same neighbours, so a class is taken whole; no pair of copies is listed.
    """
    classes, members = molecule_classes(bits)
    pairs = cut_lineage(_similar_sets(classes.select(F.col("cls").alias("id"), "bits"), cutoff))
    found = butina_clusters(classes.select(F.col("cls").alias("id"), "n"), pairs, "n").withColumnRenamed("id", "cls")
    placed = members.join(found, "cls").select("id", "cluster")
    bare = bits.filter(F.coalesce(F.size("bits"), F.lit(0)) <= 0).select("id", F.col("id").alias("cluster"))
    return placed.unionByName(bare)


def cluster_split(rows: DataFrame, clusters: DataFrame, key: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Whole clusters, largest first, to train, valid and test; rows without a cluster (invalid molecules) go to train."""
    total = rows.count()
    sizes = global_running(clusters.groupBy("cluster").agg(F.count("*").alias("g")), [F.col("g").desc(), F.col("cluster")], ["g"])
    before = F.col("g_sum") - F.col("g")
    part = F.when(before < F.lit(train * total), "train").when(before < F.lit((train + valid) * total), "valid").otherwise("test")
    placed = clusters.join(sizes.select("cluster", part.alias("split")), "cluster").select(F.col("id").alias(key), "split")
    return rows.join(placed, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def scaffold_split(rows: DataFrame, key: str, scaffold: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Whole scaffolds, largest first (ties by name); rows without a scaffold form the group of the empty one."""
    named = rows.select(F.col(key).alias("id"), F.coalesce(F.col(scaffold), F.lit("")).alias("cluster"))
    return cluster_split(rows, named, key, train, valid)


# Sequences
def identity_pairs(sequences: DataFrame, threshold: float, id_col: str = "seq_id", seq_col: str = "sequence", block_rows: int = 256) -> DataFrame:
    """(i, j), i < j, of sequences whose identity over the common prefix length exceeds the threshold.

    All pairs by definition: sequences meet in pairs of blocks, whose tasks hand on only what they find.
    """
    import numpy as np
    import pyarrow as pa

    rows = sequences.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(seq_col), F.lit("")), "UTF-8").alias("s"))
    parts = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("id", "s", block.alias("bi"), every.alias("bj")).filter("bi <= bj")
    right = rows.select(F.col("id").alias("id2"), F.col("s").alias("s2"), block.alias("bj2"), every.alias("bi2")).filter("bi2 <= bj2")

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ids, other = a.column(0).to_numpy(), b.column(0).to_numpy()
        texts = [np.frombuffer(x, np.uint8) for x in b.column(1).to_pylist()]
        n = np.array([len(t) for t in texts], np.int64)
        wide = np.zeros((len(texts), int(n.max(initial=0))), np.uint8)
        for k, t in enumerate(texts):
            wide[k, : len(t)] = t
        for i, x in zip(ids.tolist(), a.column(1).to_pylist()):
            x = np.frombuffer(x, np.uint8)
            m = min(len(x), wide.shape[1])
            # Places beyond a sequence hold 0, which no letter is.
            same = (wide[:, :m] == x[:m]).sum(1)
            common = np.minimum(n, len(x))
            hit = (common > 0) & (same > threshold * common) & (other != i)
            found.append((np.minimum(i, other[hit]), np.maximum(i, other[hit])))
        return pa.table({"i": np.concatenate([f[0] for f in found]), "j": np.concatenate([f[1] for f in found])})

    return left.groupBy("bi", "bj").cogroup(right.groupBy("bi2", "bj2")).applyInArrow(run, "i long, j long").distinct()


def greedy_representatives(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, representative) of greedy clustering in id order: a row joins the first representative that it is paired with, or becomes one.

    Rounds settle rows: one whose open smaller partners are none is a representative, and its partners are not. The result
    is that of the sequential walk; the rounds are as many as the longest chain of decisions.
    """
    both = cut_lineage(pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    left, chosen = cut_lineage(ids.select("id").distinct()), None
    while True:
        blocked = both.filter("j < i").join(left.select(F.col("id").alias("i")), "i", "left_semi").join(left.select(F.col("id").alias("j")), "j", "left_semi")
        fresh = cut_lineage(left.join(blocked.select(F.col("i").alias("id")).distinct(), "id", "left_anti"))
        chosen = fresh if chosen is None else cut_lineage(chosen.unionByName(fresh))
        covered = both.join(fresh.select(F.col("id").alias("j")), "j", "left_semi").select(F.col("i").alias("id"))
        left = cut_lineage(left.join(fresh.unionByName(covered).distinct(), "id", "left_anti"))
        if not left.limit(1).count():
            break
    near = both.join(chosen.select(F.col("id").alias("j")), "j", "left_semi").groupBy(F.col("i").alias("id")).agg(F.min("j").alias("r"))
    own = chosen.withColumn("own", F.col("id"))
    return ids.select("id").distinct().join(own, "id", "left").join(near, "id", "left").select("id", F.coalesce("own", "r").alias("representative"))


def identity_clusters(sequences: DataFrame, threshold: float = 0.8, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """(id, representative): greedy clusters of sequences, in id order."""
    pairs = cut_lineage(identity_pairs(sequences, threshold, id_col, seq_col))
    return greedy_representatives(sequences.select(F.col(id_col).cast("long").alias("id")), pairs)


def identity_split(rows: DataFrame, threshold: float = 0.8, key: str = "seq_id", seq_col: str = "sequence", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Whole clusters of similar sequences to train, valid and test."""
    clusters = cut_lineage(identity_clusters(rows, threshold, key, seq_col).withColumnRenamed("representative", "cluster"))
    return cluster_split(rows, clusters, key, train, valid)
