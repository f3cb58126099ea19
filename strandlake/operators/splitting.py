"""Splitters, samplers and control matching. All randomness is a hash order of ids, so results never depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.numeric import hash_order
from strandlake.functions.order import global_running


def _numbered(rows: DataFrame, seed: int, key: str, by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in hash order, within groups; n is the group's size.

    Without groups the order is global: rows are ranked within slices of the hash and the slices' sizes are added up, so
    no single task sorts everything.
    """
    rows = rows.withColumn("__h", hash_order(seed, key))
    if by:
        w = Window.partitionBy(*by)
        return rows.withColumn("rn", F.row_number().over(w.orderBy("__h", key)) - 1).withColumn("n", F.count("*").over(w)).drop("__h")
    rows = rows.withColumn("__s", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    sizes = rows.groupBy("__s").agg(F.count("*").alias("c"))
    # At most 256 rows.
    starts = sizes.withColumn("start", F.sum("c").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.withColumn("n", F.sum("c").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__h", key)) - 1
    found = rows.withColumn("__p", place).join(F.broadcast(starts), "__s")
    return found.withColumn("rn", F.col("__p") + F.coalesce("start", F.lit(0))).drop("__h", "__s", "__p", "c", "start")


def _parts(rn, n, train: float, valid: float):
    return F.when(rn < F.floor(n * F.lit(train)), "train").when(rn < F.floor(n * F.lit(train + valid)), "valid").otherwise("test")


def random_split(rows: DataFrame, key: str, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """A column split: train, valid or test, by hash order and integer cut points."""
    return _numbered(rows, seed, key).withColumn("split", _parts(F.col("rn"), F.col("n"), train, valid)).drop("rn", "n")


def k_fold(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """A column fold of 0 to k-1; the last fold takes the remainder."""
    size = F.floor(F.col("n") / k)
    return _numbered(rows, seed, key).withColumn("fold", F.least(F.floor(F.col("rn") / size), F.lit(k - 1))).drop("rn", "n")


def stratified_split(rows: DataFrame, key: str, label: str, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """As random_split, within each label."""
    return _numbered(rows, seed, key, [label]).withColumn("split", _parts(F.col("rn"), F.col("n"), train, valid)).drop("rn", "n")


def clamped_split(rows: DataFrame, key: str, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """A split that leaves at least one row in each part (three rows or more)."""
    n = F.col("n")
    a = F.least(F.greatest(F.floor(n * F.lit(train)), F.lit(1)), n - 2)
    b = F.least(F.greatest(a + F.floor(n * F.lit(valid)), a + 1), n - 1)
    out = _numbered(rows, seed, key)
    return out.withColumn("split", F.when(F.col("rn") < a, "train").when(F.col("rn") < b, "valid").otherwise("test")).drop("rn", "n")


def order_split(rows: DataFrame, position: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Cut points on a 0-based position that the file order gave."""
    total = rows.agg(F.count("*").alias("__n"))
    out = rows.join(F.broadcast(total), F.lit(True))
    a, b = F.floor(F.col("__n") * F.lit(train)), F.floor(F.col("__n") * F.lit(train)) + F.floor(F.col("__n") * F.lit(valid))
    return out.withColumn("split", F.when(F.col(position) < a, "train").when(F.col(position) < b, "valid").otherwise("test")).drop("__n")


def group_split(rows: DataFrame, group: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Whole groups, largest first (ties by name), to train while the rows before are below the cut, then valid, then test."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("g"))
    total = F.broadcast(sizes.agg(F.sum("g").alias("total")))
    placed = global_running(sizes, [F.col("g").desc(), F.col(group)], ["g"]).withColumn("before", F.col("g_sum") - F.col("g")).join(total, F.lit(True))
    part = F.when(F.col("before") < F.lit(train) * F.col("total"), "train").when(F.col("before") < F.lit(train + valid) * F.col("total"), "valid").otherwise("test")
    return rows.join(placed.select(group, part.alias("split")), group)


def zero_shot_split(rows: DataFrame, key: str, kind: str, held_out: list[str], train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Held-out kinds are test; the others are shuffled into train and valid in the ratio of their shares."""
    rest = _numbered(rows.filter(~F.col(kind).isin(held_out)), seed, key)
    cut = F.floor(F.col("n") * F.lit(train / (train + valid)))
    seen = rest.withColumn("split", F.when(F.col("rn") < cut, "train").otherwise("valid")).drop("rn", "n")
    return seen.unionByName(rows.filter(F.col(kind).isin(held_out)).withColumn("split", F.lit("test")))


def few_shot_split(rows: DataFrame, key: str, kind: str, held_out: list[str], control: str, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Held-out perturbations are test and controls train; of the others a share is valid, one row at least."""
    test = rows.filter(F.col(kind).isin(held_out)).withColumn("split", F.lit("test"))
    controls = rows.filter(F.col(kind) == control).withColumn("split", F.lit("train"))
    rest = _numbered(rows.filter(~F.col(kind).isin([*held_out, control])), seed, key)
    n_valid = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(valid)))
    rest = rest.withColumn("split", F.when(F.col("rn") < n_valid, "valid").otherwise("train")).drop("rn", "n")
    return rest.unionByName(controls).unionByName(test)


def control_mapping(obs: DataFrame, n_basal: int = 1, control: str = "non-targeting", by_batch: bool = False, seed: int = 42) -> DataFrame:
    """(cell_id, slot, control_id): n_basal controls of the same cell type for each perturbed cell; -1 where there is none.

    Pools are in hash order and a cell starts at its own hashed place and walks round its pool, so a control repeats for
    one cell only if its pool is smaller than n_basal. With by_batch the pool of the same batch comes first, then the cell
    type's.
    """
    perturbed = obs.filter(F.col("perturbation") != control).select("cell_id", "cell_type", "batch")
    slots = perturbed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_basal - 1))))
    start = F.conv(F.substring(hash_order(seed + 1, "cell_id"), 1, 8), 16, 10).cast("long")

    def match(keys, name):
        pool = _numbered(obs.filter(F.col("perturbation") == control).select(F.col("cell_id").alias("control"), *keys), seed, "control", keys)
        sizes = pool.groupBy(*keys).agg(F.max("n").alias("size"))
        wanted = slots.join(sizes, keys, "left").withColumn("rn", F.pmod(start + F.col("slot"), F.col("size")).cast("int"))
        return wanted.join(pool.drop("n"), [*keys, "rn"], "left").select("cell_id", "slot", F.col("control").alias(name))

    found = match(["cell_type"], "c1")
    if by_batch:
        found = found.join(match(["cell_type", "batch"], "c2"), ["cell_id", "slot"])
        return found.select("cell_id", "slot", F.coalesce("c2", "c1", F.lit(-1)).alias("control_id"))
    return found.select("cell_id", "slot", F.coalesce("c1", F.lit(-1)).alias("control_id"))


def perturbation_batches(cells: DataFrame, key: str, group: str, sentence: int = 8, per_batch: int = 4, most: int | None = None, drop_last: bool = False, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(key, group, sentence_id, batch): groups in hash order cut into sentences, sentences shuffled and packed into batches."""
    r = _numbered(cells.select(key, group), seed + epoch, key, [group])
    if most:
        r = r.filter(F.col("rn") < most)
    r = r.withColumn("sentence_id", F.concat_ws(":", F.col(group), F.floor(F.col("rn") / sentence).cast("string")))
    s = _numbered(r.select("sentence_id").distinct(), seed + epoch, "sentence_id").withColumn("batch", F.floor(F.col("rn") / per_batch))
    if drop_last:
        s = s.filter(F.col("batch") < F.floor(F.col("n") / per_batch))
    return r.drop("rn", "n").join(s.select("sentence_id", "batch"), "sentence_id").select(key, group, "sentence_id", "batch")


def deterministic_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order, without replacement."""
    return rows.withColumn("__h", hash_order(seed, key)).orderBy("__h", key).limit(n).drop("__h")


def sequential_batches(rows: DataFrame, position: str, size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor(F.col(position) / size))


def label_codes(rows: DataFrame, label: str, code: str = "code") -> DataFrame:
    """0-based codes of labels in sorted order, joined back."""
    coded = global_running(rows.select(label).distinct(), [F.col(label)], position=code).withColumn(code, (F.col(code) - 1).cast("long"))
    return rows.join(F.broadcast(coded) if _few(coded) else coded, label)


def _few(coded: DataFrame, most: int = 100_000) -> bool:
    return coded.limit(most + 1).count() <= most


def one_hot_map(rows: DataFrame, label: str) -> DataFrame:
    """(label, vec): sorted one-hot vectors of the labels."""
    coded = label_codes(rows.select(label).distinct(), label)
    n = coded.agg(F.max("code").alias("m")).first()["m"] + 1
    return coded.select(label, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("code")).cast("double")).alias("vec"))


def perturbation_table(obs: DataFrame, control: str = "non-targeting") -> DataFrame:
    """obs with codes of perturbation, cell type and batch, a control mask and the group code type * n_pert + pert."""
    out = label_codes(label_codes(label_codes(obs, "perturbation", "pert_code"), "cell_type", "cell_type_code"), "batch", "batch_code")
    n = obs.select("perturbation").distinct().count()
    return out.withColumns({"is_control": F.col("perturbation") == control, "group_code": F.col("cell_type_code") * n + F.col("pert_code")})


def align_to_reference(artifact: DataFrame, reference: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of an embedding artifact in the reference's order; an error unless both sides hold the same unique ids."""
    for name, side in (("artifact", artifact), ("reference", reference)):
        if side.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name} ids repeat")
    missing = [r[0] for r in reference.join(artifact, key, "left_anti").select(key).limit(5).collect()]
    extra = [r[0] for r in artifact.join(reference, key, "left_anti").select(key).limit(5).collect()]
    if missing or extra:
        raise ValueError(f"ids differ: missing {missing}, extra {extra}")
    return artifact.join(reference.select(key, position), key)


def indexed_view(rows: DataFrame, position: str, index: DataFrame, order: str) -> DataFrame:
    """Rows of a source picked by an index table (position, order)."""
    return index.join(rows, position).orderBy(order)


def concat_sources(sources: list[DataFrame]) -> DataFrame:
    """Union with source_idx; codes must be made after it, since every source's own codes start at 0."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_idx", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
