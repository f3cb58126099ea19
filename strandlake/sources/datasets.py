"""Benchmark datasets on the star schema, a metadata cache, and seeded generators of training data.

A dataset is a folder of Parquet tables (counts, obs, obsm), as `readers.write_star` makes it; annotated HDF5 files become
such folders with `from_annotated_file` where h5py can be imported. Generators draw from hashes of row numbers, so they
give the same rows whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.numeric import hash_order, hash_uniform
from strandlake.functions.order import global_running
from strandlake.operators import cells as C
from strandlake.operators import splitting as S
from strandlake.sources.readers import read_star

#: Width of an embedding that a dataset lacks.
EMBEDDING_WIDTH = 50


def subsample(obs: DataFrame, n: int | None, key: str = "cell_id", seed: int = 42) -> DataFrame:
    """n cells without replacement, by the order of a hash of the key; all of them where n is None or no smaller."""
    if n is None:
        return obs
    placed = global_running(obs.withColumn("__h", hash_order(seed, key)), [F.col("__h"), F.col(key)], position="__k")
    return placed.filter(F.col("__k") <= n).drop("__h", "__k")


def load_benchmark(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """counts and obs of a star folder, cut to the same subsample of cells."""
    t = read_star(spark, path, ("counts", "obs"))
    obs = subsample(t["obs"], n, seed=seed)
    return {"obs": obs, "counts": t["counts"].join(obs.select("cell_id"), "cell_id", "left_semi")}


def expression_embedding(counts: DataFrame, k: int = EMBEDDING_WIDTH) -> DataFrame:
    """(cell_id, vec): log1p(1e4 x / total), centred, projected on the leading singular vectors of the genes.

    The genes' Gram matrix is summed from pairs of genes within a cell; centring subtracts the means' outer product.
    """
    import numpy as np

    from strandlake.operators.reduction import signed

    x = C.normalize_counts(counts)
    n = counts.select("cell_id").distinct().count()
    sums = {r["gene_id"]: r["s"] / n for r in x.groupBy("gene_id").agg(F.sum("value").alias("s")).collect()}
    genes = sorted(sums)
    at = {g: i for i, g in enumerate(genes)}
    listed = x.groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("xs"))
    pairs = listed.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b"))
    m = np.zeros((len(genes), len(genes)))
    for r in pairs.groupBy(F.col("a.gene_id").alias("a"), F.col("b.gene_id").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("s")).collect():
        m[at[r["a"]], at[r["b"]]] = r["s"]
    mean = np.array([sums[g] for g in genes])
    values, vectors = np.linalg.eigh(m - n * np.outer(mean, mean))
    v = signed(vectors[:, np.argsort(-values)[: min(k, len(genes))]])
    table = F.broadcast(counts.sparkSession.createDataFrame([(g, v[i].tolist()) for g, i in at.items()], "gene_id string, c array<double>"))
    shift = (mean @ v).tolist()
    got = x.join(table, "gene_id").groupBy("cell_id").agg(F.array(*[F.sum(F.col("value") * F.col("c")[i]) - shift[i] for i in range(v.shape[1])]).alias("vec"))
    return got


def immune_human(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """counts, obs with batch_code and label_code, and an embedding (cell_id, vec), computed where the folder has none."""
    t = load_benchmark(spark, path, n, seed)
    obs = S.label_codes(S.label_codes(t["obs"], "batch", "batch_code"), "cell_type", "label_code")
    try:
        vec = spark.read.parquet(f"{path}/obsm").filter("key = 'X_pca'").select("cell_id", "vec").join(obs.select("cell_id"), "cell_id", "left_semi")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        vec = expression_embedding(t["counts"])
    return {"counts": t["counts"], "obs": obs, "embedding": vec}


def pancreas(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Layers (cell_id, gene_id, spliced, unspliced), obs with cluster codes, and an embedding, zeros where there is none."""
    obs = S.label_codes(subsample(spark.read.parquet(f"{path}/obs"), n, seed=seed), "cell_type", "cluster")
    long = spark.read.parquet(f"{path}/layers").join(obs.select("cell_id"), "cell_id", "left_semi")
    pick = lambda name: F.coalesce(F.sum(F.when(F.col("layer") == name, F.col("value"))), F.lit(0.0)).alias(name)
    layers = long.groupBy("cell_id", "gene_id").agg(pick("spliced"), pick("unspliced"))
    zeros = F.array_repeat(F.lit(0.0), EMBEDDING_WIDTH)
    return {"layers": layers, "obs": obs, "embedding": obs.select("cell_id", zeros.alias("vec"))}


def seqfish(spark: SparkSession, path: str, n: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """counts, and obs with label codes and coordinates x and y, rows without coordinates left out."""
    t = load_benchmark(spark, path, n, seed)
    placed = t["obs"].filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return {"counts": t["counts"].join(placed.select("cell_id"), "cell_id", "left_semi"), "obs": S.label_codes(placed, "cell_type", "label_code")}


class MetadataCache:
    """The perturbation, cell type and batch columns of star folders: counts are never read; one table is kept for each path."""

    def __init__(self, spark: SparkSession, perturbation: str = "perturbation", cell_type: str = "cell_type", batch: str = "batch"):
        self.spark, self.columns = spark, ("cell_id", perturbation, cell_type, batch)
        self.held: dict[str, DataFrame] = {}

    def get(self, path: str) -> DataFrame:
        """(cell_id, perturbation, cell_type, batch) of a folder, cached after the first reading."""
        if path not in self.held:
            self.held[path] = self.spark.read.parquet(f"{path}/obs").select(*self.columns).cache()
        return self.held[path]

    def categories(self, path: str, column: str) -> list[str]:
        """The sorted values of a column."""
        return [r[0] for r in self.get(path).select(column).distinct().orderBy(column).collect()]

    def clear(self) -> None:
        for t in self.held.values():
            t.unpersist()
        self.held = {}


_CACHES: dict[str, MetadataCache] = {}


def metadata_cache(spark: SparkSession) -> MetadataCache:
    """The one cache of a Spark application."""
    return _CACHES.setdefault(spark.sparkContext.applicationId, MetadataCache(spark))


def from_annotated_file(spark: SparkSession, source: str, path: str, rows: int = 4096) -> None:
    """Copy a dense or compressed-row annotated HDF5 file to a star folder, a block of cells at a time. Needs h5py."""
    import h5py

    with h5py.File(source, "r") as f:
        names = lambda g: [x.decode() if isinstance(x, bytes) else str(x) for x in g[g.attrs.get("_index", "_index")][:]]
        cells, genes, x = names(f["obs"]), names(f["var"]), f["X"]
        dense = not hasattr(x, "keys")
        for low in range(0, len(cells), rows):
            out = []
            for i in range(low, min(low + rows, len(cells))):
                if dense:
                    out += [(cells[i], genes[j], float(v)) for j, v in enumerate(x[i]) if v]
                else:
                    a, b = int(x["indptr"][i]), int(x["indptr"][i + 1])
                    out += [(cells[i], genes[int(j)], float(v)) for j, v in zip(x["indices"][a:b], x["data"][a:b])]
            spark.createDataFrame(out, "cell_id string, gene_id string, value double").write.mode("append").parquet(f"{path}/counts")
        spark.createDataFrame([(c,) for c in cells], "cell_id string").write.mode("append").parquet(f"{path}/obs")


# Generators
def _letter(seed: int, *ids):
    return F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.floor(hash_uniform(seed, *ids) * 4) + 1).cast("int"))


def training_reads(spark: SparkSession, samples: int, reads: int, read_length: int, length: int, variant_rate: float = 0.01, heterozygous: float = 0.0, error_rate: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """reference (sample, position, ref), variants (sample, position, alt, genotype) and reads (sample, read, position, base, quality).

    A site is a variant with a chance of variant_rate: its alternative is another base, its genotype 1 with the chance
    `heterozygous`, else 2; a read of a heterozygous site shows the alternative half the time. Bases turn into another one
    with a chance of error_rate, which lowers their quality.
    """
    sites = spark.range(samples).withColumnRenamed("id", "sample").withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    shift = lambda base, s, *ids: F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.pmod(F.instr(F.lit("ACGT"), base) - 1 + 1 + F.floor(hash_uniform(s, *ids) * 3).cast("int"), F.lit(4)) + 1).cast("int"))
    sites = sites.withColumn("ref", _letter(seed, "sample", "position"))
    is_variant = hash_uniform(seed + 1, "sample", "position") < variant_rate
    sites = sites.withColumn("alt", F.when(is_variant, shift(F.col("ref"), seed + 2, "sample", "position")))
    sites = sites.withColumn("genotype", F.when(F.col("alt").isNull(), 0).when(hash_uniform(seed + 3, "sample", "position") < heterozygous, 1).otherwise(2))
    starts = spark.range(samples).withColumnRenamed("id", "sample").withColumn("read", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reads - 1).cast("long"))))
    starts = starts.withColumn("start", F.floor(hash_uniform(seed + 4, "sample", "read") * (length - read_length + 1)))
    bases = starts.withColumn("position", F.explode(F.sequence(F.col("start"), F.col("start") + read_length - 1)))
    held = bases.join(sites, ["sample", "position"])
    shows = (F.col("genotype") == 2) | ((F.col("genotype") == 1) & (hash_uniform(seed + 5, "sample", "read", "position") < 0.5))
    held = held.withColumn("true", F.when(shows, F.col("alt")).otherwise(F.col("ref")))
    wrong = hash_uniform(seed + 6, "sample", "read", "position") < error_rate
    held = held.withColumn("base", F.when(wrong, shift(F.col("true"), seed + 7, "sample", "read", "position")).otherwise(F.col("true")))
    held = held.withColumn("quality", F.when(wrong, 10.0).otherwise(30.0) + F.floor(hash_uniform(seed + 8, "sample", "read", "position") * 10))
    return {
        "reference": sites.select("sample", "position", "ref"),
        "variants": sites.filter("alt is not null").select("sample", "position", "alt", "genotype"),
        "reads": held.select("sample", "read", "position", "base", "quality"),
    }


def motif_sequences(spark: SparkSession, per_class: int, length: int, motifs: tuple[str, ...] = ("TATAAA", "GCGCGC"), seed: int = 42) -> DataFrame:
    """(sequence_id, label, sequence): random letters with the class's motif written at a random place."""
    rows = spark.range(per_class * len(motifs)).withColumnRenamed("id", "sequence_id").withColumn("label", F.pmod("sequence_id", F.lit(len(motifs))))
    letters = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: _letter(seed, "sequence_id", i))
    motif = F.element_at(F.array(*[F.lit(m) for m in motifs]), (F.col("label") + 1).cast("int"))
    rows = rows.withColumns({"text": F.concat_ws("", letters), "motif": motif})
    place = F.floor(hash_uniform(seed + 1, "sequence_id") * (length - F.length("motif") + 1))
    whole = F.concat(F.substring("text", F.lit(1), place.cast("int")), F.col("motif"), F.substring("text", (place + F.length("motif") + 1).cast("int"), F.lit(length)))
    return rows.select("sequence_id", "label", whole.alias("sequence"))


def contextual_epigenomics(spark: SparkSession, examples: int, length: int, factors: int = 4, classes: int = 2, seed: int = 42) -> dict[str, DataFrame]:
    """positions (example, pos, base, tf array, target) and symmetric contacts (ex, i, j, v): targets follow the factors' sum."""
    rows = spark.range(examples).withColumnRenamed("id", "example").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    tf = F.transform(F.sequence(F.lit(0), F.lit(factors - 1)), lambda k: hash_uniform(seed + 1, "example", "pos", k))
    rows = rows.withColumns({"base": _letter(seed, "example", "pos"), "tf": tf})
    total = F.aggregate("tf", F.lit(0.0), lambda a, v: a + v) / factors
    rows = rows.withColumn("target", F.least(F.floor(total * classes), F.lit(classes - 1)).cast("long"))
    pairs = rows.select(F.col("example").alias("ex"), F.col("pos").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    return {"positions": rows, "contacts": pairs.withColumn("v", F.exp(-F.abs(F.col("i") - F.col("j")) / 8.0) * hash_uniform(seed + 2, "ex", low, high))}


def contextual_violations(positions: DataFrame, contacts: DataFrame, factors: int, classes: int, tolerance: float = 1e-6) -> DataFrame:
    """(rule, n) of broken rules of a contextual dataset; an empty result means that the contract holds."""
    from strandlake.sources.readers import symmetric_contacts

    rule = lambda name, n: n.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    parts = [
        rule("base letter", positions.filter(~F.col("base").isin(*"ACGT") | F.col("base").isNull())),
        rule("factor width", positions.filter(F.size("tf") != factors)),
        rule("target class", positions.filter((F.col("target") < 0) | (F.col("target") >= classes) | F.col("target").isNull())),
        rule("symmetric contacts", symmetric_contacts(contacts, tolerance)),
        rule("contacts not negative", contacts.filter("v < 0")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")
