"""Readers of omics text formats and of the star schema. Every reader is a lazy DataFrame over files of any store."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.order import global_running
from strandlake.operators.splitting import label_codes, order_split
from strandlake.session import require_columns


def read_fasta(spark: SparkSession, path: str, handle_n: str = "keep") -> DataFrame:
    """(sequence_id, description, sequence): one row a record; letters in capitals; handle_n drop leaves out N."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", ""))
    if handle_n == "drop":
        seq = F.regexp_replace(seq, "N", "")
    out = raw.filter(F.length(F.trim(body)) > 0).select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("sequence_id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), seq.alias("sequence")
    )
    return out


def write_fasta(sequences: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "sequence") -> None:
    sequences.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col))).write.text(path)


def read_sam(spark: SparkSession, path: str, unmapped: bool = False, least_mapq: int = 0, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Aligned reads of SAM text: name, reference, start (0-based), mapq, sequence and qualities (30 where missing)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    seq = f[9]
    q = F.when(f[10] == "*", F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.lit(30.0))).otherwise(
        F.transform(F.filter(F.split(f[10], ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("double"))
    )
    flag = f[1].cast("int")
    out = lines.select(
        f[0].alias("query_name"), f[2].alias("reference_name"), (f[3].cast("int") - 1).alias("reference_start"), f[4].cast("int").alias("mapping_quality"),
        (flag.bitwiseAND(4) != 0).alias("is_unmapped"), seq.alias("sequence"), q.alias("quality"),
    )
    if not unmapped:
        out = out.filter(~F.col("is_unmapped"))
    out = out.filter(F.col("mapping_quality") >= least_mapq)
    if region:
        name, low, high = region
        out = out.filter((F.col("reference_name") == name) & (F.col("reference_start") >= low) & (F.col("reference_start") < high))
    return out


def read_narrow_peaks(spark: SparkSession, path: str, chromosome: str | None = None, limit: int | None = None) -> DataFrame:
    """narrowPeak rows by (chrom, start); the limit takes rows in file order, before sorting, as one file gives them."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 10).select(
        f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[6].cast("double").alias("signal_value"),
        f[7].cast("double").alias("p_value"), f[8].cast("double").alias("q_value"), f[9].cast("int").alias("summit_offset"),
    )
    if chromosome:
        rows = rows.filter(F.col("chrom") == chromosome)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.orderBy("chrom", "start")


def _first_filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])


DTI_COLUMNS = ("pair_id", "protein_id", "protein_sequence", "drug_id", "drug_smiles")


def read_dti(spark: SparkSession, path: str, sep: str = ",", task: str = "regression") -> DataFrame:
    """Drug-target pairs: the target is the first filled of target, affinity and label."""
    t = spark.read.csv(path, header=True, sep=sep)
    require_columns(t, *DTI_COLUMNS)
    have = [c for c in ("target", "affinity", "label") if c in t.columns]
    return t.select(*DTI_COLUMNS, _first_filled(*have).cast("double").alias("target"), F.lit(task).alias("task_type"))


def read_molecules(spark: SparkSession, path: str, smiles: str, tasks: list[str]) -> DataFrame:
    """(position, smiles, y, split) of a MoleculeNet CSV: split by row order, then rows without SMILES left out."""
    t = spark.read.csv(path, header=True)
    t = global_running(t.withColumn("__m", F.monotonically_increasing_id()), [F.col("__m")], position="position")
    t = t.withColumn("position", F.col("position") - 1)
    y = F.array(*[F.expr(f"try_cast(`{c}` AS double)") for c in tasks])
    rows = t.select("position", F.col(smiles).alias("smiles"), y.alias("y"))
    return order_split(rows, "position").filter(F.length(F.trim(F.coalesce("smiles", F.lit("")))) > 0)


def read_structures(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(name, sequence, structure) of dot-bracket rows of a CSV."""
    t = spark.read.csv(path, header=True)
    rows = t.filter((F.col("ground_truth_type") == "DBN") & (F.length(F.coalesce("ground_truth_data", F.lit(""))) > 0))
    rows = rows.select("name", F.upper("sequence").alias("sequence"), F.col("ground_truth_data").alias("structure"))
    return rows.limit(limit) if limit else rows


def read_families(spark: SparkSession, inputs: str, references: str) -> DataFrame:
    """(family_id, name, sequence, aligned): unaligned and reference sequences of families that have both."""
    family = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)

    def load(path):
        raw = spark.read.option("lineSep", "\n>").text(path).select("value", family.alias("family_id"))
        body = F.regexp_replace("value", "^>", "")
        return raw.select("family_id", F.regexp_extract(body, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "").alias("s"))

    return load(inputs).withColumnRenamed("s", "sequence").join(load(references).withColumnRenamed("s", "aligned"), ["family_id", "name"])


def read_network(spark: SparkSession, expression: str, factors: str, edges: str) -> dict[str, DataFrame]:
    """Expression (gene rows, cell columns) as counts, factors and distinct gold edges among the common genes; n_edges counts repeats."""
    e = spark.read.csv(expression, header=True, sep="\t")
    gene = e.columns[0]
    counts = e.unpivot(gene, e.columns[1:], "cell_id", "value").select("cell_id", F.col(gene).alias("gene_id"), F.col("value").cast("double").alias("value"))
    gold = spark.read.csv(edges, header=True, sep="\t")
    gold = gold.select(F.col(gold.columns[0]).alias("source"), F.col(gold.columns[1]).alias("target"))
    known = counts.select("gene_id").distinct()
    kept = gold.join(known.select(F.col("gene_id").alias("source")), "source", "left_semi").join(known.select(F.col("gene_id").alias("target")), "target", "left_semi")
    tf = spark.read.text(factors).select(F.trim("value").alias("gene_id")).join(known, "gene_id", "left_semi")
    return {"counts": counts, "factors": tf, "edges": kept.distinct(), "n_edges": kept.agg(F.count("*").alias("n_edges"))}


def write_star(path: str, **tables: DataFrame) -> None:
    """Save counts, obs, var and obsm as Parquet below a folder."""
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_star(spark: SparkSession, path: str, names: tuple[str, ...] = ("counts", "obs", "var", "obsm")) -> dict[str, DataFrame]:
    """The star schema of an annotated matrix; reading obs alone never touches counts."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: The preferred embeddings of an annotated matrix, best first.
EMBEDDING_ORDER = ("X_pca", "X_scvi", "X_umap")


def pick_embedding(obsm: DataFrame) -> DataFrame:
    """(cell_id, vec) of the preferred embedding key: X_pca, X_scvi, X_umap, else the first in order."""
    rank = F.array_position(F.array(*[F.lit(k) for k in EMBEDDING_ORDER]), F.col("key"))
    keys = obsm.select("key").distinct().withColumn("r", F.when(rank > 0, rank).otherwise(99))
    best = keys.orderBy("r", "key").limit(1).select("key")
    return obsm.join(F.broadcast(best), "key", "left_semi").select("cell_id", "vec")


def operator_input(obs: DataFrame, library: DataFrame, task: str, batch: str = "batch") -> DataFrame:
    """obs with what a task needs: library size, and a one-hot batch design (a column of ones where there is one batch)."""
    coded = label_codes(obs, batch, "batch_code")
    n = coded.agg(F.max("batch_code").alias("m")).first()["m"] + 1
    design = F.array(F.lit(1.0)) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(int(n - 1))), lambda i: (i == F.col("batch_code")).cast("double"))
    out = coded.join(library, "cell_id", "left")
    return out.withColumn("design", design) if task == "differential_expression" else out


def output_counts(counts: DataFrame, hvg: DataFrame, mode: str) -> DataFrame:
    """all: every gene; gene: the highly variable ones; embedding: none."""
    if mode == "all":
        return counts
    if mode == "gene":
        return counts.join(F.broadcast(hvg.select("gene_id")), "gene_id", "left_semi")
    if mode == "embedding":
        return counts.limit(0)
    raise ValueError(f"unknown output space {mode}")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(row, vec) of an embedding artifact: Parquet, or a NumPy matrix of a local path that the driver reads."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".npy", ".npz")):
        import numpy as np

        held = np.load(path)
        m = held if isinstance(held, np.ndarray) else held[held.files[0]]
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "row long, vec array<double>")
    raise ValueError(f"unknown embedding format: {path}")


class ExperimentConfig:
    """Datasets, training list, zero-shot and few-shot assignments of a TOML experiment."""

    def __init__(self, text: str):
        raw = tomllib.loads(text)
        self.datasets: dict[str, str] = raw.get("datasets", {})
        self.training: dict[str, str] = raw.get("training", {})
        self.zeroshot = {tuple(k.rsplit(".", 1)): v for k, v in raw.get("zeroshot", {}).items()}
        self.fewshot = {tuple(k.rsplit(".", 1)): v for k, v in raw.get("fewshot", {}).items()}
        unknown = {d for d, _ in [*self.zeroshot, *self.fewshot]} - set(self.datasets)
        if unknown:
            raise ValueError(f"unknown datasets: {sorted(unknown)}")

    def held_out(self, spark: SparkSession) -> DataFrame:
        """(dataset, cell_type, perturbation, split); perturbation is null where the whole cell type is held out."""
        rows = [(d, c, None, s) for (d, c), s in self.zeroshot.items()]
        rows += [(d, c, p, s) for (d, c), parts in self.fewshot.items() for s, names in parts.items() for p in names]
        return spark.createDataFrame(rows, "dataset string, cell_type string, perturbation string, split string")


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark problems of a JSON array, nested configurations kept as JSON text."""
    schema = "problem_id string, task_type string, grader_type string, expected_answer string, grader_config string, task_config string, data_path string, description string, source string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def symmetric_contacts(contacts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows (ex, i, j, v) of a contact map whose mirror differs; an empty result means that the contract holds."""
    mirror = contacts.select("ex", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    both = contacts.join(mirror, ["ex", "i", "j"], "left")
    return both.filter(F.abs(F.col("v") - F.coalesce("w", F.lit(0.0))) > tolerance).drop("w")


def synthetic_expression(spark: SparkSession, cells: int = 500, genes: int = 200, types: int = 3, batches: int = 2, seed: int = 42) -> dict[str, DataFrame]:
    """counts and obs of a seeded generator: log-normal type means, additive batch shift, counts floored from gamma-like noise."""
    from strandlake.functions.numeric import hash_normal, hash_uniform

    obs = spark.range(cells).select(F.col("id").alias("cell_id"), (F.col("id") % types).alias("cell_type_label"), (F.col("id") % batches).alias("batch_label"))
    grid = obs.crossJoin(F.broadcast(spark.range(genes).withColumnRenamed("id", "gene_id")))
    mean = F.exp(hash_normal(seed, "cell_type_label", "gene_id") * 0.7 + 0.3 * F.col("batch_label"))
    value = F.floor(mean * -F.log(hash_uniform(seed + 1, "cell_id", "gene_id")) + 0.5)
    counts = grid.select("cell_id", "gene_id", value.cast("double").alias("value")).filter("value > 0")
    return {"counts": counts, "obs": obs}
