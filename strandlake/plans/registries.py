"""Registries of models and adapters, provenance records, and comparison reports of benchmark runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that every embedding of a registered model has.
EMBEDDING_COLUMNS = ("id", "vec")
#: Capabilities that exist only as experiments; asking for any other is an error.
EXPERIMENTAL = {
    "sequence_generation": "sampling of sequences from a trained decoder",
    "perturbation_prediction": "expression after an unseen perturbation",
    "multiomics_alignment": "one embedding of several assays",
}


class Registry:
    """Names to factories; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.held = kind, {}

    def register(self, name: str, factory) -> None:
        if name in self.held and self.held[name] is not factory:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.held[name] = factory

    def get(self, name: str):
        if name not in self.held:
            raise KeyError(f"unknown {self.kind} {name}; there are: {', '.join(sorted(self.held))}")
        return self.held[name]

    def create(self, name: str, *args, **kwargs):
        return self.get(name)(*args, **kwargs)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.kind, n) for n in sorted(self.held)], "kind string, name string")


MODELS, ADAPTERS = Registry("model"), Registry("adapter")


def check_embedding(out: DataFrame, width: int | None = None) -> DataFrame:
    """The table itself, or an error unless it has an id and a vector of one width without nulls."""
    missing = [c for c in EMBEDDING_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wide = F.size("vec") != (width if width is not None else F.size("vec"))
    bad = out.filter(F.col("vec").isNull() | wide | F.exists("vec", lambda v: v.isNull())).limit(1).count()
    if bad:
        raise ValueError("an embedding is null, has nulls or another width")
    return out


class PrecomputedAdapter:
    """Embeddings from a table of artifacts, in the order of the rows that ask; unknown and missing ids are errors."""

    def __init__(self, artifact: DataFrame):
        self.artifact = check_embedding(artifact)

    def embed(self, reference: DataFrame, position: str) -> DataFrame:
        from strandlake.operators.splitting import align_to_reference

        return align_to_reference(self.artifact, reference, "id", position)


class FrozenEncoder:
    """A frozen model function run over rows in Arrow batches: (rows, features) to (rows, width)."""

    def __init__(self, model):
        self.model = model

    def embed(self, rows: DataFrame, vec: str = "vec") -> DataFrame:
        from strandlake.operators.neural import apply_model

        renamed = apply_model(rows.select("id", F.col(vec).alias("__in")), "__in", "vec", self.model)
        return renamed.select("id", "vec")


for _family in ("precomputed_sequence", "precomputed_single_cell", "precomputed_multiomics"):
    ADAPTERS.register(_family, PrecomputedAdapter)
ADAPTERS.register("frozen_encoder", FrozenEncoder)


def is_experimental(key: str) -> bool:
    return key in EXPERIMENTAL


def experimental_capability(key: str) -> str:
    if key not in EXPERIMENTAL:
        raise KeyError(f"unknown experimental capability {key}")
    return EXPERIMENTAL[key]


@dataclass(frozen=True)
class ArtifactSpec:
    """Where an embedding came from."""

    family: str
    checkpoint: str
    pooling: str = "mean"
    frozen: bool = True

    def metadata(self) -> dict[str, str]:
        return {"model_family": self.family, "checkpoint": self.checkpoint, "pooling": self.pooling, "frozen": str(self.frozen).lower()}


def benchmark_metadata(spec: ArtifactSpec, dataset: str, task: str) -> dict[str, str]:
    return {**spec.metadata(), "dataset": dataset, "task": task}


def comparison_key(axes: list[str], tags: dict[str, str]) -> str:
    """The tags that two runs must share to be compared, in the order of the axes; a missing one is an error."""
    missing = [a for a in axes if a not in tags]
    if missing:
        raise ValueError(f"missing tags: {', '.join(missing)}")
    return "|".join(f"{a}={tags[a]}" for a in axes)


def task_report(results: DataFrame, baselines: list[str]) -> DataFrame:
    """(task, metric, model, value, baseline, difference, rank) of rows (task, metric, model, value), higher values being better.

    The baseline of a task and metric is its best among the named models; ranks go by falling value, ties by name.
    """
    from pyspark.sql import Window

    base = results.filter(F.col("model").isin(baselines)).groupBy("task", "metric").agg(F.max("value").alias("baseline"))
    out = results.join(base, ["task", "metric"], "left")
    place = F.row_number().over(Window.partitionBy("task", "metric").orderBy(F.col("value").desc(), "model"))
    return out.select("task", "metric", "model", "value", "baseline", (F.col("value") - F.col("baseline")).alias("difference"), place.cast("long").alias("rank"))


def suite_report(report: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(model, tasks, wins, mean_difference, regressions) over all tasks; a regression falls below its baseline by more than a share."""
    worse = F.col("difference") < -threshold * F.abs("baseline")
    return report.groupBy("model").agg(
        F.countDistinct("task").alias("tasks"), F.sum((F.col("rank") == 1).cast("long")).alias("wins"), F.avg("difference").alias("mean_difference"), F.sum(F.coalesce(worse, F.lit(False)).cast("long")).alias("regressions")
    )


def promotion_report(suite: DataFrame, least_wins: int = 1) -> DataFrame:
    """The suite's rows with promoted: enough wins, no regression and no loss on average."""
    good = (F.col("wins") >= least_wins) & (F.col("regressions") == 0) & (F.coalesce("mean_difference", F.lit(0.0)) >= 0)
    return suite.withColumn("promoted", good)
