"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each whole text becomes a short vector of statistics; cosines of random projections of that vector approximate a
Gaussian kernel; tasks sum their part of the normal equations, the driver solves the small system, and an isotonic fit
to out-of-fold scores turns ridge scores into probabilities.

Only fitting is bounded: at most `max_rows` labelled rows (a hash of the id decides which) take part. Scores are given to
every row, from its whole text, however long. Defined cases: null and empty texts get a score from the statistics of the
empty text; null labels are left out and repeated ones averaged; rows that repeat a labelled id are all learned from;
equal ridge scores share one calibrated level, whatever order they come in; a null id counts as the empty string for the
held-out rule and has no label; without labelled rows, or with one label only, the score is their mean (0.5 without any);
an empty table gives an empty result; input columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import materialise, spare_name, trimmed

#: Labelled rows that a fit uses at most.
MAX_ROWS = 100_000
FEATURES = 384
#: Widths of the Gaussian kernels, as multiples of the square root of the number of statistics.
WIDTHS = (0.5, 1.0, 2.0)
RIDGE = 0.3
FOLDS = 4
#: Rows whose features are held at a time.
_ROWS = 1024

_KIND = np.zeros(256, np.int64)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b" \t\r\n\v\f")] = 4
_KIND[list(b".,;:?'\"()-")] = 5
_KIND[list(b"!")] = 6
_KIND[list(b"|")] = 7
_KIND[list(b"#$%&*+/<=>@[]\\^_`{}~")] = 8
_KIND[128:] = 9
_KINDS = 10


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a whole text: sizes, character classes over all and by line, repetition of words and lines."""
    n = len(text)
    if not text.strip():
        return np.zeros(N_STATISTICS, np.float32)
    codes = np.frombuffer(text, np.uint8)
    kinds = _KIND[codes]
    line = np.cumsum(codes == 10)
    table = np.bincount(line * _KINDS + kinds, minlength=(line[-1] + 1) * _KINDS).reshape(-1, _KINDS).astype(np.float64)
    chars = table.sum(1)
    shares = table[chars > 0] / chars[chars > 0, None]
    weight = chars[chars > 0] / chars.sum()
    letters = shares[:, 1] + shares[:, 2] + shares[:, 9] + 1e-9
    loud, odd, ruled, shouted = shares[:, 2] / letters, shares[:, 8], shares[:, 7], shares[:, 6]
    words = text.split()
    nw = len(words)
    lengths = np.fromiter(map(len, words), np.float64, nw)
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / max(nw - 1, 1)
    rows = [x for x in text.split(b"\n") if x.strip()]
    held = {}
    for x in rows:
        held[x] = held.get(x, 0) + len(x)
    repeated = sum(v - len(k) for k, v in held.items()) / n
    return np.array(
        [
            math.log1p(n), math.log1p(nw), math.log1p(len(rows)), lengths.mean(), lengths.std(), math.log1p(lengths.max()),
            *(table.sum(0) / n)[1:],
            weight @ (loud > 0.6), weight @ (odd > 0.08), weight @ (ruled > 0.04), weight @ (shouted > 0.04),
            odd.max(), ruled.max(), shouted.max(), (loud * (chars[chars > 0] > 20)).max(),
            len(counts) / nw, len(counts) / math.sqrt(nw), max(counts.values()) / nw, pairs,
            1 - len(held) / len(rows), repeated, max(held.values()) / n, n / len(rows) / 100,
        ],
        np.float32,
    )


N_STATISTICS = 6 + (_KINDS - 1) + 8 + 8


class Model:
    """A fitted scorer; small, and sent to tasks as it is."""

    def __init__(self, mean, scale, omega, phase, weights, knots, levels):
        self.mean, self.scale, self.omega, self.phase = mean, scale, omega, phase
        self.weights, self.knots, self.levels = weights, knots, levels

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.omega + self.phase) * math.sqrt(2 / self.omega.shape[1])
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        ridge = [self.expand(x[i : i + _ROWS]) @ self.weights for i in range(0, len(x), _ROWS)]
        return np.clip(np.interp(np.concatenate([np.zeros(0), *ridge]), self.knots, self.levels), 0, 1)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over distinct scores; knots at the blocks' mean scores, so that interpolation keeps their order."""
    distinct, at, times = np.unique(scores, return_inverse=True, return_counts=True)
    sums = np.bincount(at, labels, len(distinct))
    blocks: list[list[float]] = []
    for s, y, n in zip(distinct.tolist(), sums.tolist(), times.tolist()):
        blocks.append([y, float(n), s * n])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    y, n, s = np.array(blocks).T
    # Half a row of doubt keeps the ends off 0 and 1 and the levels in order.
    doubt = 0.5 / (len(labels) + 1)
    return s / n, np.clip(y / n, doubt, 1 - doubt)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text, modulo folds, is fold; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _body(text_col: str, name: str = "__body"):
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias(name)


def _describe(batches):
    for batch in batches:
        bodies = batch.column(batch.schema.get_field_index("__body"))
        rows = [statistics(bodies[i].as_py()).tolist() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("y")), batch.column(batch.schema.get_field_index("fold")), pa.array(rows, pa.list_(pa.float32()))],
            names=["y", "fold", "x"],
        )


def _cut(batches):
    """The batches, in slices of at most _ROWS rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The statistics of a batch that has rows."""
    return batch.column(2).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)


def _equations(model: Model):
    """Kernel: a task's part of the normal equations of each fold, a row of the matrix at a time."""

    def run(batches):
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for batch in _cut(batches):
            y, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = model.expand(_rows_of(batch))
            for f in np.unique(fold):
                a = np.concatenate([z[fold == f], y[fold == f][:, None]], axis=1)
                sums[f] = sums.get(f, 0) + a.T @ a
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), k, np.int32)) for k in (part, f)] + [pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))],
                names=["part", "fold", "row", "v"],
            )

    return run


def _add_rows(table: pa.Table) -> pa.Table:
    # In the tasks' order, so that the sum is the same each time.
    v = np.sum(np.array(table.sort_by("part").column("v").to_pylist()), axis=0)
    return pa.table({"fold": table.column("fold")[:1], "row": table.column("row")[:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, seed: int = 5) -> Model:
    """Learn from the labelled rows that are not held out (crc32 of the id modulo 5 is 0)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("y"))
    total = known.count()
    rng = np.random.default_rng(seed)
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    # Bounded by max_rows, a few MB.
    texts = docs.select(F.col(id_col).alias("__doc"), _body(text_col))
    picked = texts.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select(
        "y", F.pmod(F.xxhash64("__id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int").alias("fold"), "__body"
    )
    described = materialise(picked.mapInArrow(trimmed(_describe), "y double, fold int, x array<float>"), "described")
    moments = described.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    if not moments["n"] or moments["low"] == moments["high"]:
        return Model(None, None, None, None, None, None, [0.5 if moments["y"] is None else float(moments["y"])])
    spread = described.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    mean, scale = np.array([r["m"] for r in spread]), np.maximum([r["s"] for r in spread], 1e-3)
    per = FEATURES // len(WIDTHS)
    omega = np.concatenate([rng.normal(0, 1 / (w * math.sqrt(len(mean))), (len(mean), per)) for w in WIDTHS], axis=1)
    model = Model(mean, scale, omega, rng.uniform(0, 2 * math.pi, omega.shape[1]), None, None, None)
    parts = described.mapInArrow(trimmed(_equations(model)), "part int, fold int, row int, v array<double>")
    summed = parts.groupBy("fold", "row").applyInArrow(_add_rows, "fold int, row int, v array<double>").orderBy("fold", "row").collect()
    by_fold = {f: np.array([r["v"] for r in summed if r["fold"] == f]) for f in {r["fold"] for r in summed}}
    whole = sum(by_fold.values())
    apart = {f: _solve(whole - m) for f, m in by_fold.items()}
    pairs = described.mapInArrow(trimmed(_out_of_fold(model, apart)), "s double, y double").collect()
    model.weights = _solve(whole)
    model.knots, model.levels = isotonic(np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs]))
    return model


def _solve(m: np.ndarray) -> np.ndarray:
    """Ridge weights from the normal equations, whose last row and column belong to the label."""
    a = m[:-1, :-1] + RIDGE * np.eye(len(m) - 1)
    return np.linalg.solve(a, m[:-1, -1])


def _out_of_fold(model: Model, apart: dict):
    """Kernel: each fitted row's ridge score by the weights that did not see its fold."""

    def run(batches):
        for batch in _cut(batches):
            z = model.expand(_rows_of(batch))
            fold = batch.column(1).to_numpy()
            s = np.zeros(len(z))
            for f, w in apart.items():
                s[fold == f] = z[fold == f] @ w
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(0)], names=["s", "y"])

    return run


def _scores(model: Model, name: str, at: int, width: int):
    """Kernel: the first `width` columns and the score of column `at`, a text or its bytes."""

    def run(batches):
        for batch in batches:
            bodies = batch.column(at).cast(pa.large_binary())
            x = np.array([statistics(bodies[i].as_py() or b"") for i in range(batch.num_rows)], np.float64).reshape(batch.num_rows, N_STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(model.score(x), pa.float64())], names=[*batch.schema.names[:width], name]
            )

    return run


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """All columns of `docs`, plus the calibrated probability of label 1, double, under a name that `docs` does not have."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    # A text goes to the worker once: its own column is read, where that is a string.
    own = [i for i, f in enumerate(docs.schema.fields) if f.name == text_col and isinstance(f.dataType, T.StringType)]
    width = len(docs.columns)
    if len(own) != 1:
        docs, own = docs.select("*", _body(text_col, spare_name(docs, "__body"))), [width]
    return docs.mapInArrow(trimmed(_scores(model, name, own[0], width)), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, label_col, max_rows=max_rows)
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of `docs` that the classifier accepts, columns as they were."""
    model, score = fit(docs, labels, label_col, max_rows=max_rows), spare_name(docs, "__score")
    return score_texts(docs, model, name=score).filter(F.col(score) >= threshold).drop(score)
