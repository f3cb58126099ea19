"""DNA and RNA strings as columns: encoding, complements, qualities, k-mers, scoring tables and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.numeric import array_softmax
from strandlake.functions.soft import col

BASES = "ACGT"


def _letters(sequence) -> Column:
    return F.filter(F.split(F.upper(col(sequence)), ""), lambda c: c != "")


def one_hot(sequence, handle_n: str = "uniform") -> Column:
    """array<array<double>> over A, C, G, T; N is uniform or zeros; any other letter raises."""
    unknown = F.array(*[F.lit(0.25 if handle_n == "uniform" else 0.0)] * 4)
    checked = F.when(col(sequence).rlike("(?i)^[ACGTN]*$"), _letters(sequence)).otherwise(
        F.raise_error(F.concat(F.lit("not a DNA sequence: "), F.substring(col(sequence), 1, 40))).cast("array<string>")
    )
    return F.transform(checked, lambda c: F.when(c == "N", unknown).otherwise(F.array(*[(c == b).cast("double") for b in BASES])))


def decode_one_hot(encoded, threshold: float = 0.5) -> Column:
    """The letter of the greatest probability at each position; N where it is below the threshold."""

    def letter(p):
        top = F.array_max(p)
        return F.when(top < threshold, "N").otherwise(F.substring(F.lit(BASES), F.array_position(p, top).cast("int"), F.lit(1)))

    return F.array_join(F.transform(col(encoded), letter), "")


def phred_to_probability(q) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def probability_to_phred(p, most: float = 60.0) -> Column:
    bounded = F.least(F.greatest(col(p), F.lit(1e-10)), F.lit(1.0))
    return F.least(F.greatest(-10.0 * F.log10(bounded), F.lit(0.0)), F.lit(most))


def soft_encode(sequence, quality, temperature: float = 1.0) -> Column:
    """One-hot mixed with uniform by each base's error probability, then a softmax of its logarithms."""

    def mixed(p, q):
        keep = 1.0 - phred_to_probability(q)
        return array_softmax(F.transform(p, lambda v: F.log(v * keep + 0.25 * (1.0 - keep) + 1e-10)), temperature)

    return F.zip_with(one_hot(sequence), col(quality), mixed)


def complement(sequence) -> Column:
    return F.translate(F.upper(col(sequence)), "ACGT", "TGCA")


def reverse_complement(sequence) -> Column:
    return F.reverse(complement(sequence))


def gc_content(sequence) -> Column:
    """Share of C and G among A, C, G, T and N, an N counting half."""
    s = F.upper(col(sequence))
    n = F.length(s)
    gc = n - F.length(F.translate(s, "GC", ""))
    ns = n - F.length(F.translate(s, "N", ""))
    return (gc + 0.5 * ns) / (n + 1e-10)


def dna_element(sequence, quality=None) -> Column:
    """struct of sequence, qualities (40 where not given) and a mask of ones."""
    letters = _letters(sequence)
    scores = col(quality) if quality is not None else F.transform(letters, lambda c: F.lit(40.0))
    return F.struct(col(sequence).alias("sequence"), scores.alias("quality_scores"), F.transform(letters, lambda c: F.lit(1.0)).alias("mask"))


def kmer_index(kmer) -> Column:
    """Base-4 number of a k-mer, its first base being the least significant digit."""
    digits = F.split(F.translate(col(kmer), BASES, "0123"), "")
    return F.aggregate(F.reverse(F.filter(digits, lambda d: d != "")), F.lit(0).cast("long"), lambda acc, d: acc * 4 + d.cast("long"))


def kmer_dimension(k: int, canonical: bool = False) -> int:
    """How many columns k-mer features have."""
    if not canonical:
        return 4**k
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2


def kmer_counts(texts: list[str], k: int, canonical: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the k-mers of A, C, G, T in a batch of texts; a code is base 4, its first base the least digit."""
    digit = np.full(256, -1, np.int64)
    for i, c in enumerate(BASES):
        digit[ord(c)] = digit[ord(c.lower())] = i
    # Every text ends with a letter of no base, so no window runs on into the next.
    raw = [t.encode("latin-1", "replace") + b"|" for t in texts]
    flat = digit[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(flat) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])[:n]
    code, other, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        d = flat[i : i + n]
        live &= d >= 0
        code += d << (2 * i)
        other += (3 - d) << (2 * (k - 1 - i))
    if canonical:
        code = np.minimum(code, other)
    key, count = np.unique((owner[live] << (2 * k)) + code[live], return_counts=True)
    return key >> (2 * k), key & ((1 << (2 * k)) - 1), count


def kmer_features(sequences: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence", canonical: bool = False) -> DataFrame:
    """(id, kmer, n, frequency): k-mers of A, C, G, T in each sequence; canonical ones stand for their reverse complement.

    Windows with another letter are left out; sequences without a window have no row (all their features are zero). A
    sequence is one row, so its k-mers are counted where it is: nothing is shuffled.
    """
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    letters = np.array(list(BASES))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            low = 0
            while low < batch.num_rows:
                # About 4 MB of text at a time.
                high, size = low, 0
                part = []
                while high < batch.num_rows and (size < 4 << 20 or high == low):
                    part.append(texts[high].as_py() or "")
                    size += len(part[-1])
                    high += 1
                owner, code, count = kmer_counts(part, k, canonical)
                total = np.bincount(owner, count, len(part))
                for i in range(0, len(code), 1 << 16):
                    c, o = code[i : i + (1 << 16)], owner[i : i + (1 << 16)]
                    names = letters[(c[:, None] >> (2 * np.arange(k))) & 3].view(f"<U{k}")[:, 0]
                    n = count[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(low + o)), pa.array(names.tolist(), pa.string()), pa.array(n.astype(np.int64)), pa.array(n / total[o])], names=[id_col, "kmer", "n", "frequency"])
                low = high

    schema = T.StructType([sequences.schema[id_col], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType()), T.StructField("frequency", T.DoubleType())])
    return sequences.select(id_col, seq_col).mapInArrow(run, schema)


def scoring_table(spark: SparkSession, match: float = 2.0, mismatch: float = -1.0, alphabet: str = BASES) -> DataFrame:
    """(a, b, score) for every pair of letters."""
    letters = spark.createDataFrame([(c,) for c in alphabet], "a string")
    pairs = letters.crossJoin(letters.withColumnRenamed("a", "b"))
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), match).otherwise(mismatch).alias("score"))


def centred_windows(signal, width: int) -> Column:
    """Array of windows around each element of an array, the ends repeated."""
    xs = col(signal)
    n, h = F.size(xs), width // 2

    def window(_, i):
        return F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.element_at(xs, (F.least(F.greatest(i + j - h, F.lit(0)), n - 1) + 1).cast("int"))
        )

    return F.transform(xs, window)
