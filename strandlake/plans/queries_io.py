"""Queries over sources (written to the shared folder and read back), streams, pipelines and forward passes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.numeric import hash_normal, rounded
from strandlake.operators import cells as C
from strandlake.operators import kernels as K
from strandlake.operators import neural as N
from strandlake.operators import reduction as V
from strandlake.operators import relational as B
from strandlake.operators import signals as X
from strandlake.plans import derive as D
from strandlake.plans import pipelines as P
from strandlake.session import shared_root
from strandlake.sources import readers as R
from strandlake.streaming import windows as W

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _fresh(spark, name):
    return f"{shared_root(spark)}/strandlake/{uuid.uuid4().hex}/{name}"


def fasta(spark, sf_dir):
    path = _fresh(spark, "fasta")
    R.write_fasta(D.sequences(spark, sf_dir), path)
    return R.read_fasta(spark, path).select("sequence_id", "description", "sequence")


_add("fasta_source", fasta, f"WITH {D.SEQUENCES} SELECT CAST(seq_id AS VARCHAR) AS sequence_id, '' AS description, sequence FROM sequences")


def sam(spark, sf_dir):
    path = _fresh(spark, "sam")
    li = D.table(spark, sf_dir, "lineitem")
    cols = [
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")), F.when(F.col("l_returnflag") == "R", "4").otherwise("0"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 3).cast("string")), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"),
        F.when(F.col("l_linestatus") == "F", "*").otherwise("IIII"),
    ]
    li.select(F.concat_ws("\t", *cols)).write.text(path)
    reads = R.read_sam(spark, path, least_mapq=20, region=("chr1", 100, 1500))
    return reads.select("query_name", F.col("reference_start").cast("long").alias("reference_start"), F.col("mapping_quality").cast("long").alias("mapq"), F.col("quality")[0].alias("q0"))


_add(
    "sam_source",
    sam,
    """SELECT 'r' || l_orderkey || '_' || l_linenumber AS query_name, l_partkey - 1 AS reference_start, CAST(l_quantity AS BIGINT) AS mapq, CASE WHEN l_linestatus = 'F' THEN 30.0 ELSE 40.0 END AS q0
    FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 20 AND l_suppkey % 3 = 1 AND l_partkey - 1 >= 100 AND l_partkey - 1 < 1500""",
)


def peaks(spark, sf_dir):
    path = _fresh(spark, "peaks")
    o = D.table(spark, sf_dir, "orders")
    s = F.col("o_orderkey") * 7
    cols = [F.concat(F.lit("chr"), (F.col("o_custkey") % 4).cast("string")), s.cast("string"), (s + 50).cast("string"), F.lit("."), F.lit("0"), F.lit("."), F.col("o_totalprice").cast("string"), F.lit("1.5"), F.lit("2.5"), F.lit("25")]
    o.select(F.concat_ws("\t", *cols)).write.text(path)
    return R.read_narrow_peaks(spark, path, "chr2").select("chrom", "start", "end", "signal_value", F.col("summit_offset").cast("long").alias("summit"))


_add("narrow_peak_source", peaks, "SELECT 'chr2' AS chrom, o_orderkey * 7 AS \"start\", o_orderkey * 7 + 50 AS \"end\", o_totalprice AS signal_value, CAST(25 AS BIGINT) AS summit FROM orders WHERE o_custkey % 4 = 2")


def dti(spark, sf_dir):
    path = _fresh(spark, "dti")
    p = D.table(spark, sf_dir, "part")
    p.select(
        F.col("p_partkey").alias("pair_id"), F.col("p_brand").alias("protein_id"), F.lit("MKV").alias("protein_sequence"), F.col("p_type").alias("drug_id"), F.lit("CCO").alias("drug_smiles"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("").alias("target"), F.when(F.col("p_size") % 3 == 0, "0.5").otherwise("").alias("affinity"), F.lit("1").alias("label"),
    ).write.csv(path, header=True)
    return R.read_dti(spark, path).select(F.col("pair_id").cast("long").alias("pair_id"), "protein_id", "target", "task_type")


_add("dti_source", dti, "SELECT p_partkey AS pair_id, p_brand AS protein_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_size % 3 = 0 THEN 0.5 ELSE 1.0 END AS target, 'regression' AS task_type FROM part")


def molecules(spark, sf_dir):
    path = _fresh(spark, "molecules")
    p = D.table(spark, sf_dir, "part").coalesce(1).orderBy("p_partkey")
    p.select(F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("smiles"), F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("label")).coalesce(1).write.csv(path, header=True)
    m = R.read_molecules(spark, path, "smiles", ["label"])
    return m.select(F.col("position").cast("long").alias("position"), "smiles", F.col("y")[0].alias("y"), "split")


_add(
    "molnet_source",
    molecules,
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part)
    SELECT pos AS position, 'C' || p_partkey AS smiles, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS y,
    CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r WHERE p_partkey % 11 <> 0""",
)


def archive(spark, sf_dir):
    path = _fresh(spark, "archive")
    D.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.lower(F.col("p_type")).alias("sequence"), F.when(F.col("p_size") % 2 == 0, "DBN").otherwise("CT").alias("ground_truth_type"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise("((...))").alias("ground_truth_data"), F.col("p_partkey").alias("k"),
    ).write.csv(path, header=True)
    return R.read_structures(spark, path).groupBy("sequence", "structure").agg(F.count("*").alias("n"))


_add("rna_structure_source", archive, "SELECT upper(p_type) AS sequence, '((...))' AS structure, count(*) AS n FROM part WHERE p_size % 2 = 0 AND p_size % 7 <> 0 GROUP BY 1")


def families(spark, sf_dir):
    a, b = _fresh(spark, "in"), _fresh(spark, "ref")
    n = D.table(spark, sf_dir, "nation")
    for r in range(3):
        rows = n.filter(F.col("n_regionkey") == r).coalesce(1)
        R.write_fasta(rows, f"{a}/x{r}", "n_nationkey", "n_name")
        if r < 2:
            R.write_fasta(rows.withColumn("al", F.concat("n_name", F.lit("..."))), f"{b}/x{r}", "n_nationkey", "al")
    # Families are folders here: their part files carry Spark's names, so the family comes from the folder.
    def load(root, name):
        raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).text(root)
        body = F.regexp_replace("value", "^>", "")
        fam = F.regexp_extract(F.col("_metadata.file_path"), r"/(x\d)/", 1)
        return raw.select(fam.alias("family_id"), F.regexp_extract(body, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "").alias(name))

    return load(a, "sequence").join(load(b, "aligned"), ["family_id", "name"])


_add("alignment_family_source", families, "SELECT 'x' || n_regionkey AS family_id, CAST(n_nationkey AS VARCHAR) AS name, n_name AS sequence, n_name || '...' AS aligned FROM nation WHERE n_regionkey < 2")


def star(spark, sf_dir):
    path = _fresh(spark, "star")
    R.write_star(path, counts=D.counts(spark, sf_dir), obs=D.obs(spark, sf_dir))
    t = R.read_star(spark, path, ("counts", "obs"))
    return R.operator_input(t["obs"], C.library_sizes(t["counts"]), "differential_expression").select("cell_id", "library_size", "batch_code", *[F.col("design")[i].alias(f"d{i}") for i in range(5)])


_add(
    "anndata_star_round_trip",
    star,
    f"WITH {D.COUNTS}, {D.OBS}, l AS (SELECT cell_id, sum(value) AS library_size FROM counts GROUP BY 1), c AS (SELECT cell_id, dense_rank() OVER (ORDER BY batch) - 1 AS batch_code FROM obs) SELECT cell_id, library_size, batch_code, "
    + ", ".join(f"CAST(batch_code = {i} AS DOUBLE) AS d{i}" for i in range(5))
    + " FROM c LEFT JOIN l USING (cell_id)",
)


def pick(spark, sf_dir):
    p = D.points(spark, sf_dir)
    both = p.select(F.col("id").alias("cell_id"), F.lit("X_umap").alias("key"), F.slice("vec", 1, 2).alias("vec")).unionByName(p.select(F.col("id").alias("cell_id"), F.lit("X_pca").alias("key"), F.slice("vec", 3, 2).alias("vec")))
    return R.pick_embedding(both).select("cell_id", rounded(F.col("vec")[0]).alias("v0"))


_add("preferred_embedding", pick, f"WITH {D.POINTS} SELECT id AS cell_id, round(vec[3], 6) + 0.0 AS v0 FROM points")
_add(
    "output_space_counts",
    lambda s, d: R.output_counts(D.counts(s, d), D.table(s, d, "part").filter("p_brand < 'Brand#20'").select(F.col("p_brand").alias("gene_id")).distinct(), "gene"),
    f"WITH {D.COUNTS} SELECT * FROM counts WHERE gene_id < 'Brand#20'",
)
_add("synthetic_expression", lambda s, d: R.synthetic_expression(s)["counts"])


def experiment(spark, sf_dir):
    c = R.ExperimentConfig('[datasets]\na = "x"\n[training]\na = "train"\n[zeroshot]\n"a.BUILDING" = "test"\n[fewshot."a.MACHINERY"]\nval = ["Brand#11"]\ntest = ["Brand#21", "Brand#31"]\n')
    held = c.held_out(spark)
    o = D.obs(spark, sf_dir)
    whole = F.broadcast(held.filter("perturbation is null").select("cell_type", F.col("split").alias("s1")))
    some = F.broadcast(held.filter("perturbation is not null").select("cell_type", "perturbation", F.col("split").alias("s2")))
    return o.join(whole, "cell_type", "left").join(some, ["cell_type", "perturbation"], "left").select("cell_id", F.coalesce("s1", "s2", F.lit("train")).alias("split"))


_add(
    "experiment_config",
    experiment,
    f"WITH {D.OBS} SELECT cell_id, CASE WHEN cell_type = 'BUILDING' THEN 'test' WHEN cell_type = 'MACHINERY' AND perturbation = 'Brand#11' THEN 'val' WHEN cell_type = 'MACHINERY' AND perturbation IN ('Brand#21', 'Brand#31') THEN 'test' ELSE 'train' END AS split FROM obs",
)


def contacts(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("ex"), (F.col("l_suppkey") % 30).alias("i"), (F.col("l_partkey") % 30).alias("j"))
    m = li.groupBy("ex", "i", "j").agg(F.count("*").cast("double").alias("v"))
    return R.symmetric_contacts(m).select("i", "j", "v")


_add(
    "contact_map_check",
    contacts,
    "WITH m AS (SELECT l_suppkey % 30 AS i, l_partkey % 30 AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) SELECT a.i, a.j, a.v FROM m a LEFT JOIN m b ON a.i = b.j AND a.j = b.i WHERE abs(a.v - coalesce(b.v, 0)) > 1e-6",
)

# Streams, run over all input, against batch SQL
def _events_stream(spark, sf_dir):
    schema = D.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _stream(make, columns, mode="complete"):
    def query(spark, sf_dir):
        name = f"stream_{uuid.uuid4().hex}"
        return W.consume(make(_events_stream(spark, sf_dir)), name, mode).select(*(columns() if callable(columns) else columns))

    return query


_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
_cols = lambda: [_stamp("start"), "event_type", "n", rounded("total", 3).alias("total")]
_add("stream_tumbling_window", _stream(W.tumbling_counts, _cols), "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS \"start\", event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
_add(
    "stream_sliding_window",
    _stream(W.sliding_counts, _cols),
    """SELECT strftime(time_bucket(INTERVAL 3 HOURS, ts) - k * INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S') AS "start", event_type, count(*) AS n, round(sum(value), 3) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2""",
)
_add("stream_running_coverage", _stream(lambda e: W.running_coverage(e.select(F.floor((F.unix_timestamp("ts") - 1704067200) / 3600).alias("position"), F.col("event_type").alias("base"))), ["position", "base", "n"]), "SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS position, event_type AS base, count(*) AS n FROM events GROUP BY 1, 2")
_add(
    "session_windows",
    lambda s, d: W.sessions(D.table(s, d, "events"), "4 hours").select("user_id", _stamp("start"), _stamp("end"), "n"),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts) + INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
_add("stream_deduplicated", _stream(lambda e: W.first_of_each(e), ["event_id", "event_type"], "append"), "SELECT event_id, event_type FROM events")

# Pipelines
def _ref(spark):
    return spark.range(720).select(F.col("id").alias("position"), F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.col("id") % 4 + 1).cast("int")).alias("ref"))


_add(
    "variant_calling_pipeline",
    lambda s, d: P.call_variants(D.reads(s, d), _ref(s), 720).select("position", "called", rounded("p").alias("p"), "genotype"),
    f"""WITH {D.READS}, w AS (SELECT position, base, sum(1 - pow(10, -quality / 10)) AS w FROM reads WHERE quality > 20 AND base <> 'N' AND position BETWEEN 0 AND 719 GROUP BY 1, 2), t AS (SELECT position, sum(w) AS t FROM w GROUP BY 1 HAVING sum(w) >= 1),
    b AS (SELECT position, base, w / t AS p FROM w JOIN t USING (position) QUALIFY row_number() OVER (PARTITION BY position ORDER BY w DESC, base) = 1)
    SELECT position, base AS called, round(p, 6) AS p, CAST(base <> substr('ACGT', CAST(position % 4 + 1 AS INT), 1) AS BIGINT) AS genotype FROM b""",
)
_add("enhanced_variant_features", lambda s, d: P.recalibrated_features(X.pileup(D.reads(s, d), 720)).select("position", *[rounded(c, 5).alias(c) for c in ("depth", "top", "entropy", "balance")]))
_add(
    "joint_preprocessing",
    lambda s, d: P.joint_preprocessing(D.counts(s, d), D.obs(s, d), 10, 2.0).groupBy("gene_id").agg(rounded(F.sum("z"), 3).alias("total"), F.count("*").alias("n")),
)
_add(
    "read_preprocessing",
    lambda s, d: P.preprocess_reads(D.reads(s, d).withColumn("sequence", F.concat("base", F.floor("quality").cast("string")))).select("read_id", rounded("weight").alias("weight")),
    f"""WITH {D.READS}, r AS (SELECT read_id, 1 / (1 + exp(-(quality - 20 - 1e-10))) AS q, 1 / count(*) OVER (PARTITION BY base || CAST(floor(quality) AS BIGINT)) AS c FROM reads)
    SELECT read_id, round(q * c / max(q * c) OVER (), 6) AS weight FROM r""",
)
_add("differential_expression_pipeline", lambda s, d: P.differential_expression(D.counts(s, d), D.obs(s, d).withColumn("k", F.col("cell_id") % 2), "k").select("gene_id", *[rounded(c, 5).alias(c) for c in ("z", "p", "log2_fold", "significance")]))


def perturbation(spark, sf_dir):
    r = P.perturbation_setup(D.counts(spark, sf_dir), D.obs(spark, sf_dir), ["Brand#11"], residual=1.05, cell_residual=0.8, least_cells=5)
    return r.cells.join(r.batches.select("cell_id", "batch").withColumnRenamed("batch", "train_batch"), "cell_id", "left").select("cell_id", "kept", "split", F.col("train_batch").cast("long").alias("train_batch"))


_add("perturbation_pipeline", perturbation)
_add(
    "minibatches",
    lambda s, d: P.minibatches(D.obs(s, d).select("cell_id"), "cell_id", 64).select("cell_id", F.col("batch").cast("long").alias("batch")),
    f"WITH {D.OBS}, r AS (SELECT cell_id, row_number() OVER (ORDER BY md5('42|' || cell_id), cell_id) - 1 AS rn, count(*) OVER () AS n FROM obs) SELECT cell_id, CAST(floor(rn / 64) AS BIGINT) AS batch FROM r WHERE floor(rn / 64) < floor(n / 64)",
)


def ensemble(spark, sf_dir):
    runs = D.points(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("run")).withColumn("v", hash_normal(5, "id", "run"))
    return P.ensemble_summary(runs, "id", "v").select("id", *[rounded(c, 5).alias(c) for c in ("mean", "std", "low", "high")])


_u = lambda seed: f"((CAST('0x' || substr(md5('{seed}|' || id || '|' || run), 1, 12) AS BIGINT) + 0.5) / 281474976710656)"
_add(
    "ensemble_uncertainty",
    ensemble,
    f"WITH {D.POINTS}, v AS (SELECT id, sqrt(-2 * ln({_u(5)})) * cos(2 * pi() * {_u(7924)}) AS v FROM (SELECT id, unnest(range(1, 21)) AS run FROM points)) SELECT id, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) AS std, round(quantile_cont(v, 0.025), 5) + 0.0 AS low, round(quantile_cont(v, 0.975), 5) + 0.0 AS high FROM v GROUP BY 1",
)


# Forward passes from seeded parameters
def _top(df, out, n=4):
    return df.select("id", *[rounded(F.col(out)[i]).alias(f"o{i}") for i in range(n)])


def _dense(name, layers, last=None):
    def query(spark, sf_dir):
        return _top(N.apply_model(D.points(spark, sf_dir).select("id", "vec"), "vec", "out", lambda x: N.mlp(x, layers, last)), "out")

    _add(name, query)


_layers = lambda seed, *w: [(N.seeded(seed + i, a, b), np.zeros(b)) for i, (a, b) in enumerate(zip(w, w[1:]))]
_dense("mlp_classifier", _layers(1, 64, 32, 4), N.softmax)
_dense("embedding_probe", _layers(11, 64, 4), N.softmax)
_dense("learnable_projection", _layers(21, 64, 4))
_Q = np.linalg.qr(N.seeded(31, 64, 4))[0]
_dense("orthogonal_projection", [(_Q, np.zeros(4))])
_dense("archetypal_weights", _layers(41, 64, 16, 4), N.softmax)


def vae_latent(spark, sf_dir):
    layers, m, v = _layers(51, 64, 16), N.seeded(55, 16, 2), N.seeded(56, 16, 2)
    return _top(N.apply_model(D.points(spark, sf_dir).select("id", "vec"), "vec", "out", lambda x: np.concatenate(N.vae_encode(x, layers, m, v), 1)), "out")


_add("vae_encoder", vae_latent)
_BLOCK = {**N.block_params(61, 8, 16), "embed": N.seeded(69, 5, 8)}


def transformer(spark, sf_dir):
    def run(text):
        y = N.encode_sequence(np.array(["ACGT".index(c) for c in text] or [4]), _BLOCK)
        return ([round(float(v), 6) + 0.0 for v in y],)

    from pyspark.sql import types as T

    s = D.item_sequences(spark, sf_dir)
    return _top(K.per_row(s, ["sequence"], {"out": T.ArrayType(T.DoubleType())}, run).withColumnRenamed("seq_id", "id"), "out")


_add("sequence_transformer", transformer)


def sequence_cnn(spark, sf_dir):
    from pyspark.sql import types as T

    k1, k2 = N.seeded(71, 5, 4, 8), N.seeded(72, 8, 4)

    def run(text):
        x = np.eye(4)[["ACGT".index(c) for c in text]] if text else np.zeros((1, 4))
        return ([round(float(v), 6) + 0.0 for v in N.relu(N.conv1d(x, k1, np.zeros(8))).mean(0) @ k2],)

    s = D.sequences(spark, sf_dir)
    return _top(K.per_row(s, ["sequence"], {"out": T.ArrayType(T.DoubleType())}, run).withColumnRenamed("seq_id", "id"), "out")


_add("sequence_cnn_embedding", sequence_cnn)


def graph_nets(spark, sf_dir):
    """Message passing and attention readouts of each order's chain of items."""
    from pyspark.sql import types as T

    wm, wu = N.seeded(81, 3, 4), N.seeded(82, 7, 4)
    ga = {"q": N.seeded(83, 3, 4), "k": N.seeded(84, 3, 4), "v": N.seeded(85, 3, 4), "o": N.seeded(86, 4, 2), "a": N.seeded(87, 4)}
    g = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax"))).alias("items"))
    g = g.select("id", F.flatten(F.transform("items", lambda s: F.array(s["l_quantity"] / 50, s["l_discount"], s["l_tax"]))).alias("x"))

    def run(flat):
        x = np.array(flat).reshape(-1, 3)
        n = len(x)
        e = np.array([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)]).reshape(-1, 2)
        y = np.r_[N.message_passing(x, e, wm, wu).sum(0)[:2], N.graph_attention(x, e, ga).sum(0)[:1], N.graph_attention(x, e, ga, v2=True).sum(0)[:1]]
        return ([round(float(v), 6) + 0.0 for v in y],)

    return _top(K.per_row(g, ["x"], {"out": T.ArrayType(T.DoubleType())}, run), "out")


_add("graph_networks", graph_nets)


def pca(spark, sf_dir):
    scores, _, _ = V.robust_pca(D.points(spark, sf_dir).select("id", "vec"), 3, 0.0)
    return scores.select("id", *[rounded(F.col("scores")[k], 5).alias(f"pc{k}") for k in range(3)])


_add("principal_components", pca)


def phased(spark, sf_dir):
    """Fate probabilities over the label transition graph of consecutive points; the two greatest labels are terminal."""
    p = D.points(spark, sf_dir)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("label").alias("to"))
    steps = p.select(F.col("label").alias("source"), "id").join(nxt, "id").select("source", F.col("to").alias("target"))
    return C.fate_probabilities(steps, 2).select("state", "terminal", rounded("p").alias("p"))


_add("fate_probabilities", phased)


def sparse_grn(spark, sf_dir):
    """The change of an hourly signal on itself and its square."""
    s = D.signal(spark, sf_dir).select("pos", (F.col("value") / 100).alias("x"))
    step = s.join(s.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("y")), "pos").withColumn("dx", F.col("y") - F.col("x"))
    return C.sparse_dynamics(step, ["x"], "dx", threshold=0.01).select("term", rounded("weight").alias("weight"))


_add("sparse_dynamics", sparse_grn)


def identity_clusters(spark, sf_dir):
    """Greedy clusters in id order over the benchmark's short sequences: all pairs by definition."""
    out = B.identity_clusters(D.item_sequences(spark, sf_dir), 0.5)
    return out.select(F.col("id").alias("seq_id"), "representative")


_add("sequence_identity_clusters", identity_clusters)
_add("sequence_identity_split", lambda s, d: B.identity_split(D.item_sequences(s, d), 0.5).select("seq_id", "split"))
