"""Queries over binary formats, molecule graphs and soft read preprocessing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.numeric import array_sum, rounded
from strandlake.operators import relational as R
from strandlake.operators import signals as X
from strandlake.plans import derive as D
from strandlake.sources import binary as B

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_SMILES = ("CCO", "c1ccccc1", "CC(=O)O", "C1CCNCC1", "Cc1ccncc1", "OC1CC1", "C(", "N#CC")


def molecules(spark, sf_dir):
    """Parts take one of a few structures; the graph of each is made row by row."""
    pick = F.element_at(F.array(*[F.lit(s) for s in _SMILES]), (F.col("p_partkey") % len(_SMILES) + 1).cast("int"))
    return B.molecule_graphs(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick.alias("smiles")))


#: Atoms, bonds, atoms in rings and hydrogens of the structures above, counted by hand.
_COUNTS = {"CCO": (3, 2, 0, 6), "c1ccccc1": (6, 6, 6, 6), "CC(=O)O": (4, 3, 0, 4), "C1CCNCC1": (6, 6, 6, 11), "Cc1ccncc1": (7, 7, 6, 7), "OC1CC1": (4, 4, 3, 6), "N#CC": (3, 2, 0, 3)}
_VALUES = ", ".join(f"('{s}', {a}, {b}, {r}, {h})" for s, (a, b, r, h) in _COUNTS.items())


def graph_counts(spark, sf_dir):
    m = molecules(spark, sf_dir)
    total = lambda k: F.coalesce(F.aggregate("atoms", F.lit(0.0), lambda acc, a: acc + a[k]), F.lit(0.0)).cast("long")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return m.select("id", "valid", F.when(F.col("valid"), size("atoms")).otherwise(0).alias("n_atoms"), F.when(F.col("valid"), size("edges")).otherwise(0).alias("n_bonds"), total(15).alias("ringed"), total(13).alias("hydrogens"))


_add(
    "molecule_graphs",
    graph_counts,
    f"""WITH v AS (SELECT * FROM (VALUES {_VALUES}) v(s, a, b, r, h)), p AS (SELECT p_partkey AS id, [{", ".join(repr(s) for s in _SMILES)}][p_partkey % {len(_SMILES)} + 1] AS s FROM part)
    SELECT id, a IS NOT NULL AS valid, CAST(coalesce(a, 0) AS BIGINT) AS n_atoms, CAST(coalesce(b, 0) AS BIGINT) AS n_bonds, CAST(coalesce(r, 0) AS BIGINT) AS ringed, CAST(coalesce(h, 0) AS BIGINT) AS hydrogens FROM p LEFT JOIN v USING (s)""",
)


def scaffolds(spark, sf_dir):
    """Splits by the ring systems of parsed structures; invalid ones form the group of the empty scaffold."""
    return R.scaffold_split(molecules(spark, sf_dir).select("id", "scaffold"), "id", "scaffold", 0.5, 0.2).select("id", "split")


_add("parsed_scaffold_split", scaffolds)


_add("soft_adapter_removal", lambda s, d: X.soft_adapter(D.sequences(s, d).withColumn("sequence", F.right("sequence", F.lit(40))), "ATTC", 3, 0.5, 0.1).select("seq_id", rounded("trim_at", 4).alias("trim_at"), rounded(array_sum("retained"), 4).alias("kept")),
    f"""WITH {D.SEQUENCES}, r AS (SELECT seq_id, right(sequence, 40) AS s FROM sequences), p AS (SELECT seq_id, s, unnest(range(length(s))) AS i FROM r),
    k AS (SELECT *, least(4, length(s) - i) AS k FROM p), m AS (SELECT *, CASE WHEN k >= 3 THEN list_sum([CASE WHEN substr(s, i + x, 1) = substr('ATTC', x, 1) THEN 2.0 ELSE -1.0 END FOR x IN range(1, k + 1)]) / (2.0 * k) ELSE 0 END AS sc FROM k),
    e AS (SELECT seq_id, i, sc, exp(greatest(sc - 0.5, 0) / 0.1) AS e FROM m), t AS (SELECT seq_id, CASE WHEN max(sc) > 0.5 THEN sum(e * i) / sum(e) ELSE count(*) END AS t FROM e GROUP BY 1),
    w AS (SELECT seq_id, sum(1 / (1 + exp(-(t - i) / 0.1))) AS w FROM e JOIN t USING (seq_id) GROUP BY 1)
    SELECT r.seq_id, round(coalesce(t, 0), 4) + 0.0 AS trim_at, round(coalesce(w, 0), 4) + 0.0 AS kept FROM r LEFT JOIN t USING (seq_id) LEFT JOIN w USING (seq_id)""")  # fmt: skip
_add(
    "soft_duplicate_weights",
    lambda s, d: X.soft_duplicate_weights(D.points(s, d).select("id", "label", F.slice("vec", 1, 4).alias("vec")), "label").select("id", rounded("weight", 5).alias("weight")),
    f"""WITH {D.POINTS}, x AS (SELECT id, label, vec[1:4] AS v FROM points), n AS (SELECT id, label, list_transform(v, lambda u: u / (sqrt(list_sum(list_transform(v, lambda w: w * w))) + 1e-8)) AS x FROM x),
    c AS (SELECT a.id, a.label, sum(1 / (1 + exp(-(a.x[1] * b.x[1] + a.x[2] * b.x[2] + a.x[3] * b.x[3] + a.x[4] * b.x[4] - 0.9) / 0.05))) AS c FROM n a JOIN n b USING (label) GROUP BY 1, 2),
    w AS (SELECT id, label, 1 / greatest(c, 1) AS w FROM c) SELECT id, round(w / avg(w) OVER (PARTITION BY label), 5) AS weight FROM w""",
)
