"""SQL of queries that are registered elsewhere: pipelines, seeded generators, geometry and dense networks.

A dense network's weights go into the SQL as list literals: the twin computes every product and sum by itself.
"""

from __future__ import annotations

import numpy as np

from strandlake.plans import derive as D
from strandlake.plans import queries_io as Q
from strandlake.plans import queries_learned as L

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LIB = f"{D.COUNTS}, lib AS (SELECT cell_id, sum(value) AS lib FROM counts GROUP BY 1)"
_NORM = f"{_LIB}, norm AS (SELECT cell_id, gene_id, ln(value * (10000 / greatest(lib, 1)) + 1) AS value FROM counts JOIN lib USING (cell_id))"
_N = "(SELECT count(*) FROM customer)"


def uniform(seed: int, *ids: str) -> str:
    """The engine's hash uniform as SQL."""
    key = " || '|' || ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"((CAST('0x' || substr(md5('{seed}|' || {key}), 1, 12) AS BIGINT) + 0.5) / 281474976710656)"


def normal(seed: int, *ids: str) -> str:
    return f"(sqrt(-2 * ln({uniform(seed, *ids)})) * cos(2 * pi() * {uniform(seed + 7919, *ids)}))"


SQL["enhanced_variant_features"] = (
    f"""WITH {D.READS}, w AS (SELECT position, base, 1 - pow(10, -quality / 10) AS w FROM reads WHERE position >= 0 AND position < 720 AND base IN ('A', 'C', 'G', 'T')),
    s AS (SELECT position, sum(w) AS cov, """
    + ", ".join(f"coalesce(sum(w) FILTER (base = '{b}'), 0) AS {b}" for b in "ACGT")
    + """ FROM w GROUP BY 1), g AS (SELECT p.position, coalesce(cov, 0) AS cov, """
    + ", ".join(f"coalesce({b}, 0) / greatest(coalesce(cov, 0), 1e-8) AS {b}" for b in "ACGT")
    + """ FROM (SELECT unnest(range(720)) AS position) p LEFT JOIN s ON s.position = p.position)
    SELECT position, round(cov, 5) + 0.0 AS depth, round(greatest("A", "C", "G", "T"), 5) + 0.0 AS top, round("""
    + " ".join(f'- "{b}" * ln("{b}" + 1e-10)' for b in "ACGT")
    + """, 5) + 0.0 AS entropy, round(abs("A" - "C") / greatest(cov, 1e-8), 5) + 0.0 AS balance FROM g"""
)
SQL["joint_preprocessing"] = f"""WITH {_NORM}, m AS (SELECT gene_id, sum(value) / {_N} AS mean, greatest(sum(value * value) / {_N} - pow(sum(value) / {_N}, 2), 0) AS var FROM norm GROUP BY 1),
    h AS (SELECT * FROM m QUALIFY row_number() OVER (ORDER BY var / mean DESC, gene_id DESC) <= 10)
    SELECT h.gene_id, round(sum(least(greatest((coalesce(value, 0) - mean) / CASE WHEN var > 1e-12 THEN sqrt(var) ELSE 1 END, -2), 2)), 3) + 0.0 AS total, count(*) AS n
    FROM customer CROSS JOIN h LEFT JOIN norm n ON n.cell_id = c_custkey AND n.gene_id = h.gene_id GROUP BY 1"""
SQL["differential_expression_pipeline"] = f"""WITH {D.COUNTS}, {D.OBS}, c AS (SELECT DISTINCT cell_id FROM counts), m AS (SELECT gene_id, sum(ln(1 + value)) / (SELECT count(*) FROM c) AS m FROM counts GROUP BY 1),
    f AS (SELECT cell_id, median(ln(1 + coalesce(value, 0)) - m) AS lf FROM c CROSS JOIN m LEFT JOIN counts USING (cell_id, gene_id) GROUP BY 1), s AS (SELECT cell_id, exp(lf - (SELECT avg(lf) FROM f)) AS sf FROM f),
    x AS (SELECT gene_id, cell_id % 2 AS k, ln(1 + value / sf) AS v FROM counts JOIN s USING (cell_id) JOIN obs USING (cell_id)), n AS (SELECT cell_id % 2 AS k, count(*) AS n FROM obs GROUP BY 1),
    g AS (SELECT gene_id, k, sum(v) / first(n) AS m, (sum(v * v) / first(n) - pow(sum(v) / first(n), 2)) / first(n) AS se2 FROM x JOIN n USING (k) GROUP BY 1, 2),
    e AS (SELECT gene_id, sum(m) FILTER (k = 1) - sum(m) FILTER (k = 0) AS beta, sqrt(sum(se2) FILTER (k = 1) + sum(se2) FILTER (k = 0)) AS se FROM g GROUP BY 1),
    w AS (SELECT gene_id, beta, beta / se AS z, 2 * (1 - 1 / (1 + exp(-1.7 * abs(beta / se)))) AS p FROM e)
    SELECT gene_id, round(z, 5) + 0.0 AS z, round(p, 5) + 0.0 AS p, round(beta / ln(2), 5) + 0.0 AS log2_fold, round(1 / (1 + exp(-(0.05 - p) / 0.01)), 5) + 0.0 AS significance FROM w"""
SQL["synthetic_doublets"] = f"""WITH {D.COUNTS}, ids AS (SELECT c_custkey AS cell_id, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer), k AS (SELECT unnest(range(1, 201)) AS k),
    d AS (SELECT k, floor({uniform(7, "k")} * {_N}) AS r FROM k UNION ALL SELECT k, floor({uniform(8, "k")} * {_N}) FROM k)
    SELECT -k AS cell_id, gene_id, sum(value) AS value FROM d JOIN ids USING (r) JOIN counts USING (cell_id) GROUP BY 1, 2"""
SQL["doublet_scores"] = f"""WITH {D.POINTS}, f AS (SELECT -a.id - 1 AS id, list_transform(range(1, 65), lambda k: (a.vec[k] + b.vec[k]) / 2) AS vec FROM points a JOIN points b ON b.id = a.id + 7),
    p AS (SELECT id, vec, 0 AS fake FROM points UNION ALL SELECT id, vec, 1 FROM f), c AS (SELECT round(8 * (1 + (SELECT count(*) FROM f) / (SELECT count(*) FROM points))) AS k),
    d AS (SELECT a.id AS i, b.id AS j, b.fake, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.vec[k] - b.vec[k], 2))) + 1e-16), 6) AS d FROM points a JOIN p b ON a.id <> b.id),
    n AS (SELECT i, sum(fake) AS c FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= (SELECT k FROM c)) GROUP BY 1),
    q AS (SELECT i, c, (c + 1) / ((SELECT k FROM c) + 2) AS q FROM n) SELECT i AS id, CAST(c AS DOUBLE) AS simulated_neighbours, round(q * 0.06 / 2 / greatest(1 - 0.06 - q * (1 - 0.06 - 0.03), 1e-8), 6) AS score FROM q"""
SQL["synthetic_expression"] = f"""WITH g AS (SELECT c AS cell_id, g AS gene_id, c % 3 AS t, c % 2 AS b FROM (SELECT unnest(range(500)) AS c), (SELECT unnest(range(200)) AS g)),
    v AS (SELECT cell_id, gene_id, floor(exp({normal(42, "t", "gene_id")} * 0.7 + 0.3 * b) * -ln({uniform(43, "cell_id", "gene_id")}) + 0.5) AS value FROM g) SELECT cell_id, gene_id, CAST(value AS DOUBLE) AS value FROM v WHERE value > 0"""
SQL["count_simulation"] = f"""WITH x AS (SELECT c_custkey AS cell_id, g AS gene_id, c_custkey % 3 AS grp, c_custkey % 2 AS bt FROM customer, (SELECT unnest(range(40)) AS g)),
    m AS (SELECT *, exp({normal(21, "gene_id")}) * CASE WHEN {uniform(22, "gene_id", "grp")} < 0.1 THEN exp({normal(23, "gene_id", "grp")} * 0.5) ELSE 1 END * exp(0.2 * {normal(24, "bt")}) * exp(0.3 * {normal(25, "cell_id")}) AS mu FROM x),
    v AS (SELECT gene_id, CASE WHEN {uniform(27, "cell_id", "gene_id")} < 1 / (1 + exp(-2 * (ln(mu) + 1))) THEN greatest(mu + sqrt(mu) * {normal(26, "cell_id", "gene_id")}, 0) ELSE 0 END AS v FROM m)
    SELECT gene_id, count(*) AS n, round(avg(v), 4) AS mean FROM v WHERE v > 0 GROUP BY 1"""


# Dense networks
def _matrix(w: np.ndarray) -> str:
    """A list literal of the columns of a weight matrix."""
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in col) + "]" for col in w.T) + "]"


def dense_sql(layers, source: str, key: str = "id", x: str = "vec") -> str:
    """CTEs n0, n1, ... that carry (key, x) through dense layers with relu between them; biases are zero."""
    out, last = [], source
    for i, (w, b) in enumerate(layers):
        assert not np.any(b)
        name = f"n{i}"
        dot = f"list_transform({_matrix(w)}, lambda w: list_sum(list_transform(range(1, {len(w) + 1}), lambda k: {x}[k] * w[k])))"
        out.append(f"{name}_z AS (SELECT {key}, {dot} AS z FROM {last}), {name} AS (SELECT {key}, {'z' if i == len(layers) - 1 else 'list_transform(z, lambda v: greatest(v, 0))'} AS vec FROM {name}_z)")
        last, x = name, "vec"
    return ", ".join(out)


_OUT = lambda f: ", ".join(f"round({f.format(k=k + 1)}, 6) + 0.0 AS o{k}" for k in range(4))
_SOFT = "exp(vec[{k}] - list_max(vec)) / list_sum(list_transform(vec, lambda v: exp(v - list_max(vec))))"
for _name, _layers, _form in (
    ("mlp_classifier", Q._layers(1, 64, 32, 4), _SOFT),
    ("embedding_probe", Q._layers(11, 64, 4), _SOFT),
    ("learnable_projection", Q._layers(21, 64, 4), "vec[{k}]"),
    ("orthogonal_projection", [(Q._Q, np.zeros(4))], "vec[{k}]"),
    ("archetypal_weights", Q._layers(41, 64, 16, 4), _SOFT),
):
    SQL[_name] = f"WITH {D.POINTS}, {dense_sql(_layers, 'points')} SELECT id, {_OUT(_form)} FROM n{len(_layers) - 1}"
_vae = Q._layers(51, 64, 16)
_heads = np.concatenate([Q.N.seeded(55, 16, 2), Q.N.seeded(56, 16, 2)], axis=1)
SQL["vae_encoder"] = f"WITH {D.POINTS}, l AS (SELECT id, list_transform(vec, lambda v: ln(1 + greatest(v, 0))) AS vec FROM points), {dense_sql([*_vae, (_heads, np.zeros(4))], 'l')} SELECT id, {_OUT('vec[{k}]')} FROM n1"
_solo = [*L._SOLO["encoder"], (L._SOLO["mean"] @ L._SOLO["head"][0][0], np.zeros(1))]
SQL["doublet_classifier"] = f"WITH {D.POINTS}, l AS (SELECT id, list_transform(vec, lambda v: ln(1 + abs(v))) AS vec FROM points), {dense_sql(_solo, 'l')} SELECT id, round(1 / (1 + exp(-vec[1])), 6) AS p FROM n1"
SQL["ancestry"] = f"""WITH {D.POINTS}, l AS (SELECT id, list_transform(vec, lambda v: least(greatest(round_even(abs(v) * 2, 0), 0), 2) / 2) AS vec FROM points), {dense_sql(L._ANC["encoder"], "l")},
    s AS (SELECT id, unnest(range(3)) AS place, vec FROM n0) SELECT id, CAST(place AS INT) AS place, round({_SOFT.format(k="place + 1")}, 6) + 0.0 AS value FROM s"""

# Backbone geometry, step by step
_BACKBONE = "b AS (SELECT item_id AS pos, " + ", ".join(
    f"[{r} * cos((item_id + {s}) * 1.745), {r} * sin((item_id + {s}) * 1.745), (item_id + {s}) * 1.5 + {z}] AS {n}" for n, s, r, z in (("n", 0.0, 1.55, 0.0), ("ca", 0.3, 2.3, 0.1), ("c", 0.65, 1.65, 0.2), ("o", 0.7, 2.0, 1.3))
) + " FROM benchmark)"
_sub = lambda p, q: f"[{', '.join(f'{p}[{i}] - {q}[{i}]' for i in (1, 2, 3))}]"
_len = lambda v: f"sqrt({v}[1] * {v}[1] + {v}[2] * {v}[2] + {v}[3] * {v}[3])"
_unit = lambda v: f"[{', '.join(f'{v}[{i}] / ({_len(v)} + 1e-8)' for i in (1, 2, 3))}]"
_inv = lambda p, q: f"1 / (sqrt({' + '.join(f'pow({p}[{i}] - {q}[{i}], 2)' for i in (1, 2, 3))}) + 1e-8)"
_BONDS = f"""{_BACKBONE}, d0 AS (SELECT *, lag(c) OVER (ORDER BY pos) AS c0 FROM b), d1 AS (SELECT pos, n, {_sub("ca", "n")} AS u, {_sub("c0", "n")} AS v FROM d0 WHERE c0 IS NOT NULL),
    d2 AS (SELECT pos, n, {_unit("u")} AS u, {_unit("v")} AS v FROM d1), d3 AS (SELECT pos, n, [{", ".join(f"-(u[{i}] + v[{i}])" for i in (1, 2, 3))}] AS w FROM d2), d4 AS (SELECT pos, n, {_unit("w")} AS w FROM d3),
    d5 AS (SELECT pos, n, [{", ".join(f"n[{i}] + w[{i}]" for i in (1, 2, 3))}] AS h FROM d4),
    e AS (SELECT d.pos AS donor, a.pos AS acceptor, 27.9 * ({_inv("a.o", "d.n")} + {_inv("a.c", "d.h")} - {_inv("a.o", "d.h")} - {_inv("a.c", "d.n")}) AS e, {_inv("d.n", "a.o")} AS near FROM d5 d JOIN b a ON abs(d.pos - a.pos) >= 2),
    bonds AS (SELECT donor, acceptor, (1 + sin(least(greatest(-0.5 - e - 1, -1), 1) * pi() / 2)) / 2 AS h FROM e WHERE 1 / near < 10)"""
SQL["hbond_map"] = f"WITH {_BONDS} SELECT donor, acceptor, round(h, 6) + 0.0 AS h FROM bonds"
SQL["secondary_structure"] = f"""WITH {_BONDS}, hx AS (SELECT donor AS pos, sum(h) / 2 AS helix FROM bonds WHERE donor - acceptor IN (3, 4) GROUP BY 1),
    st AS (SELECT pos, max(h) AS strand FROM (SELECT donor AS pos, h FROM bonds WHERE abs(donor - acceptor) > 4 UNION ALL SELECT acceptor, h FROM bonds WHERE abs(donor - acceptor) > 4) GROUP BY 1),
    s AS (SELECT b.pos, coalesce(helix, 0) AS x, coalesce(strand, 0) AS t FROM b LEFT JOIN hx USING (pos) LEFT JOIN st USING (pos)), w AS (SELECT pos, exp((1 - greatest(x, t)) / 0.1) AS l, exp(x / 0.1) AS x, exp(t / 0.1) AS t FROM s)
    SELECT pos, round(l / (l + x + t), 6) + 0.0 AS loop, round(x / (l + x + t), 6) + 0.0 AS helix, round(t / (l + x + t), 6) + 0.0 AS strand FROM w"""
