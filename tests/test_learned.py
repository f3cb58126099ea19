import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import learned as L
from strandlake.operators import network as E
from strandlake.operators import neural as N
from strandlake.operators import reduction as R
from strandlake.operators import relational as B
from strandlake.operators import training as T

RNG = np.random.default_rng(0)


def test_error_correction_keeps_sure_bases():
    x = L.one_hot("ACGTN")
    out = L.correct_errors(x, np.array([60.0, 60, 0, 60, 60]), L.dense(1, 25, 8, 4))
    assert np.allclose(out.sum(1), 1) and np.allclose(out[0], x[0], atol=1e-5) and out[2].max() < 1
    feature = np.concatenate([x, np.array([60.0, 60, 0, 60, 60])[:, None] / 40], 1)
    window = np.concatenate([feature[min(max(2 + k, 0), 4)] for k in range(-2, 3)])
    assert np.allclose(out[2], N.softmax(N.mlp(window[None], L.dense(1, 25, 8, 4)))[0])


def test_read_mapping_points_at_the_only_match():
    params = {"q": 9 * np.eye(4), "k": np.eye(4), "c": np.zeros(4)}
    p, place, quality = L.map_read(L.one_hot("T"), L.one_hot("AAATAA"), params)
    assert place == 3 and np.isclose(p.sum(), 1) and 0 < quality <= 0.5


def test_star_alignment_by_loops():
    seqs, embed = [L.one_hot(s) for s in ("ACGT", "AGT", "TTTTT")], N.seeded(3, 4, 6)
    aligned, consensus, d = L.star_alignment(seqs, {"embed": embed})
    want = np.zeros((4, 4))
    for i in range(4):
        w = np.array([np.exp((seqs[0][i] @ embed) @ (seqs[1][j] @ embed)) for j in range(3)])
        want[i] = (w / w.sum()) @ seqs[1]
    assert np.allclose(aligned[1], want) and np.allclose(consensus, aligned.mean(0)) and np.allclose(np.diag(d), 1e-6)


def test_convolutions_by_loops():
    x, k = RNG.normal(size=(5, 6, 2)), RNG.normal(size=(3, 3, 2, 4))
    got = L.conv2d(x, k, np.ones(4))
    want = np.ones((5, 6, 4))
    for r in range(5):
        for c in range(6):
            for i in range(3):
                for j in range(3):
                    if 0 <= r + i - 1 < 5 and 0 <= c + j - 1 < 6:
                        want[r, c] += x[r + i - 1, c + j - 1] @ k[i, j]
    assert np.allclose(got, want)
    p = L.classify_image(x, {"convolutions": [(k, np.zeros(4))], "head": L.dense(5, 4, 3)})
    assert np.isclose(p.sum(), 1)


def test_fourier_layer_is_a_circular_convolution():
    x, w = RNG.normal(size=(16, 2)), RNG.normal(size=(9, 2, 3)) + 0j
    kernel = np.fft.irfft(w, n=16, axis=0)
    want = np.zeros((16, 3))
    for t in range(16):
        for s in range(16):
            want[t] += x[s] @ kernel[(t - s) % 16]
    assert np.allclose(L.fourier_layer(x, w, np.zeros((2, 3))), want)


def test_chromatin_states_by_enumeration():
    initial, transition, rates = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.9, 0.2], [0.3, 0.6]])
    marks = (RNG.random((5, 2)) < 0.5).astype(float)
    post, total = np.zeros((5, 2)), 0.0
    for path in np.ndindex(*[2] * 5):
        p = initial[path[0]]
        for t, s in enumerate(path):
            p *= np.prod(np.where(marks[t] > 0, rates[s], 1 - rates[s])) * (transition[path[t - 1], s] if t else 1)
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
    got, expected, ll = L.chromatin_states(marks, initial, transition, rates, 1.0)
    assert np.allclose(got, post / total) and np.isclose(ll, np.log(total)) and np.allclose(expected, got @ [0, 1])
    _, cold, _ = L.chromatin_states(marks, initial, transition, rates, 1e-3)
    assert np.allclose(cold, np.round(cold), atol=1e-3)


def test_denoiser_changes_masked_entries_only():
    params = {"genes": N.seeded(1, 8, 4), "value": N.seeded(2, 4), "block": N.block_params(3, 4, 8), "out": N.seeded(4, 4, 1)}
    v, mask = RNG.normal(size=8), np.arange(8) % 3 == 0
    out = L.denoise(v, mask, params)
    assert np.allclose(out[~mask], v[~mask]) and not np.allclose(out[mask], v[mask])
    assert np.allclose(L.denoise(np.where(mask, 99, v), mask, params)[mask], out[mask])


def test_edge_attention_by_loops():
    nodes, edges, feats, p = RNG.normal(size=(4, 3)), np.array([(0, 1), (2, 1), (3, 0)]), RNG.normal(size=(3, 2)), L.block_parameters(9, 3, 2, 5)
    got = L.edge_attention(nodes, edges, feats, p)
    score = {}
    for k, (s, t) in enumerate(edges):
        z = nodes[t] @ p["left"] + nodes[s] @ p["right"] + feats[k] @ p["edge"]
        score[k] = np.exp(np.where(z > 0, z, 0.2 * z) @ p["a"])
    want = np.zeros((4, 5))
    for t in range(4):
        into = [k for k in range(3) if edges[k][1] == t]
        for k in into:
            want[t] += score[k] / sum(score[j] for j in into) * (nodes[edges[k][0]] @ p["v"] + feats[k] @ p["ve"])
    assert np.allclose(got, want) and np.allclose(L.edge_attention(nodes, np.zeros((0, 2), int), np.zeros((0, 2)), p), 0)


def test_domains_pathways_and_regulation_have_their_shapes():
    p = {"whole": L.block_parameters(1, 3, 1, 4), "pruned": L.block_parameters(2, 3, 1, 4), "prototypes": N.seeded(3, 3, 4)}
    edges = np.array([(0, 1), (1, 0), (1, 2)])
    z, a = L.spatial_domains(RNG.normal(size=(3, 3)), edges, np.array([1, 1, 0]), p)
    assert z.shape == (3, 4) and np.allclose(a.sum(1), 1)
    g = L.regulatory_matrix(np.array([1.0, 2, 3]), np.array([0, 2]), {"node": N.seeded(4, 1, 4), "block": L.block_parameters(5, 4, 3, 4), "score": N.seeded(6, 8)})
    assert g.shape == (2, 3)
    raw = g / L.sigmoid(g / 0.1)
    assert np.isfinite(raw).all()


def test_paste_finds_the_permutation():
    x, order = RNG.normal(size=(6, 3)) * 3, np.array([2, 0, 5, 1, 4, 3])
    places = RNG.normal(size=(6, 2))
    plan, moved = L.paste_alignment(x, x[order], places, places[order], epsilon=0.005, rounds=300)
    assert (plan.argmax(0) == order).all() and np.allclose(plan.sum(1), 1 / 6, atol=1e-3) and np.abs(moved - places[order]).max() < 0.05


def test_ancestry_and_molecules():
    q, x = L.ancestry(RNG.integers(0, 3, (4, 10)).astype(float), {"encoder": L.dense(1, 10, 3), "frequencies": N.seeded(2, 3, 10)})
    assert np.allclose(q.sum(1), 1) and x.min() >= 0 and x.max() <= 2
    layers = [{"message": N.seeded(3, 3, 4), "update": N.seeded(4, 6, 4)}]
    nodes, edges, f = RNG.normal(size=(3, 2)), np.array([(0, 1), (1, 0), (1, 2), (2, 1)]), np.ones((4, 1))
    a = L.graph_fingerprint(nodes, edges, f, {"layers": layers, "out": N.seeded(5, 4, 2)})
    order = np.array([2, 0, 1])
    back = np.argsort(order)
    b = L.graph_fingerprint(nodes[order], back[edges], f, {"layers": layers, "out": N.seeded(5, 4, 2)})
    assert np.allclose(a, b)
    assert len(L.ADMET_REGRESSION) + len(L.ADMET_CLASSIFICATION) == 22
    out = L.predict_properties(np.ones(2), {"herg": L.dense(1, 2, 1), "caco2": L.dense(1, 2, 1)}, {"herg"})
    assert np.isclose(out["herg"], L.sigmoid(out["caco2"]))
    x, mask = L.encode_protein("ACZ", 5)
    assert np.allclose(x[2], 0.05) and mask.tolist() == [1, 1, 1, 0, 0]


def test_verlet_keeps_energy_and_langevin_is_seeded():
    grid = np.stack(np.meshgrid([0, 1.2], [0, 1.2], [0, 1.2]), -1).reshape(-1, 3)

    def energy(x, v):
        r2 = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        s6 = 1 / r2**3
        return (4 * (s6**2 - s6)).sum() + (v**2).sum() / 2

    t = L.integrate(grid, np.zeros_like(grid), L.lennard_jones_force, 400, 0.001)
    assert t.shape == (401, 8, 3) and np.allclose(t[0], grid)
    v = (t[-1] - t[-3]) / 0.002
    assert abs(energy(t[-2], v) - energy(grid, np.zeros_like(grid))) < 0.02
    a = L.integrate(grid, np.zeros_like(grid), L.lennard_jones_force, 5, mode="nvt_langevin")
    assert np.allclose(a, L.integrate(grid, np.zeros_like(grid), L.lennard_jones_force, 5, mode="nvt_langevin")) and not np.allclose(a, t[:6])
    with pytest.raises(ValueError):
        L.integrate(grid, grid, L.lennard_jones_force, 1, mode="other")


def test_gradient_by_differences():
    layers, x, y = L.dense(4, 3, 5, 4), RNG.normal(size=(6, 3)), RNG.integers(0, 4, 6)
    _, grads = L.network_gradient(x, y, layers)
    for k in range(2):
        w = layers[k][0]
        for i, j in ((0, 0), (2, 3)):
            moved = [(a.copy(), b.copy()) for a, b in layers]
            moved[k][0][i, j] += 1e-6
            assert np.isclose((L.network_gradient(x, y, moved)[0] - L.network_gradient(x, y, layers)[0]) / 1e-6, grads[k][0][i, j], atol=1e-4)
        assert w.shape == grads[k][0].shape


def test_training_lowers_the_loss_and_ridge_solves(spark):
    rows = [(i, [float(v) for v in RNG.normal(size=3) + 3 * np.eye(3)[i % 3]], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long").repartition(3)
    t = T.Trainer(L.dense(1, 3, 8, 3), rate=0.1).fit(df, epochs=6)
    assert len(t.history) == 6 and t.history[-1] < t.history[0]
    assert T.Trainer(L.dense(1, 3, 3)).fit(df.limit(0)).history == []
    x = np.array([r[1] for r in rows])
    w = T.ridge_fit(df.select(F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"), "label"), ["a", "b"], "label", 0.5)
    z = np.c_[x[:, :2], np.ones(120)]
    assert np.allclose(w, np.linalg.solve(z.T @ z + 0.5 * np.eye(3), z.T @ np.array([r[2] for r in rows])))
    weights = T.balance_weights({"a": 1.0, "b": 1.0}, {"a": 2.0, "b": 1.0}, {"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 1.0})
    assert np.isclose(sum(weights.values()), 2) and weights["a"] < weights["b"] and T.combine_losses({"a": 1, "b": 2}, {"b": 3}) == 7


def test_reductions_against_numpy(spark):
    x = RNG.normal(size=(60, 5)) @ RNG.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(4)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    v = R.signed(vectors[:, ::-1][:, :2])
    scores, comp, got = R.robust_pca(df, 2)
    assert np.allclose(comp, v, atol=1e-5) and np.allclose(got, values[::-1][:2], atol=1e-4)
    assert np.allclose([r.scores for r in scores.orderBy("id").collect()], c @ v, atol=1e-4)
    comp, got = R.matrix_free_pca(df, 2, rounds=12, oversampling=1)
    assert np.allclose(got, values[::-1][:2], rtol=1e-3) and np.allclose(comp, v, atol=0.02)
    z = np.clip(c / x.std(0), -10, 10)
    _, vectors = np.linalg.eigh(np.cov(z.T))
    fit = R.fit_pca(df, 3)
    assert np.allclose(fit.components, R.signed(vectors[:, ::-1][:, :3]), atol=1e-5)
    assert np.allclose([r.scores for r in fit.transform(df).orderBy("id").collect()], z @ fit.components, atol=1e-5)


def test_tfidf_svd_against_numpy(spark):
    m = RNG.poisson(1.0, (30, 6)).astype(float)
    m[:, 0] += 1
    df = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(30) for j in range(6) if m[i, j]], "cell_id long, gene_id string, value double")
    fit = R.fit_tfidf(df, 2)
    y = np.log1p(m / m.sum(1, keepdims=True) * (30 / m.sum(0)) * 1e4)
    v = R.signed(np.linalg.svd(y, full_matrices=False)[2].T[:, 1:3])
    got = np.array([r.scores for r in fit.transform(df).orderBy("cell_id").collect()])
    assert np.allclose(got, y @ v, atol=1e-4)


def test_phate_separates_groups():
    x = np.r_[RNG.normal(size=(10, 2)), RNG.normal(size=(10, 2)) + 30]
    y = R.phate(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6, 8, decay=2.0)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    assert y.shape == (20, 2) and np.median(d[:10, 10:]) > 2 * np.median(d[:10, :10])


def butina(ids, pairs):
    near = {i: {i} for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), {}
    for i in sorted(ids, key=lambda i: (len(near[i]), i), reverse=True):
        if i not in seen:
            for j in near[i] - seen:
                out[j] = i
            seen |= near[i]
    return out


def test_butina_clusters_by_loops(spark):
    for seed, chance in ((1, 0.05), (2, 0.12), (3, 0.0)):
        rng = np.random.default_rng(seed)
        pairs = [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < chance]
        ids = spark.range(40)
        df = spark.createDataFrame(pairs, "i long, j long")
        assert {r.id: r.cluster for r in B.butina_clusters(ids, df).collect()} == butina(range(40), pairs)


def test_molecules_without_fingerprint_go_to_train(spark):
    rows = spark.range(12).withColumnRenamed("id", "k")
    clusters = spark.createDataFrame([(i, i // 5) for i in range(10)], "id long, cluster long")
    got = {r.k: r.split for r in B.cluster_split(rows, clusters, "k", 0.4, 0.3).collect()}
    assert [got[i] for i in (0, 5, 10, 11)] == ["train", "valid", "train", "train"]


def test_nb_fit_recovers_the_means(spark):
    rows = [(i, "g", float(np.random.default_rng(i).poisson(np.exp(1 + 0.7 * (i % 2))))) for i in range(400)]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id string, value double")
    design = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(400)], "cell_id long, x double, size_factor double")
    r = E.nb_fit(counts, design, 0.05).first()
    m = [np.mean([v for i, _, v in rows if i % 2 == k]) for k in (0, 1)]
    assert np.isclose(r.intercept, np.log(m[0]), atol=1e-3) and np.isclose(r.slope, np.log(m[1] / m[0]), atol=1e-3)


def test_greedy_clusters_of_sequences_by_the_walk(spark):
    from strandlake.operators import kernels as K

    rng = np.random.default_rng(4)
    for threshold, n in ((0.5, 60), (0.3, 40)):
        rows = [(i, "".join(rng.choice(list("ACGT"), int(rng.integers(0, 9))))) for i in range(n)]
        df = spark.createDataFrame(rows, "seq_id long, sequence string")
        got = {r.id: r.representative for r in B.identity_clusters(df, threshold).collect()}
        assert got == K.greedy_clusters(rows, threshold)
    pairs = sorted((r.i, r.j) for r in B.identity_pairs(df, 0.3, block_rows=7).collect())
    assert pairs == sorted((r.i, r.j) for r in B.identity_pairs(df, 0.3).collect()) and len(pairs) > 10


def test_fates_and_sparse_dynamics(spark):
    from strandlake.operators import cells as C

    steps = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 2)], "source long, target long")
    assert {(r.state, r.terminal): round(r.p, 6) for r in C.fate_probabilities(steps, 2).collect()} == {(0, 1): 0.5, (0, 2): 0.5, (1, 1): 1, (1, 2): 0, (2, 1): 0, (2, 2): 1}
    x = RNG.uniform(-1, 1, 300)
    df = spark.createDataFrame([(float(v), float(2 * v - 1.5 * v * v)) for v in x], "x double, dx double")
    w = {r.term: r.weight for r in C.sparse_dynamics(df, ["x"], "dx").collect()}
    assert abs(w["x"] - 2) < 1e-3 and abs(w["x*x"] + 1.5) < 1e-3


def test_registries_and_checks(spark):
    from strandlake.plans import registries as G

    r = G.Registry("thing")
    r.register("a", dict)
    r.register("a", dict)
    with pytest.raises(ValueError):
        r.register("a", list)
    with pytest.raises(KeyError):
        r.get("b")
    assert r.create("a", x=1) == {"x": 1} and r.table(spark).first().name == "a"
    with pytest.raises(ValueError):
        G.check_embedding(spark.createDataFrame([(1, [1.0]), (2, None)], "id long, vec array<double>"))
    with pytest.raises(ValueError):
        G.comparison_key(["x"], {})
    with pytest.raises(KeyError):
        G.experimental_capability("nothing")


def test_missing_solvers_and_graders_are_errors(spark):
    from strandlake.operators import integration as I

    p = spark.createDataFrame([("a", "known", "exact", "1"), ("b", "known", "other", "1"), ("c", "missing", "exact", "1")], "problem_id string, task_type string, grader_type string, expected_answer string")
    exact = lambda a, e: F.struct((a == e).alias("passed"), (a == e).cast("double").alias("score"))
    got = {r.problem_id: (r.passed, r.error) for r in I.run_benchmark(p, {"known": lambda: spark.range(1, 2)}, {"exact": exact}).collect()}
    assert got == {"a": (True, None), "b": (False, "grading error: unknown grader"), "c": (False, "solve error: KeyError")}
