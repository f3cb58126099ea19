import zlib

import numpy as np

from strandlake.llm import langid as L
from strandlake.llm import quality as Q


def test_statistics_are_finite_and_of_fixed_length():
    for t in (b"", b" \n ", b"a", "é".encode() * 5000, b"LOUD!! TEXT!!\nb | c | d\n\n***", b"\n" * 50 + b"x"):
        x = Q.statistics(t)
        assert len(x) == Q.N_STATISTICS and np.isfinite(x).all()


def test_isotonic_is_monotone_and_fits_means():
    rng = np.random.default_rng(2)
    s = rng.uniform(size=500)
    y = (rng.uniform(size=500) < s).astype(float)
    knots, levels = Q.isotonic(s, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= -1e-12).all() and 0 < levels[0] and levels[-1] < 1


def test_isotonic_pools_equal_scores_in_any_order():
    s, y = np.array([0.5, 0.5, 0.5, 0.5, 0.9]), np.array([0.0, 0, 1, 1, 1])
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 0, 4, 3, 1]):
        knots, levels = Q.isotonic(s[order], y[order])
        assert knots.tolist() == [0.5, 0.9] and levels[0] == 0.5


def test_fit_equals_a_direct_solve(spark):
    """The partition-summed equations, ridge weights and calibration against NumPy over all rows at once."""
    docs, labels = noisy(spark)
    model = Q.fit(docs.repartition(5), labels)
    known = {}
    for r in labels.collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known.setdefault(r.doc_id, []).append(r.quality)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id in known]
    x, y = np.array([Q.statistics(t) for _, t in rows], np.float64), np.array([np.mean(known[i]) for i, _ in rows])
    assert np.allclose(model.mean, x.mean(0), atol=1e-6) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3), atol=1e-6)
    z = model.expand(x)
    ridge = lambda a, b: np.linalg.solve(a.T @ a + Q.RIDGE * np.eye(a.shape[1]), a.T @ b)
    assert np.allclose(z @ ridge(z, y), z @ model.weights, atol=1e-5)
    fold = {r.i: r.f for r in spark.range(400).selectExpr("id AS i", f"pmod(xxhash64(id, {5 + 1}), {Q.FOLDS}) AS f").collect()}
    f = np.array([fold[i] for i, _ in rows])
    out = np.zeros(len(rows))
    for k in range(Q.FOLDS):
        out[f == k] = z[f == k] @ ridge(z[f != k], y[f != k])
    knots, levels = Q.isotonic(out, y)
    at = np.linspace(-0.5, 1.5, 50)
    assert np.allclose(np.interp(at, knots, levels), np.interp(at, model.knots, model.levels), atol=0.02)


def test_quality_of_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int")
    docs = odd_docs.selectExpr("*", "1 AS __id", "2 AS __doc", "3 AS __body", "4 AS __score", "5 AS quality", "6 AS fold")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert Q.keep_good(no_docs, labels).count() == 0


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, f = 5, 6000
    m = Q.Model(np.zeros(d), np.ones(d), rng.normal(0, 0.5, (d, f)), rng.uniform(0, 6.283185, f), None, None, None)
    x = rng.normal(size=(4, d))
    z = m.expand(x)[:, :-1]
    want = np.exp(-0.125 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.06


def noisy(spark, n=240):
    good, bad = "The valley was quiet and the river ran slowly past the old mill. ", "BUY!! NOW!! $$$ *** "
    rows = [(i, (good if i % 3 else bad) * (2 + i % 4)) for i in range(n)] + [(None, None), (n, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, n, 2)] + [(0, 0), (5, None)], "doc_id long, quality int")
    return docs, labels


def test_quality_learns_and_scores_every_row(spark):
    docs, labels = noisy(spark)
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.9
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.predicted for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {1}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    k, n = 3, 5
    e, t = rng.uniform(0.1, 1, (n, k)), rng.normal(size=(k, k))
    potential, live = np.ones((1, L.BLOCK, k)), np.zeros((1, L.BLOCK), bool)
    potential[0, :n], live[0, :n] = e, True
    got = L.marginals(potential, live, t, np.array([0]), np.array([0]))[0, :n]
    want = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        p = np.prod([e[i, s] for i, s in enumerate(path)]) * np.exp(sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, s in enumerate(path):
            want[i, s] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_blocks_do_not_change_the_marginals():
    rng = np.random.default_rng(4)
    n, k = 2 * L.BLOCK + 7, 2
    e, t = rng.uniform(0.1, 1, (n, k)), rng.normal(size=(k, k))
    block, place, first, of = L.chain_blocks(np.zeros(n, int))
    potential, live = np.ones((len(of), L.BLOCK, k)), np.zeros((len(of), L.BLOCK), bool)
    potential[block, place], live[block, place] = e, True
    got = L.marginals(potential, live, t, first, of)[block, place]
    a = np.exp(t)
    f, b = [e[0] / 2], [np.ones(k)]
    for i in range(1, n):
        m = (f[-1] @ a) * e[i]
        f.append(m / m.sum())
    for i in range(n - 1, 0, -1):
        m = a @ (e[i] * b[-1])
        b.append(m / m.sum())
    p = np.array(f) * np.array(b[::-1])
    assert np.allclose(got, p / p.sum(1, keepdims=True))


def test_code_switched_words_are_labelled_by_word():
    en, de = "the river ran past the mill and then through the valley", "der fluss lief an der mühle vorbei und dann durch das tal"
    model = L.train([("en", en)] * 10 + [("de", de)] * 10, sequences=200, rounds=30)
    doc, post = L.label_words(model, [f"{en} {de}"])
    names = [model.labels[j] for j in post.argmax(1)]
    assert names[:11] == ["en"] * 11 and names[-10:] == ["de"] * 10


def test_languages_of_documents(spark, odd_docs, no_docs):
    words = {"en": "the river ran past the mill", "fr": "la rivière coule près du moulin"}
    docs = spark.createDataFrame([(i, words["en" if i % 2 else "fr"], "en" if i % 2 else "fr") for i in range(90)] + [(90, None, None), (91, "123 !!", "en"), (None, "the mill", None)], "doc_id long, text string, lang string")
    got = L.language_ids(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (90, 91):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "fr")
    assert L.language_ids(odd_docs).count() == odd_docs.count()
    assert L.language_ids(no_docs).count() == 0
