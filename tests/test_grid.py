"""Fits on a grid of tiles against the fits whose Q is on the driver, and against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genostrata.functions import kernels as kn
from genostrata.operators import align
from genostrata.plans import blocks as bl, fit, grid as gr, grid_fit as gf

K = 3


def small_options(n):
    return fit.Options(max_iter=n)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    m, n = 120, 41
    p, q = rng.uniform(0.05, 0.95, (m, K)), rng.dirichlet(np.full(K, 0.2), n)
    g = rng.binomial(2, np.clip(p @ q.T, 0, 1))
    g[rng.random((m, n)) < 0.03] = 3
    df = spark.createDataFrame([(int(v), int(s), int(g[v, s])) for v in range(m) for s in range(n) if g[v, s] != 3 or s % 2], "variant_id long, sample_id int, g int")
    return g, q, bl.to_blocks(df, m, n, block_rows=50), df


@pytest.fixture(scope="module")
def grid(data):
    # 5 blocks by 6 chunks, parts of 2 by 2 tiles
    return gr.to_grid(data[3], *data[0].shape, rows=25, cols=8, high=2, wide=2)


def whole(grid, f, b=0):
    p, q = np.zeros((grid.n_variants, f.k)), np.zeros((grid.n_samples, f.k))
    for r in gf.p_rows(grid, f).where(F.col("b") == b).collect():
        p[r["variant_id"]] = r["p"]
    for r in gf.q_rows(grid, f).where(F.col("b") == b).collect():
        q[r["sample_id"]] = r["q"]
    return p, q


def same_start(spark, grid, blocks, f):
    """A grid's state of a fit whose Q is on the driver."""
    k = f.q.shape[1]
    p, q = grid.state_of(gr.P, blocks.rows(f.p, 1, k), "variant_id", "p"), grid.state_of(gr.Q, bl.q_rows(spark, f.q), "sample_id", "q")
    return gf.Fit(p.unionByName(q), k, [f.log_likelihood])


def test_tiles_hold_the_genotypes(data, grid, spark):
    g = data[0]
    got = np.full(g.shape, 9)
    for r in grid.tiles.collect():
        x = gr.unpacked(r["g"], grid.size(gr.Q, r["chunk"]))
        got[r["block"] * 25 : r["block"] * 25 + len(x), r["chunk"] * 8 : r["chunk"] * 8 + x.shape[1]] = x
        assert r["part"] == r["block"] // 2 * 3 + r["chunk"] // 2
    assert (got == g).all()
    rows = spark.createDataFrame([(v, g.shape[1], bytearray(gr.packed(g[v : v + 1].astype(np.uint8)))) for v in range(len(g))], "variant_id long, n int, bits binary")
    again = {(r["block"], r["chunk"]): r["g"] for r in gr.packed_grid(rows, *g.shape, rows=25, cols=8, high=2, wide=2).tiles.collect()}
    assert again == {(r["block"], r["chunk"]): r["g"] for r in grid.tiles.collect()}


def test_em_and_newton_equal_those_on_the_driver(spark, data, grid):
    g, _, blocks, _ = data
    start = fit.random_start(blocks, K)
    begun = same_start(spark, grid, blocks, start)
    a, b = fit.em(blocks, start, 3), gf.em(grid, begun, 3)
    assert np.allclose(a.course, b.course[0], rtol=1e-12)
    p, q = whole(grid, b)
    assert np.allclose(a.q, q, atol=1e-9) and kn.log_likelihood(g, p, q) == pytest.approx(b.log_likelihood[0], rel=1e-12)
    a, b = fit.newton(blocks, a, small_options(4)), gf.newton(grid, b, small_options(4))
    assert np.allclose(a.course, b.course[0], rtol=1e-9) and a.log_likelihood == pytest.approx(b.log_likelihood[0], rel=1e-11)
    p, q = whole(grid, b)
    assert np.allclose(a.q, q, atol=1e-9) and kn.log_likelihood(g, p, q) == pytest.approx(b.log_likelihood[0], rel=1e-11)
    a, b = fit.adaptive_em(blocks, start, small_options(5)), gf.adaptive_em(grid, begun, small_options(5))
    assert np.allclose(a.course, b.course[0], rtol=1e-11) and np.allclose(a.q, whole(grid, b)[1], atol=1e-9)


def test_no_pass_gathers_all_samples_or_variants(data, grid, monkeypatch):
    """Every array that a task gets or gives belongs to one block or one chunk; sums meet at most FAN at a time."""
    monkeypatch.setattr(gr, "FAN", 2)
    start = gf.random_start(grid, K)
    seen = gf.newton(grid, start, small_options(1))
    wide = 1 + K + K * K
    for state in (start.state, seen.state):
        assert all(len(r["s"]) <= 8 * 25 * K * 20 for r in state.collect())
    partial = grid.partials(start.state, K, lambda g, p, q, at: (np.concatenate(kn.newton_p(g, p[0], q[0]), axis=1), np.concatenate(kn.newton_q(g, p[0], q[0]), axis=1), [1.0]), {gr.P: [0], gr.Q: [0]})
    rows = [r for r in partial.collect() if r["part"] >= 0]
    assert max(len(r["x"]) for r in rows) <= 8 * 25 * wide
    most = {}
    for r in rows:
        most[r["kind"], r["id"]] = most.get((r["kind"], r["id"]), 0) + 1
    assert max(most.values()) <= 2 and {k for k, _ in most} == {gr.P, gr.Q, gr.SUMS}
    plan = partial._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan
    monkeypatch.undo()
    assert np.allclose(whole(grid, seen)[1], whole(grid, gf.newton(grid, start, small_options(1)))[1], atol=1e-10)


def test_folds_and_starts_share_their_passes(spark, data, grid):
    _, _, blocks, _ = data
    f = fit.em(blocks, fit.random_start(blocks, K), 2)
    mine = gf.em(grid, same_start(spark, grid, blocks, fit.random_start(blocks, K)), 2)
    before = grid.passes[0]
    got = gf.cross_validate(grid, mine, 5, iterations=2)
    took = grid.passes[0] - before
    assert got == pytest.approx(fit.cross_validate(blocks, f, 5, iterations=2), rel=1e-9)
    assert took <= 2 * 6 + 8  # passes of two iterations, and those before and after them, whatever the folds
    many = gf.em(grid, gf.random_start(grid, K, [1, 2, 3]), 2)
    alone = gf.em(grid, gf.random_start(grid, K, [2]), 2)
    assert many.log_likelihood[1] == pytest.approx(alone.log_likelihood[0], rel=1e-12)
    best = gf.best_of(grid, many)
    assert best.members == 1 and best.log_likelihood[0] == max(many.log_likelihood)
    three = gf.newton(grid, many, small_options(2))
    assert three.log_likelihood[1] == pytest.approx(gf.newton(grid, alone, small_options(2)).log_likelihood[0], rel=1e-9)


def test_singular_values_to_those_of_numpy(data, grid):
    g = data[0]
    s, state, width = gf.svd(grid, 4, power=30, tol=1e-12)
    x = fit.centred(g)
    u, exact, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, exact[:4], rtol=1e-6)
    v = np.concatenate([np.array([r["v"] for r in grid.arrays(state, gr.Q, width, "v", "sample_id").orderBy("sample_id").collect()])])
    assert np.allclose(v.T @ v, np.eye(width), atol=1e-9) and np.allclose(np.abs((v[:, :2] * vt[:2].T).sum(0)), 1, atol=1e-5)
    r = gf.r_factor(grid, state, width)
    assert np.allclose(np.abs(np.diag(r)), 1, atol=1e-9) and np.allclose(r, np.triu(r))


def test_als_start(data, grid):
    f = gf.als(grid, gf.svd(grid, K), K)
    p, q = whole(grid, f)
    assert kn.log_likelihood(data[0], p, q) == pytest.approx(f.log_likelihood[0], rel=1e-10)
    order = align.permutation(data[1], q)
    assert np.sqrt(((q[:, order] - data[1]) ** 2).mean()) < 0.2


def plain_adaptive(g, p, q, steps):
    """The likelihoods, at each fifth step, of adaptive steps that move Q alone."""
    o, m, v, course = fit.Options(), 0, 0, []

    def em(q):
        return kn.em_rows_q(q, kn.em_terms(g, p, q)[1])

    q = em(q)
    for t in range(1, steps + 3):
        if t > 1 and (t - 2) % o.check == 0:
            course.append(kn.log_likelihood(g, p, q))
        d = em(q) - q
        m, v = o.beta1 * m + (1 - o.beta1) * d, o.beta2 * v + (1 - o.beta2) * d * d
        q = kn.normalize(q + o.lr * (m / (1 - o.beta1**t)) / (np.sqrt(v / (1 - o.beta2**t)) + o.eps))
        q = em(q) if t == 1 else q
    return course


@pytest.mark.parametrize("adaptive", [False, True])
def test_projection_and_labels(spark, data, grid, adaptive):
    g, q, blocks, _ = data
    best = gf.newton(grid, gf.em(grid, gf.random_start(grid, K), 4), small_options(8))
    again = gf.project(grid, gf.p_rows(grid, best).select("variant_id", "p"), K, small_options(8), adaptive)
    assert kn.log_likelihood(g, *whole(grid, again)) == pytest.approx(again.log_likelihood[0], rel=1e-10)
    if adaptive:
        start = np.concatenate([kn.normalize(np.random.default_rng([42, 0, i]).random((min(8, 41 - 8 * i), K))) for i in range(6)])
        assert np.allclose(again.course[0], plain_adaptive(g, whole(grid, best)[0], start, 8), rtol=1e-11)
    else:  # Q is the best for this P, so it is no less likely than the one that was found along with it
        assert again.log_likelihood[0] >= best.log_likelihood[0] - 0.2
    assert np.allclose(whole(grid, again)[0], whole(grid, best)[0])
    y = np.where(q.max(1) > 0.9, q.argmax(1), -1)
    known = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, None)], "sample_id long, label int").where("sample_id <> 0 OR label IS NOT NULL")
    start, plain = gf.supervised_start(grid, known), fit.supervised_start(blocks, y)
    assert np.allclose(whole(grid, start)[0], np.array([r["p"] for r in blocks.rows(plain.p, 1, K).orderBy("variant_id").collect()]))
    f = gf.adaptive_em(grid, start, small_options(10)) if adaptive else gf.newton(grid, start, small_options(3))
    at = np.flatnonzero(y >= 0)
    assert len(at) and (whole(grid, f)[1][at, y[at]] > 0.99).all()
    with pytest.raises(ValueError):
        gf.supervised_start(grid, known.where("label = 0 OR label < 0"))


def test_one_tile(spark, data):
    one = gr.to_grid(data[3], *data[0].shape)
    assert (one.blocks, one.chunks) == (1, 1)
    f = gf.newton(one, gf.em(one, gf.random_start(one, K), 2), small_options(2))
    assert f.log_likelihood[0] == pytest.approx(kn.log_likelihood(data[0], *whole(one, f)), rel=1e-10)


def test_a_sweep_goes_on_after_a_failure(spark, data, grid, tmp_path, monkeypatch):
    seen, train = [], gf.train

    def stopping(grid, k, **more):
        seen.append(k)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return train(grid, k, **more)

    monkeypatch.setattr(gf, "train", stopping)
    o, folder = fit.Options(max_iter=2, em_steps=1), f"{tmp_path}/sweep"
    with pytest.raises(RuntimeError):
        gf.sweep(grid, [3, 2], folder, o, start="random")
    got = gf.sweep(grid, [3, 2], folder, o, start="random")
    assert seen == [2, 3, 3] and list(got) == [2, 3] and got[3].iterations == 2 and got[3].cv_index is None
    again = gf.sweep(grid, [2, 3], folder, o, start="random")
    assert seen == [2, 3, 3] and again[3].fit.log_likelihood == got[3].fit.log_likelihood
    two, three = (whole(grid, got[k].fit) for k in (2, 3))
    assert kn.log_likelihood(data[0], *three) == pytest.approx(got[3].fit.log_likelihood[0], rel=1e-10)
    assert np.allclose(gf.column_costs(grid, got[3].fit, got[2].fit), align.distances(three[1], two[1]))
    assert align.permutation(two[1], three[1]) == [0, 1, 2]  # the columns stand in the order of the K before
    got[2].cv_index, got[3].cv_index = 0.51234, 0.5
    gf.write_sweep(grid, got, f"{tmp_path}/out", "run")
    read = np.array([[float(x) for x in r["value"].split()] for r in spark.read.text(f"{tmp_path}/out/run.3.Q").collect()])
    assert np.allclose(read, three[1], rtol=1e-15)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out/run.cv").collect()] == ["K=2: CV index = 0.5123", "K=3: CV index = 0.5000"]


@pytest.mark.parametrize("fan", [16, 1])
def test_products_of_every_two_variants(data, grid, monkeypatch, fan):
    monkeypatch.setattr(gr, "FAN", max(2, fan))
    g = data[0]
    seen = (g != 3).astype(int)
    x = g * seen
    want = [seen @ seen.T, x @ seen.T, seen @ x.T, x @ x.T]
    got = gr.products(grid).collect()
    assert len(got) == (np.triu(want[0]) > 0).sum() and len({(r["i"], r["j"]) for r in got}) == len(got)
    assert all(r["i"] <= r["j"] and (r["n"], r["ga"], r["gb"], r["gg"]) == tuple(w[r["i"], r["j"]] for w in want) for r in got)
