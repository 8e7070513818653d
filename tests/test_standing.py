"""Fits on a standing grid, whose rows of Q stay with their genotypes, against those on a grid that moves them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genostrata.functions import kernels as kn
from genostrata.plans import fit, grid as gr, grid_fit as gf

from test_grid import K, data, small_options, whole  # noqa: F401


@pytest.fixture(scope="module")
def grids(data):  # noqa: F811
    moved = gr.to_grid(data[3], *data[0].shape, rows=25, cols=8, high=2, wide=2)
    return moved, moved.standing()


def test_the_same_fits(grids, monkeypatch):
    moved, still = grids
    monkeypatch.setattr(gr, "FAN", 2)
    monkeypatch.setattr(gr, "CUT_STANDING", 3)
    both = [gf.em(g, gf.random_start(g, K, [1, 2]), 2) for g in grids]
    assert np.allclose(*(f.course for f in both), rtol=1e-12)
    for method in (lambda g, f: gf.newton(g, f, small_options(4)), lambda g, f: gf.adaptive_em(g, f, small_options(6)), lambda g, f: gf.newton(g, f, fixed_p=True, iterations=2)):
        a, b = (method(g, f) for g, f in zip(grids, both))
        assert np.allclose(a.course, b.course, rtol=1e-9) and np.allclose(a.log_likelihood, b.log_likelihood, rtol=1e-10)
        for x, y in zip(whole(moved, a, 1), whole(still, b, 1)):
            assert np.allclose(x, y, atol=1e-8)
    cv = [gf.cross_validate(g, gf.best_of(g, f), 3, iterations=2) for g, f in zip(grids, both)]
    assert cv[0] == pytest.approx(cv[1], rel=1e-9)
    s = [gf.svd(g, K)[0] for g in grids]
    assert np.allclose(*s, rtol=1e-9)


def test_supervised_and_projected(spark, grids):
    known = spark.createDataFrame([(i, i % K if i % 4 else -1) for i in range(41)], "sample_id long, label int")
    starts = [gf.supervised_start(g, known) for g in grids]
    a, b = (gf.newton(g, f, small_options(2)) for g, f in zip(grids, starts))
    assert a.log_likelihood == pytest.approx(b.log_likelihood, rel=1e-10)
    a, b = (gf.project(g, gf.p_rows(g, f).drop("b"), K, small_options(6), adaptive=True) for g, f in zip(grids, starts))
    assert a.log_likelihood == pytest.approx(b.log_likelihood, rel=1e-10)
    for x, y in zip(whole(grids[0], a), whole(grids[1], b)):
        assert np.allclose(x, y, atol=1e-8)


def test_chunks_without_genotypes_and_bounds(spark):
    rows = spark.createDataFrame([(v, s, (v + s) % 3) for v in range(9) for s in range(4)], "variant_id long, sample_id long, g int")
    grids = [(g := gr.to_grid(rows, 9, 12, rows=4, cols=4, high=1, wide=1)), g.standing()]
    a, b = (gf.random_start(g, 2).log_likelihood for g in grids)
    assert a == pytest.approx(b, rel=1e-12)
    got = gf.em(grids[1], gf.random_start(grids[1], 2), 2)
    p, q = whole(grids[1], got)
    assert np.isfinite(p).all() and np.allclose(q.sum(1), 1)
    with pytest.raises(ValueError, match="variants"):
        gr.to_grid(rows, 2000, 12).standing()


def test_a_pass_moves_no_rows_of_samples(spark, grids):
    """What a pass shuffles doesn't grow with the layers of the samples, and old states are let go."""
    still = grids[1]
    files = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    f = gf.random_start(still, K)
    state = still.step(f.state, K, gf.em_kernel, [0], [0], finish_q=lambda s, sums, b, i, y: (kn.em_rows_q(s[0], sums)[None], None))
    before, kept = files(), spark.sparkContext._jsc.getPersistentRDDs().size()
    for _ in range(6):
        state = still.step(state, K, gf.em_kernel, [0], [0], finish_q=lambda s, sums, b, i, y: (kn.em_rows_q(s[0], sums)[None], None))
    assert not {x for x in files() - before if "/shuffle_" in x}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept + 1
    assert state.where(F.col("kind") == gr.Q).count() == still.chunks
