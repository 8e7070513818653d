"""Fits of more samples than the driver holds, from the same start."""

from functools import partial

import numpy as np
import pytest

from genostrata.plans import fits, views


@pytest.mark.parametrize("name", ["em_fit", "brqn_fit", "adamem_fit"])
def test_more_samples_than_the_driver_holds(spark, tmp_path, monkeypatch, name):
    for module in (fits.fit, fits.gf):  # rounding grows over hundreds of adaptive steps
        monkeypatch.setattr(module, "adaptive_em", partial(module.adaptive_em, o=fits.fit.Options(max_iter=4)))
    rng = np.random.default_rng(3)
    rows = [(i, [float(rng.normal((i * (v + 3)) % 4 / 10, 0.1)) for v in range(64)], i % 10) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert views.dense(spark, str(tmp_path)).count() == 5760
    monkeypatch.setattr(fits, "TILE", fits.TILE | {"cols": 32})
    got = {}
    for most in (fits.DRIVER_SAMPLES, 80):
        monkeypatch.setattr(fits, "DRIVER_SAMPLES", most)
        got[most] = {(r["sample_id"], r["k"]): r["q"] for r in fits.QUERIES[name](spark, str(tmp_path)).collect()}
    few, many = got.values()
    assert few.keys() == many.keys() and len(few) == 90 * fits.CLUSTERS
    assert max(abs(few[k] - many[k]) for k in few) < 2e-6
