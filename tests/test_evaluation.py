"""The likelihood of P and Q files for genotype files, and the checks of what goes together."""

import numpy as np
import pytest
from test_reference import bed_bytes

from genostrata.functions import kernels as kn
from genostrata.plans import evaluation, grid as gr, grid_fit as gf
from genostrata.sources import sinks


def test_likelihood_of_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    m, n = 60, 7
    g = rng.choice(4, (m, n), p=[0.6, 0.25, 0.1, 0.05])
    chrom = [str(1 + i % 3) for i in range(m)]
    (tmp_path / "d.bed").write_bytes(bed_bytes(g))
    (tmp_path / "d.bim").write_text("".join(f"{c} v{i} 0 {i} A G\n" for i, c in enumerate(chrom)))
    (tmp_path / "d.fam").write_text("".join(f"f i{i} 0 0 1 -9\n" for i in range(n)))
    kept = [i for i in range(m) if chrom[i] == "2"]
    p, q = rng.uniform(0.05, 0.95, (len(kept), 3)), rng.dirichlet(np.ones(3), n)
    frames = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], f"{key} long, {name} array<double>") for a, key, name in ((p, "variant_id", "p"), (q, "sample_id", "q"))]
    sinks.write_fit(frames[1], frames[0], str(tmp_path), "run", 3)
    got = evaluation.log_likelihood(spark, f"{tmp_path}/d.bed", f"{tmp_path}/run.3.P", f"{tmp_path}/run.3.Q", chromosomes="2").first()
    assert got["k"] == 3 and got["loglik"] == pytest.approx(kn.log_likelihood(g[kept], p, kn.normalize(q)), rel=1e-9)
    with pytest.raises(ValueError, match="P: 20 rows"):
        evaluation.log_likelihood(spark, f"{tmp_path}/d.bed", f"{tmp_path}/run.3.P", f"{tmp_path}/run.3.Q", mode="all")


def test_what_does_not_go_together_is_an_error(spark):
    grid = gr.to_grid(spark.createDataFrame([(v, s, 1) for v in range(4) for s in range(5)], "variant_id long, sample_id int, g int"), 4, 5)
    p = spark.createDataFrame([(i, [0.5, 0.4]) for i in range(4)], "variant_id long, p array<double>")
    q = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(5)], "sample_id long, q array<double>")
    assert gf.likelihood_of(grid, p, q) < 0
    for bad_p, bad_q in ((p.where("variant_id > 0"), q), (p.union(p.limit(1)), q), (p, q.where("sample_id < 4")), (p, q.selectExpr("sample_id", "array(1D) AS q"))):
        with pytest.raises(ValueError):
            gf.likelihood_of(grid, bad_p, bad_q)
    with pytest.raises(ValueError):
        gf.project(grid, p.where("variant_id <> 2"), 2)
    for rows in ([(0, 0), (7, 1)], [(0, 0), (0, 1)], [(-1, 0), (0, 1)], []):
        with pytest.raises(ValueError):
            gf.supervised_start(grid, spark.createDataFrame(rows, "sample_id long, label int"))
