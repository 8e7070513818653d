"""Registered queries of the iterative fits; tests hold them against plain versions.

`em_fit`, `adamem_fit` and `brqn_fit` have Q on the driver if the samples, which are counted first, are few,
and go over a grid from the same start if they aren't. All others go over a grid of tiles.
"""

from __future__ import annotations

import uuid
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_folder
from ..operators import align, layout, mode_graph
from . import blocks as bl
from . import fit, views
from . import grid as gr
from . import grid_fit as gf
from .catalog import ORACLES, QUERIES, TILE, long_runs, places, query, r6, start

CLUSTERS = 4
QUICK = fit.Options(max_iter=6)
#: Samples of which the driver may hold Q, its history and its sums.
DRIVER_SAMPLES = 200_000

def begun(spark: SparkSession, sf_dir: str) -> tuple[bl.Blocks, fit.Fit] | tuple[gr.Grid, gf.Fit]:
    """Blocks of the dense view with a random start, or a grid with the same one if the samples are too many for
    the driver."""
    g, n_variants, n_samples = places(spark, sf_dir)
    if n_samples > DRIVER_SAMPLES:
        grid = laid(g, n_variants, n_samples)
        return grid, gf.random_start(grid, CLUSTERS, as_one=True)
    b = bl.to_blocks(g, n_variants, n_samples, block_rows=TILE["rows"])
    return b, fit.random_start(b, CLUSTERS)


def gridded(spark: SparkSession, sf_dir: str) -> gr.Grid:
    """A grid of the dense view, which stands if its variants are few."""
    return laid(*places(spark, sf_dir))


def laid(g: DataFrame, n_variants: int, n_samples: int) -> gr.Grid:
    grid = gr.to_grid(g, n_variants, n_samples, **TILE)
    return grid.standing() if n_variants <= gr.STANDING else grid


def q_table(spark: SparkSession, b: bl.Blocks | gr.Grid, f: fit.Fit | gf.Fit) -> DataFrame:
    if isinstance(b, gr.Grid):
        return q_of(b, f)
    return bl.q_rows(spark, np.round(f.q, 6)).select("sample_id", F.posexplode("q").alias("k", "q"))


def q_of(grid: gr.Grid, f: gf.Fit) -> DataFrame:
    return gf.q_rows(grid, f).select("sample_id", F.posexplode("q").alias("k", "q")).withColumn("q", r6("q"))


def method_of(b: bl.Blocks | gr.Grid) -> ModuleType:
    """The module of the fits over blocks or over a grid."""
    return gf if isinstance(b, gr.Grid) else fit


@query
def svd_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gf.svd(gridded(spark, sf_dir), CLUSTERS)[0]
    return spark.createDataFrame(pd.DataFrame({"component": range(len(s)), "value": np.round(s, 3)}))


@query
def als_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gridded(spark, sf_dir)
    return q_of(g, gf.als(g, gf.svd(g, CLUSTERS), CLUSTERS))


@query
def em_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, start = begun(spark, sf_dir)
    return q_table(spark, b, method_of(b).em(b, start, 5))


@query
def adamem_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, start = begun(spark, sf_dir)
    return q_table(spark, b, method_of(b).adaptive_em(b, start))


@query
def brqn_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six iterations, as the bench times them."""
    b, start = begun(spark, sf_dir)
    on = method_of(b)
    return q_table(spark, b, on.newton(b, on.em(b, start, 2), QUICK))


@query
def brqn_fit_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele frequencies of such a fit that goes on until it stands."""
    g = gridded(spark, sf_dir)
    f = gf.newton(g, gf.em(g, gf.random_start(g, CLUSTERS), 2))
    return gf.p_rows(g, f).select("variant_id", F.posexplode("p").alias("k", "p")).withColumn("p", r6("p"))


def known_labels(spark: SparkSession, sf_dir: str, below: int) -> DataFrame:
    """(sample_id, label) of the samples whose population is told."""
    return views.labelled(spark, sf_dir).where(F.col("label") < below)


@query
def projection_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples projected on the frequencies of the labelled populations."""
    g = gridded(spark, sf_dir)
    p = gf.p_rows(g, gf.supervised_start(g, known_labels(spark, sf_dir, views.K)))
    return q_of(g, gf.project(g, p, views.K))


@query
def projection_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by adaptive steps."""
    g = gridded(spark, sf_dir)
    p = gf.p_rows(g, gf.supervised_start(g, known_labels(spark, sf_dir, views.K)))
    return q_of(g, gf.project(g, p, views.K, adaptive=True))


@query
def supervised_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gridded(spark, sf_dir)
    return q_of(g, gf.newton(g, gf.supervised_start(g, known_labels(spark, sf_dir, 5))))


@query
def supervised_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gridded(spark, sf_dir)
    return q_of(g, gf.adaptive_em(g, gf.supervised_start(g, known_labels(spark, sf_dir, 5))))


@query
def cv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of five updates, in the same passes."""
    g = gridded(spark, sf_dir)
    f = gf.em(g, gf.random_start(g, CLUSTERS), 5)
    return spark.createDataFrame([(CLUSTERS, round(gf.cross_validate(g, f), 6))], "k int, cv_index double")


@query
def best_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four random starts after their EM steps, which share their passes, and the one that is gone on with."""
    g = gridded(spark, sf_dir)
    f = gf.em(g, gf.random_start(g, CLUSTERS, [42 + i for i in range(4)]), 5)
    rows = spark.createDataFrame(list(enumerate(f.log_likelihood)), "start int, log_likelihood double")
    best = rows.agg(F.max_by("start", F.struct("log_likelihood", -F.col("start"))).alias("best"))
    return rows.crossJoin(best).select("start", F.round("log_likelihood", 3).alias("log_likelihood"), (F.col("start") == F.col("best")).alias("chosen"))


@query
def multi_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of two and three populations until they stand, each a stage that is written, with their columns in
    one order, likelihoods and cross-validation indices."""
    g = gridded(spark, sf_dir)
    folder = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    out = None
    for k, s in gf.sweep(g, [2, 3], folder, folds=5, start="random").items():
        one = q_of(g, s.fit).select(F.lit(k).alias("n_clusters"), "sample_id", "k", "q", F.lit(round(s.fit.log_likelihood[0], 3)).alias("log_likelihood"), F.lit(s.iterations).alias("iterations"), F.lit(round(s.cv_index, 6)).alias("cv_index"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def em_two_steps_on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two EM steps over a grid of small tiles, from the labels' frequencies; the same SQL as for the long form."""
    _, p, q = start(spark, sf_dir)
    g, n_variants, n_samples = places(spark, sf_dir)
    grid = gr.to_grid(g, n_variants, n_samples, rows=16, cols=128, high=2, wide=2)
    begun = grid.state_of(gr.P, p, "variant_id", "p").unionByName(grid.state_of(gr.Q, q, "sample_id", "q"))
    return q_of(grid, gf.em(grid, gf.Fit(begun, views.K, [0.0]), 2))


ORACLES["em_two_steps_on_tiles"] = ORACLES["em_two_steps"]


@query
def loglik_on_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of given P and Q over a grid, as an evaluation of files takes it."""
    _, p, q = start(spark, sf_dir)
    return spark.createDataFrame([(round(gf.likelihood_of(gridded(spark, sf_dir), p, q), 2),)], "loglik double")


ORACLES["loglik_on_tiles"] = ORACLES["loglik_total"]


@query
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m["mode"], int(m["representative"]), m["size"], round(float(m["cost"]), 9)) for m in align.modes(long_runs(spark, sf_dir))]
    return spark.createDataFrame(rows, "mode string, representative int, size int, cost double")


def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of three numbers of clusters: two runs as they are, and with their last or first columns summed."""
    out = None
    for run in (0, 1):
        q = long_runs(spark, sf_dir).where(f"run_id = {run}").select("sample_id", "k", "q")
        for less in (0, 1, 3):
            to = F.greatest(F.col("k") - less, F.lit(0)) if run else F.least(F.col("k"), F.lit(views.K - 1 - less))
            one = q.groupBy("sample_id", to.alias("k")).agg(F.sum("q").alias("q")).withColumn("mode", F.lit(f"K{views.K - less}M{run + 1}"))
            out = one if out is None else out.unionByName(one)
    return out


def filemap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three numbers of clusters, as a filemap names them: those of the full number, and with their last two
    or four columns summed."""
    out = None
    for n, less in enumerate((0, 1, 3)):
        last = views.K - 1 - less
        one = long_runs(spark, sf_dir).select((F.col("run_id") + 10 * n).alias("run_id"), "sample_id", F.pmod(F.col("k") + F.col("run_id"), F.lit(views.K)).alias("k"), "q")
        one = one.groupBy("run_id", "sample_id", F.least("k", F.lit(last)).cast("int").alias("k")).agg(F.sum("q").alias("q"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def filemap_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes of runs of several K, by K, with how well their runs agree."""
    rows = [(m["mode"], m["k"], m["representative"], m["size"], round(m["cost"], 9), round(m["performance"], 6)) for m in align.modes(filemap_runs(spark, sf_dir))]
    return spark.createDataFrame(rows, "mode string, n_clusters int, representative int, size int, cost double, performance double")


@query
def filemap_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the modes' mean memberships, columns that go together in one place, samples in one order."""
    rows = mode_graph.of_runs(filemap_runs(spark, sf_dir), mean=True)[2]
    stacks = layout.cumulative_bars(rows.withColumn("q", F.round("q", 9)).withColumn("_s", F.struct("mode", "sample_id")).select(F.col("_s").alias("sample_id"), "k", "q"))
    order = layout.sample_order(views.q_est(spark, sf_dir).withColumn("q", F.transform("q", lambda x: F.round(x, 9))), views.labelled(spark, sf_dir)).select("sample_id", "pos")
    bars = stacks.select(F.col("sample_id.mode").alias("mode"), F.col("sample_id.sample_id").alias("sample_id"), "k", "low", "high").join(order, "sample_id")
    return bars.select("mode", "pos", "k", F.abs(r6("low")).alias("low"), r6("high").alias("high"))


@query
def modes_across_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs between modes of one and of neighbouring numbers of clusters, and which lead from one to the next."""
    return mode_graph.table(mode_table(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query
def modes_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes with columns that go together in one place."""
    m = mode_table(spark, sf_dir)
    return mode_graph.reordered(m, mode_graph.orders(mode_graph.products(m))).withColumn("q", F.round("q", 6))


__all__ = ["QUERIES"]
