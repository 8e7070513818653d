"""Comparison of runs: costs between clusters, merging, error and stability measures.

Q tables are in long form (sample_id, k, q), with run_id where there are several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import align


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Values of two tables side by side as a and b."""
    return a.select(*keys, F.col("q").alias("a")).join(b.select(*keys, F.col("q").alias("b")), keys)


def cluster_costs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k1, k2, cost): mean squared distance of every column of a from every column of b."""
    one = a.select("sample_id", F.col("k").alias("k1"), F.col("q").alias("qa"))
    two = b.select("sample_id", F.col("k").alias("k2"), F.col("q").alias("qb"))
    d = F.col("qa") - F.col("qb")
    return one.join(two, "sample_id").groupBy("k1", "k2").agg(F.avg(d * d).alias("cost"))


def run_pairs(runs: DataFrame) -> DataFrame:
    """Values of every two runs, run1 < run2, side by side. Runs are few; the join is by sample and cluster."""
    a, b = runs.alias("a"), runs.alias("b")
    on = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.run_id") < F.col("b.run_id"))
    return a.join(b, on).select(F.col("a.run_id").alias("run1"), F.col("b.run_id").alias("run2"), F.col("a.sample_id").alias("sample_id"), F.col("a.k").alias("k"), F.col("a.q").alias("a"), F.col("b.q").alias("b"))


def column_map(between: dict[tuple, np.ndarray], runs: DataFrame) -> DataFrame:
    """(run1, run2, k, k2): the column of run2 that goes with column k of run1, the nearest pairs first.
    A row for each column of each two runs."""
    rows = [(i, j, a, b) for (i, j), d in between.items() for a, b in align.greedy(d)]
    kind = dict(runs.dtypes)["run_id"]
    return runs.sparkSession.createDataFrame(rows, f"run1 {kind}, run2 {kind}, k int, k2 int")


def aligned_pairs(runs: DataFrame) -> DataFrame:
    """As run_pairs, each two runs' columns matched to each other."""
    m = column_map(align.run_distances(runs), runs)
    a = runs.select(F.col("run_id").alias("run1"), "sample_id", "k", F.col("q").alias("a"))
    b = runs.select(F.col("run_id").alias("run2"), "sample_id", F.col("k").alias("k2"), F.col("q").alias("b"))
    return a.join(F.broadcast(m), ["run1", "k"]).join(b, ["run2", "sample_id", "k2"]).select("run1", "run2", "sample_id", "k", "a", "b")


def aligned_to(runs: DataFrame, reference: int | str) -> DataFrame:
    """runs with the columns of all in the order of the reference run's."""
    between = align.run_distances(runs)
    own = {j if i == reference else i: (d if i == reference else d.T) for (i, j), d in between.items() if reference in (i, j)}
    m = column_map({(reference, x): d for x, d in own.items()}, runs).select(F.col("run2").alias("run_id"), F.col("k2").alias("k"), F.col("k").alias("to"))
    moved = runs.join(F.broadcast(m), ["run_id", "k"]).select("run_id", "sample_id", F.col("to").alias("k"), "q")
    return moved.unionByName(runs.where(F.col("run_id") == reference).select("run_id", "sample_id", "k", "q"))


def membership_problems(q: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(sample_id, problem) of (sample_id, q array): rows with elements outside 0..1, or not summing to 1."""
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    bad = F.when(~F.forall("q", lambda x: x.isNotNull() & (x >= 0) & (x <= 1)), "range").when(F.abs(total - 1) > tolerance, "sum")
    return q.select("sample_id", bad.alias("problem")).where("problem is not null")


def inverted(mapping: DataFrame) -> DataFrame:
    """(k, target) of a one-to-one mapping, the other way."""
    return mapping.select(F.col("target").alias("k"), F.col("k").alias("target"))


def squared(a: str = "a", b: str = "b") -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def divergence(a: str, b: str) -> Column:
    """Sum over all entries of a * ln(a / mean + 1e-10), for each sample."""
    mean = (F.col(a) + F.col(b)) / 2
    return F.sum(F.col(a) * F.ln(F.col(a) / mean + 1e-10)) / F.count_distinct("sample_id")


def pair_measures(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, Jensen-Shannon divergence, Frobenius distance and normalised cost of paired values."""
    return pairs.groupBy(*keys).agg(
        F.sqrt(F.avg(squared())).alias("rmse"),
        ((divergence("a", "b") + divergence("b", "a")) / 2).alias("jsd"),
        F.sqrt(F.sum(squared())).alias("frobenius"),
        (F.sum(squared()) / (2 * F.count_distinct("sample_id"))).alias("cost"),
    )


def correlations(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over clusters of the correlation between paired columns."""
    return pairs.groupBy(*keys, "k").agg(F.corr("a", "b").alias("r")).groupBy(*keys).agg(F.avg("r").alias("correlation"))


def run_measures(runs: DataFrame) -> DataFrame:
    """(run1, run2, rmse, jsd, frobenius, cost, correlation) of every two runs of equal K, the columns of each two
    matched first, the nearest pairs before others.

    All but the divergence follow from the products of the columns; for that, the samples are gone
    through once more. A row for each two runs, of which there are few.
    """
    samples = align.by_sample(runs).persist()
    c = align.columns_of(runs, samples)
    match = {(i, j): np.array(align.greedy(c.distances(i, j))) for i, j in c.pairs()}
    places = [(c.at[i] + m[:, 0], c.at[j] + m[:, 1]) for (i, j), m in match.items()]
    at, width = c.at, len(c.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places))
        for batch in batches:
            x = align.side_by_side(batch, at, width)
            for n, (i, j) in enumerate(places):
                a, b = x[:, i], x[:, j]
                mean = (a + b) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    total[n] += (a * np.log(a / mean + 1e-10) + b * np.log(b / mean + 1e-10)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["id", "x"])

    apart = align.added(samples.mapInArrow(run, "id int, x binary")).get(0, np.zeros(len(places)))
    samples.unpersist()
    rows = []
    for ((i, j), m), x in zip(match.items(), apart):
        squares = float(c.distances(i, j)[m[:, 0], m[:, 1]].sum() * c.n)
        r = float(c.correlations(i, j)[m[:, 0], m[:, 1]].mean())
        rows.append((i, j, (squares / (c.n * len(m))) ** 0.5, float(x) / 2 / c.n, squares**0.5, squares / (2 * c.n), r))
    kind = dict(runs.dtypes)["run_id"]
    return runs.sparkSession.createDataFrame(rows, f"run1 {kind}, run2 {kind}, rmse double, jsd double, frobenius double, cost double, correlation double")


def stability(runs: DataFrame) -> DataFrame:
    """One row: mean and population deviation over run pairs of correlation and Frobenius distance,
    the columns of each two runs matched first."""
    return run_measures(runs).agg(
        F.avg("correlation").alias("corr_mean"), F.stddev_pop("correlation").alias("corr_std"), F.avg("frobenius").alias("frob_mean"), F.stddev_pop("frobenius").alias("frob_std")
    )


def merged(q: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sample_id, k, q) with the columns of each target summed; mapping is (k, target), a row for each cluster."""
    return q.join(F.broadcast(mapping), "k").groupBy("sample_id", F.col("target").alias("k")).agg(F.sum("q").alias("q"))


def representative(costs: DataFrame) -> DataFrame:
    """One row: the run with the least sum of costs to the others; the first among equals."""
    both = costs.select(F.col("run1").alias("run_id"), "cost").union(costs.select("run2", "cost"))
    return both.groupBy("run_id").agg(F.sum("cost").alias("total")).agg(F.min(F.struct(F.round("total", 12).alias("t"), "run_id", "total")).alias("x")).select("x.run_id", "x.total")


def mode_mean(runs: DataFrame) -> DataFrame:
    """Mean of a mode's runs, whose columns are in one order."""
    return runs.groupBy("sample_id", "k").agg(F.avg("q").alias("q"))


def ranked_communities(members: DataFrame) -> DataFrame:
    """(community, size, first_run, rank) of (run_id, community), largest first, then first seen."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("run_id").alias("first_run"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "first_run")))
