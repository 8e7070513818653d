"""Counts, frequencies and packing of genotypes in long form (sample_id, variant_id, g)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, centered, clip, flipped, observed


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def sum_observed() -> Column:
    return F.sum(F.when(observed(), F.col("g")).otherwise(0))


def n_observed() -> Column:
    return F.count_if(observed())


def allele_frequency(geno: DataFrame) -> DataFrame:
    """(variant_id, f, n_called, n_missing); f is 0 if nothing was called."""
    return geno.groupBy("variant_id").agg(
        ratio(sum_observed(), 2 * n_observed()).alias("f"), n_observed().alias("n_called"), F.count_if(~observed()).alias("n_missing")
    )


def global_mean(geno: DataFrame) -> DataFrame:
    """One row: the mean allele count over the whole matrix and whether its alleles have to be swapped."""
    mean = geno.agg(ratio(sum_observed(), 2 * n_observed()).alias("mean"))
    return mean.withColumn("flip", F.col("mean") >= 0.5)


def flip_alleles(geno: DataFrame) -> DataFrame:
    """geno counted by the rarer allele overall. The broadcast side is one row."""
    return geno.crossJoin(F.broadcast(global_mean(geno))).withColumn("g", flipped(F.col("g"), F.col("flip"))).drop("mean", "flip")


def sample_calls(geno: DataFrame) -> DataFrame:
    return geno.groupBy("sample_id").agg((2 * n_observed()).alias("n_alleles"), F.count_if(~observed()).alias("n_missing"))


def pack(geno: DataFrame) -> DataFrame:
    """(sample_id, block, byte): four genotypes of a sample in a byte, the first in the lowest bits."""
    v = F.col("variant_id").cast("long")
    return geno.groupBy("sample_id", F.floor(v / 4).alias("block")).agg(F.sum((F.pow(F.lit(4.0), v % 4) * F.col("g")).cast("int")).cast("int").alias("byte"))


def unpack(packed: DataFrame) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    rows = packed.select("sample_id", "block", "byte", i)
    bits = F.pmod(F.floor(F.col("byte") / F.pow(F.lit(4.0), F.col("i"))), F.lit(4)).cast("int")
    return rows.select("sample_id", (F.col("block") * 4 + F.col("i")).alias("variant_id"), bits.alias("g"))


def centered_moments(geno: DataFrame, freq: DataFrame) -> DataFrame:
    """(variant_id, mean, sum_squares) of the centred genotypes, missing ones at 0."""
    x = geno.join(freq.select("variant_id", "f"), "variant_id").withColumn("x", centered(F.col("g"), F.col("f")))
    return x.groupBy("variant_id").agg(F.avg("x").alias("mean"), F.sum(F.col("x") * F.col("x")).alias("sum_squares"))


def centred_products(sums: DataFrame, freq: DataFrame) -> DataFrame:
    """(i, j, xx): products of the centred rows of every two variants, i <= j, from whole numbers summed over the
    samples called at both: their count n, both allele counts ga and gb and their product gg."""
    f = freq.select("variant_id", "f")
    both = sums.join(f.select(F.col("variant_id").alias("i"), F.col("f").alias("fi")), "i").join(f.select(F.col("variant_id").alias("j"), F.col("f").alias("fj")), "j")
    return both.select("i", "j", (F.col("gg") - 2 * F.col("fj") * F.col("ga") - 2 * F.col("fi") * F.col("gb") + 4 * F.col("fi") * F.col("fj") * F.col("n")).alias("xx"))


def population_frequency(geno: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(variant_id, p): clipped frequencies by population 0..k-1; 0.5 where none was called.

    One aggregation by variant with a column for each population.
    """
    of = [ratio(F.sum(F.when(observed() & (F.col(label) == i), F.col("g"))), 2 * F.count_if(observed() & (F.col(label) == i)), 0.5) for i in range(k)]
    return geno.groupBy("variant_id").agg(F.array(*(clip(x) for x in of)).alias("p"))


def supervised_start(samples: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(sample_id, q): labelled samples at their population, others even."""
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.col(label).isNull(), F.lit(1.0 / k)).when(i == F.col(label), F.lit(1 - EPS)).otherwise(F.lit(EPS / (k - 1))))
    return samples.select("sample_id", own.alias("q"))


def numbered_labels(samples: DataFrame, label: str = "label1", unlabelled: str = "-") -> DataFrame:
    """(label, first_sample, y): labels numbered from 1 by first appearance, without the unlabelled."""
    first = samples.where(F.col(label) != unlabelled).groupBy(F.col(label).alias("label")).agg(F.min("sample_id").alias("first_sample"))
    return first.withColumn("y", F.row_number().over(Window.orderBy("first_sample")))
