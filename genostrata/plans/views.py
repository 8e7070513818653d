"""Genotype views over the star-schema tables, so that every operator runs on data of any scale.

dense: sample = vec_id, population = label, variant = place in the vector, genotype from the value.
sparse: sample = l_suppkey, variant = l_partkey, genotype = sum(l_linenumber) mod 3; absent = missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import MISSING

#: Populations of the dense view.
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recoded(x: Column) -> Column:
    """Genotype of a real value: missing, 0, 1 or 2 by range."""
    return F.when(x < -0.2, MISSING).when(x < 0.05, 0).when(x < 0.15, 1).otherwise(2)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("variant_id", "x"))
    return e.select("sample_id", "label", "variant_id", recoded(F.col("x").cast("double")).alias("g"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("variant_id"))
        .agg((F.sum("l_linenumber") % 3).cast("int").alias("g"))
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant_id and a chromosome label in one of several spellings."""
    digits = F.regexp_extract("p_brand", r"[0-9]+", 0)
    key = F.col("p_partkey")
    chrom = F.when(key % 17 == 0, F.lit("chrX")).when(key % 3 == 0, F.concat(F.lit("chr"), digits)).when(key % 3 == 1, F.concat(F.lit("CHR"), digits)).otherwise(digits)
    return table(spark, sf_dir, "part").select(key.alias("variant_id"), chrom.alias("chrom"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id with two levels of labels: nation and region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("label1"), F.col("r_name").alias("label2"))
    s = table(spark, sf_dir, "supplier")
    return s.join(F.broadcast(places), s.s_nationkey == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample_id"), "label1", "label2")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")


def q_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, q): 0.91 for the own population, 0.01 for each other."""
    own = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.when(k == F.col("label"), F.lit(0.91)).otherwise(F.lit(0.01)))
    return labelled(spark, sf_dir).select("sample_id", own.alias("q"))


def q_est(spark: SparkSession, sf_dir: str, run: int = 0, rotate: int = 0) -> DataFrame:
    """q_true with a small perturbation by rule, its columns rotated."""
    noise = lambda k: F.pmod(F.col("sample_id") * (7 + run) + k.cast("long") * 3, F.lit(11)) / F.lit(220.0)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(K - 1)),
        lambda k: F.when(F.pmod(k + rotate, F.lit(K)) == F.col("label"), F.lit(0.91)).otherwise(F.lit(0.01)) + noise(F.pmod(k + rotate, F.lit(K))),
    )
    q = labelled(spark, sf_dir).select("sample_id", raw.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return q.select("sample_id", F.transform("w", lambda x: x / total).alias("q"))


def runs(spark: SparkSession, sf_dir: str, count: int = 4) -> DataFrame:
    """(run_id, sample_id, q): perturbed runs with rotated columns."""
    out = None
    for r in range(count):
        one = q_est(spark, sf_dir, r, r).select(F.lit(r).alias("run_id"), "sample_id", "q")
        out = one if out is None else out.unionByName(one)
    return out


def long_form(arrays: DataFrame, value: str = "q", index: str = "k") -> DataFrame:
    """A row for each element of the array column `value`."""
    keys = [c for c in arrays.columns if c != value]
    return arrays.select(*keys, F.posexplode(value).alias(index, value))
