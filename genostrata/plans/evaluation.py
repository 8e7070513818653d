"""Evaluation of fits from files: genotypes in any of the formats with text matrices of P and Q."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import numbered
from ..sources import genotypes, sidecars
from .grid import packed_grid
from .grid_fit import likelihood_of


def dense_rows(packed: DataFrame) -> DataFrame:
    """Packed rows with their places among those that were kept as variant_id."""
    return numbered(packed, ["variant_id"], "_at").drop("variant_id").withColumnRenamed("_at", "variant_id")


def log_likelihood(spark: SparkSession, genotype_path: str, p_path: str, q_path: str, mode: str = "autosomes", autosomes: int = 22, chromosomes: str | list[str] | None = None, flip: bool = True) -> DataFrame:
    """(k, loglik), one row: the likelihood of the matrices for the genotypes of the chosen chromosomes. Matrices of
    other numbers of rows or columns are errors."""
    _, packed, _ = genotypes.read_packed(spark, genotype_path, mode, autosomes, chromosomes, flip)
    rows = dense_rows(packed)
    m, n = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    p, q = sidecars.p_matrix(spark, p_path), sidecars.q_matrix(spark, q_path)
    value = likelihood_of(packed_grid(rows, m, n), p, q)
    return spark.createDataFrame([(q.agg(F.max(F.size("q"))).first()[0], value)], "k int, loglik double")
