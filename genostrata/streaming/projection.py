"""Ancestry of samples as they arrive: with P fixed, each is independent of the others.

A micro-batch's rows are grouped by sample and each sample's row of Q is found by EM steps from the
middle of the simplex until it stands still, so a sample has the same result in any batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import em_sums, normalize
from ..operators.model import observed


def settled(g: np.ndarray, p: np.ndarray, steps: int = 200, tol: float = 1e-7) -> np.ndarray:
    q = np.full((1, p.shape[1]), 1 / p.shape[1])
    for _ in range(steps):
        _, t, n = em_sums(g[:, None], p, q)
        new = normalize(q * t / max(n[0], 1))
        if np.abs(new - q).max() < tol:
            return new[0]
        q = new
    return q[0]


def project_rows(geno: DataFrame, p: DataFrame) -> DataFrame:
    """(sample_id, q) of (sample_id, variant_id, g); p is (variant_id, p). A sample has as many rows as there are variants."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        q = settled(rows["g"].to_numpy(), np.array(rows["p"].tolist()))
        return pd.DataFrame({"sample_id": [rows["sample_id"].iloc[0]], "q": [q.tolist()]})

    joined = geno.where(observed()).join(p, "variant_id").select(F.col("sample_id").cast("long").alias("sample_id"), "g", "p")
    return joined.groupBy("sample_id").applyInPandas(one, "sample_id long, q array<double>")


def project_stream(arriving: DataFrame, p: DataFrame, path: str, checkpoint: str):
    """A running query that writes Q of each micro-batch of whole samples as Parquet."""

    def batch(rows: DataFrame, number: int) -> None:
        project_rows(rows, p).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
