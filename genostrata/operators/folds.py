"""Cross-validation folds by a hash of a genotype's flat place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.expr import MISSING, observed
from .layout import numbered

# The increment and the two multipliers of the mixing function.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def fold_of(flat: Column, folds: int, seed: int) -> Column:
    """The fold of each flat index: unsigned arithmetic, which SQL has not, in Arrow batches."""

    @pandas_udf("int")
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            with np.errstate(over="ignore"):
                h = mixed(x.to_numpy(np.int64).view(np.uint64) + np.uint64(seed) + np.uint64(STEP))
            yield pd.Series((h % np.uint64(folds)).astype(np.int32))

    return fold(flat)


def hash_of(flat: Column, seed: int) -> Column:
    """The mixing function's value for each flat index, its bits as a signed number, halves swapped so
    that signed order is that of the unsigned values."""

    @pandas_udf("long")
    def value(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            with np.errstate(over="ignore"):
                h = mixed(x.to_numpy(np.int64).view(np.uint64) + np.uint64(seed) + np.uint64(STEP))
            yield pd.Series((h ^ np.uint64(1 << 63)).view(np.int64))

    return value(flat)


def shuffled_folds(geno: DataFrame, n_samples: int, folds: int = 5, seed: int = 42) -> DataFrame:
    """Observed genotypes with folds of equal size: they are shuffled by a keyed hash and dealt in turn."""
    flat = F.col("variant_id").cast("long") * n_samples + F.col("sample_id").cast("long")
    rows = geno.where(observed()).withColumn("_flat", flat).withColumn("_hash", hash_of(F.col("_flat"), seed))
    return numbered(rows, ["_hash", "_flat"], "_at").withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_flat", "_hash", "_at")


def with_folds(geno: DataFrame, n_samples: int, folds: int = 5, seed: int = 42) -> DataFrame:
    """Observed genotypes with their fold."""
    flat = F.col("variant_id").cast("long") * n_samples + F.col("sample_id").cast("long")
    return geno.where(observed()).withColumn("fold", fold_of(flat, folds, seed))


def masked(folded: DataFrame, fold: int) -> DataFrame:
    """Genotypes with those of one fold missing."""
    return folded.withColumn("g", F.when(F.col("fold") == fold, MISSING).otherwise(F.col("g")))
