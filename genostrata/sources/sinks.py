"""Text output of P and Q: a row of numbers for each variant or sample, in order.

Rows are sorted by range and written part by part; parts in the order of their names are the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(rows: DataFrame, path: str, key: str, value: str, digits: int = 6, scientific: bool = False) -> None:
    form = f"%.{digits}{'e' if scientific else 'f'}"
    text = F.array_join(F.transform(value, lambda x: F.format_string(form, x)), " ")
    rows.orderBy(key).select(text.alias("value")).write.mode("overwrite").text(path)


#: Digits with which measures are reported.
DIGITS = {"rmse": 7, "jsd": 7, "loglik": 1, "correlation": 6, "frobenius": 6, "corr_mean": 6, "corr_std": 6, "frob_mean": 6, "frob_std": 6, "cv_index": 4}


def report(measures: DataFrame) -> DataFrame:
    """measures with each known one as text of its digits."""
    return measures.select(*(F.format_string(f"%.{DIGITS[c]}f", c).alias(c) if c in DIGITS else c for c in measures.columns))


def write_fit(q: DataFrame, p: DataFrame, folder: str, name: str, k: int) -> None:
    """`name`.k.Q and `name`.k.P with all digits."""
    write_matrix(q, f"{folder}/{name}.{k}.Q", "sample_id", "q", 18, scientific=True)
    write_matrix(p, f"{folder}/{name}.{k}.P", "variant_id", "p", 18, scientific=True)


def write_cv(rows: DataFrame, path: str) -> None:
    """A line for each K of (k, cv_index), K ascending."""
    line = F.format_string(f"K=%d: CV index = %.{DIGITS['cv_index']}f", "k", "cv_index")
    rows.orderBy("k").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
