"""Text files beside genotypes: variants, samples, labels, filemaps and matrices.

A file is read by as many tasks as it has parts, and its lines are numbered in its order.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clip_array, normalized
from . import paths, records


#: Bytes of a file in blocks that a task reads.
BGZF_RANGE = 1 << 24


def lines(spark: SparkSession, path: str, comments: str | None = None) -> DataFrame:
    """(idx, value): lines that aren't blank, numbered in the order of the file, or of a folder's files
    by name and then by line.

    Lines are counted within each piece of a file that a task reads, and the counts of the pieces
    before, one row for each, are added in one running sum.
    """
    rows = bgzf_rows(spark, path) if path.endswith((".gz", ".bgz")) else None
    if rows is None:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows.where(F.trim("value") != "")
    if comments:
        rows = rows.where(~F.col("value").startswith(comments))
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    pieces = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_least"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_file", "_start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    return placed.join(offsets, ["_file", "_start"]).select((F.col("_id") + F.col("_shift")).alias("idx"), "value")


def bgzf_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """(value, _file, _start) of files in BGZF blocks, each read by as many tasks as it has ranges of BGZF_RANGE
    bytes; none if a file has no such blocks."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(blocks=[records.is_bgzf(x) for x in p["path"]])

    files = spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(look, "path string, length long, blocks boolean").persist()
    whole, n = files.agg(F.every("blocks"), F.sum(F.ceil(F.col("length") / BGZF_RANGE))).first()
    if not whole:
        files.unpersist()
        return None

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, length, first in zip(p["path"], p["length"], p["first"]):
                with records.opened(name) as f:
                    for found in records.bgzf_lines(f, int(first), int(first) + BGZF_RANGE, int(length)):
                        yield pd.DataFrame({"value": [x.decode(errors="replace") for x in found], "_file": name, "_start": first})

    ranges = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BGZF_RANGE)))).repartition(int(min(max(n, 1), 100_000)), "path", "first")
    return ranges.mapInPandas(read, "value string, _file string, _start long")


def fields() -> Column:
    return F.split(F.trim("value"), r"\s+")


def bim(spark: SparkSession, path: str) -> DataFrame:
    f = fields()
    return lines(spark, path).select(
        F.col("idx").alias("variant_id"), f[0].alias("chrom"), f[1].alias("id"), f[2].try_cast("double").alias("cm"), f[3].try_cast("long").alias("pos"), f[4].alias("a1"), f[5].alias("a2")
    )


def pvar(spark: SparkSession, path: str) -> DataFrame:
    f = fields()
    return lines(spark, path, "#").select(
        F.col("idx").alias("variant_id"), f[0].alias("chrom"), f[2].alias("id"), F.lit(None).cast("double").alias("cm"), f[1].try_cast("long").alias("pos"), f[4].alias("a1"), f[3].alias("a2")
    )


def fam(spark: SparkSession, path: str) -> DataFrame:
    f = fields()
    return lines(spark, path).select(F.col("idx").alias("sample_id"), f[0].alias("fid"), f[1].alias("iid"), F.get(f, F.lit(4)).alias("sex"), F.get(f, F.lit(5)).alias("pheno"))


def psam(spark: SparkSession, path: str) -> DataFrame:
    f = fields()
    return lines(spark, path, "#").select(F.col("idx").alias("sample_id"), f[0].alias("iid"), F.get(f, F.lit(1)).alias("sex"))


def labels(spark: SparkSession, path: str) -> DataFrame | None:
    """(sample_id, label), or None if there is no such file."""
    if not paths.exists(spark, path):
        return None
    return lines(spark, path).select(F.col("idx").alias("sample_id"), F.trim("value").alias("label"))


def matrix(spark: SparkSession, path: str, name: str = "q") -> DataFrame:
    """(idx, array) of a text matrix with white space or commas between its numbers."""
    numbers = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.cast("double"))
    return lines(spark, path, "#").select("idx", numbers.alias(name))


def array_file(spark: SparkSession, path: str, name: str = "q") -> DataFrame:
    """(idx, array) of a matrix in numpy's format, which one task reads."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for raw in p["content"]:
                x = np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False).astype(float))
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pd.DataFrame({"idx": np.arange(at, at + len(part)), name: list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"idx long, {name} array<double>")


def upright(rows: DataFrame, name: str = "q") -> DataFrame:
    """(idx, array) with no fewer rows than columns: a matrix wider than high is turned. Rows of unlike
    lengths are an error."""
    shape = rows.agg(F.count(F.lit(1)), F.min(F.size(name)), F.max(F.size(name))).first()
    if shape[0] and shape[1] != shape[2]:
        raise records.BadFile(f"rows of {shape[1]} to {shape[2]} numbers")
    if not shape[0] or shape[2] <= shape[0]:
        return rows
    cells = rows.select("idx", F.posexplode(name).alias("at", "x"))  # as few rows as there are columns at last
    turned = cells.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("xs"))
    return turned.select(F.col("at").cast("long").alias("idx"), F.transform("xs", lambda c: c["x"]).alias(name))


def p_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, p), clipped; a single column is one population."""
    return matrix(spark, path, "p").select(F.col("idx").alias("variant_id"), clip_array("p").alias("p"))


def q_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, q) upright, clipped and made to sum to 1, as estimates are compared with a truth."""
    return upright(matrix(spark, path)).select(F.col("idx").alias("sample_id"), normalized("q").alias("q"))


def q_proportions(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, q) upright and divided by its sums, rows of zeros left alone, as runs are compared;
    text or numpy's format."""
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    rows = upright(array_file(spark, path) if path.endswith(".npy") else matrix(spark, path))
    return rows.select(F.col("idx").alias("sample_id"), F.when(total == 0, F.col("q")).otherwise(F.transform("q", lambda x: x / total)).alias("q"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, k_total, sample_id, k, q) of the runs of a filemap, each checked for its K. The list has
    a line for each run."""
    out = None
    for r in filemap(spark, path).orderBy("idx").collect():
        if not paths.exists(spark, r["path"]):
            raise paths.MissingFile(r["path"])
        q = q_proportions(spark, r["path"])
        right = F.when(F.size("q") == r["k"], F.col("q")).otherwise(F.raise_error(F.concat(F.lit(f"{r['run_id']} should have {r['k']} columns and has "), F.size("q").cast("string"))))
        one = q.select(F.lit(r["run_id"]).alias("run_id"), F.lit(r["k"]).alias("k_total"), "sample_id", F.posexplode(right).alias("k", "q"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise records.BadFile(f"{path} lists no runs")
    return out


def side_by_side(a: DataFrame, b: DataFrame, key: str, what: str) -> DataFrame:
    """The inner join of two tables that have to hold the same keys, or an error with both counts."""
    n, m = a.select(key).distinct().count(), b.select(key).distinct().count()
    both = a.select(key).distinct().join(b.select(key).distinct(), key).count()
    if not n == m == both:
        raise records.BadFile(f"{what}: {n} against {m}, {both} in both")
    return a.join(b, key)


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and values of a list of settings, a `name: value` on each line, # before remarks."""
    rows = lines(spark, path, "#").select("idx", F.split(F.regexp_replace("value", r"\s+#.*$", ""), ":", 2).alias("x")).orderBy("idx").collect()  # a line for each setting
    return {r["x"][0].strip().replace("-", "_"): r["x"][1].strip().strip("'\"") for r in rows if len(r["x"]) == 2}


def filemap(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, k, path) of a tab-separated list of runs; paths are relative to the list."""
    f = F.split("value", "\t")
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = lines(spark, path, "#").select("idx", F.trim(f[0]).alias("run_id"), F.trim(F.get(f, F.lit(1))).try_cast("int").alias("k"), F.trim(F.get(f, F.lit(2))).alias("file"))
    good = F.col("run_id").rlike("[A-Za-z]") & ~F.col("run_id").rlike("[#.]") & F.col("k").isNotNull() & F.col("file").isNotNull()
    place = F.when(F.col("file").startswith("/") | F.col("file").contains("://"), F.col("file")).otherwise(F.concat(F.lit(base + "/"), "file"))
    return rows.select("idx", F.when(good, F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("bad filemap line: "), F.coalesce("run_id", F.lit(""))))).alias("run_id"), "k", place.alias("path"))
