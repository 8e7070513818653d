"""Files of a data set: which exist, and in which compression. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

SUFFIXES = ("", ".gz", ".zst")
FORMATS = ("bed", "vcf", "pgen", "bcf")


class MissingFile(FileNotFoundError):
    """No file of those that were looked for exists."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stem(path: str) -> str:
    for c in SUFFIXES[1:]:
        path = path.removesuffix(c)
    head, _, last = path.rpartition(".")
    return head if last in (*FORMATS, "bim", "fam", "pvar", "psam") else path


def format_of(path: str) -> str:
    """The format by any of the path's suffixes, bed before vcf before pgen before bcf."""
    parts = path.rsplit("/", 1)[-1].split(".")[1:]
    for f in FORMATS:
        if f in parts:
            return f
    raise ValueError(f"no known format in {path}")


def first_of(spark: SparkSession, *bases: str) -> str:
    """The first path of the bases, plain or compressed, that exists."""
    for b in bases:
        for c in SUFFIXES:
            if exists(spark, b + c):
                return b + c
    raise MissingFile(" or ".join(bases))
