"""Genotype files as packed rows (variant_id, n, bits) or in long form (variant_id, sample_id, g).

Text formats are read by lines with column expressions. Of binary files a plan is made, a row for
each range of records with its place among all variants; tasks read their ranges alone. If variants are
chosen, ranges without any are not planned, and within the others tasks read and decode the chosen
records only. A folder or pattern of files is one data set, in the order of the names. BCF files, plain or in
BGZF blocks, are gone through once for the places of their records, by a task each, and then decoded by
many; VCF files in such blocks are read by ranges. A BED or BCF file compressed otherwise is one task's, which
goes through it piece by piece; a compressed PGEN file is decompressed in a task's memory.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.expr import MISSING, gt_genotype, in_chromosomes, is_autosome
from . import paths, records, sidecars
from .records import BadFile

#: Variants of a range at most (a part of a PGEN index's block), its bytes, and genotypes of a batch.
VARIANT_RANGE, RANGE_BYTES, BATCH = 1024, 1 << 24, 1 << 20
#: Ranges are dealt to no more tasks than this.
MOST_TASKS = 100_000
PACKED = "variant_id long, n int, bits binary"
LONG = "variant_id long, sample_id int, g int"


def chosen(variants: DataFrame, mode: str = "autosomes", autosomes: int = 22, chromosomes: str | list[str] | None = None) -> DataFrame:
    """Variants of the chosen chromosomes; an empty choice is an error."""
    if mode == "all":
        return variants
    return variants.where(in_chromosomes("chrom", chromosomes) if chromosomes else is_autosome("chrom", autosomes))


def packed_rows(first: int, bits: bytes, n: int) -> pd.DataFrame:
    width = max(1, (n + 3) // 4)
    rows = [bits[at : at + width] for at in range(0, len(bits), width)]
    return pd.DataFrame({"variant_id": np.arange(first, first + len(rows)), "n": n, "bits": rows})


def long_rows(packed: DataFrame) -> DataFrame:
    """The long form of packed rows, in frames of a bounded number of genotypes."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = 0
            while at < len(p):
                n = int(p["n"].iloc[at])
                part = p.iloc[at : at + max(1, BATCH // max(n, 1))]
                part = part[part["n"] == n]
                g = records.unpacked(b"".join(part["bits"]), n)
                yield pd.DataFrame({"variant_id": np.repeat(part["variant_id"].to_numpy(), n), "sample_id": np.tile(np.arange(n, dtype=np.int32), len(part)), "g": g.ravel().astype(np.int32)})
                at += len(part)

    return packed.mapInPandas(spread, LONG)


def packed_mean(packed: DataFrame) -> float:
    """The mean allele count over all genotypes, counted by byte."""
    four = (np.arange(256)[:, None] >> records.SHIFTS) & 3
    alleles, seen = np.where(four == MISSING, 0, four).sum(1), (four != MISSING).sum(1)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            bytes_of = [np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in p["bits"]]
            yield pd.DataFrame({"a": [int((x * alleles).sum()) for x in bytes_of], "c": [int((x * seen).sum()) for x in bytes_of]})

    got = packed.mapInPandas(count, "a long, c long").agg(F.sum("a"), F.sum("c")).first()
    return got[0] / (2 * got[1]) if got[1] else 0.0


def flip_packed(packed: DataFrame) -> DataFrame:
    """Packed rows counted by the rarer allele overall."""
    if packed_mean(packed) < 0.5:
        return packed

    def swap(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(bits=[records.recoded(b, (2, 1, 0, MISSING), n) for b, n in zip(p["bits"], p["n"])])

    return packed.mapInPandas(swap, PACKED)


# ---- plans of ranges ----


def files_of(spark: SparkSession, path: str, look: Callable[[str, int], tuple[int, int, bool]]) -> DataFrame:
    """(path, m, n, whole, offset) of the files: look gives variants, samples and whether the file is
    read whole; offset is the number of variants in the files before. A row for each file."""

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, length in zip(p["path"], p["length"]):
                m, n, whole = look(name, int(length))
                yield pd.DataFrame({"path": [name], "m": [m], "n": [n], "whole": [whole]})

    rows = spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(heads, "path string, m long, n int, whole boolean")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return rows.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))


def ranges(files: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(path, n, whole, first, count, offset, records), dealt so that each is a task's or few are. A range has a
    power of two of variants, so it never crosses a block of an index.

    kept: variant_id of the variants to be read. Ranges that have none of them go, and records lists theirs
    by their place in the file, at most VARIANT_RANGE; of a file that is read whole all are read.
    """
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(float(RANGE_BYTES)) / F.greatest(F.ceil(F.col("n") / 4), F.lit(1))))))
    step = F.when(F.col("whole"), F.col("m")).otherwise(F.least(F.lit(VARIANT_RANGE), most).cast("long"))
    cut = files.where("m > 0").withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.col("step"))))
    parts = cut.select("path", "n", "whole", "first", F.least("step", F.col("m") - F.col("first")).alias("count"), "offset")
    if kept is None:
        tasks = files.where("m > 0").agg(F.sum(F.ceil(F.col("m") / step))).first()[0] or 1
        return parts.withColumn("records", F.lit(None).cast("array<long>")).repartition(int(min(tasks, MOST_TASKS)), "path", "first")
    low, columns = F.col("offset") + F.col("first"), ["path", "n", "whole", "first", "count", "offset"]
    near = parts.where("NOT whole").withColumn("near", F.explode(F.sequence(F.floor(low / VARIANT_RANGE), F.floor((low + F.col("count") - 1) / VARIANT_RANGE))))
    wanted = kept.select(F.col("variant_id").cast("long").alias("v"), F.floor(F.col("variant_id") / VARIANT_RANGE).alias("near"))
    some = near.join(wanted, "near").where((F.col("v") >= low) & (F.col("v") < low + F.col("count")))
    some = some.groupBy(*columns).agg(F.sort_array(F.collect_list(F.col("v") - F.col("offset"))).alias("records")).persist()
    tasks = some.count() + files.where("whole AND m > 0").count()
    return some.unionByName(parts.where("whole").withColumn("records", F.lit(None).cast("array<long>"))).repartition(int(max(1, min(tasks, MOST_TASKS))), "path", "first")


def stretches(first: int, count: int, wanted: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """(first, count) of the records to be read one after the other: all of a range, or the runs of those wanted."""
    if wanted is None:
        yield int(first), int(count)
        return
    for run in np.split(np.asarray(wanted), np.flatnonzero(np.diff(wanted) > 1) + 1):
        yield int(run[0]), len(run)


def bed_packed(spark: SparkSession, path: str, n_samples: int, n_variants: int, kept: DataFrame | None = None) -> DataFrame:
    """Packed rows of BED files that hold n_variants together, or of those that are kept."""
    stride = (n_samples + 3) // 4

    def look(name: str, length: int) -> tuple[int, int, bool]:
        whole = records.is_compressed(name)
        with records.stream(name) as f:
            if records.exactly(f, 3) != records.BED_START:
                raise BadFile(f"{name} isn't a BED file by variant")
            size = records.rest_of(f) if whole else length - 3
        if stride == 0 or size % stride:
            raise BadFile(f"{size} bytes of records of {name} aren't rows of {n_samples} samples")
        return size // stride, n_samples, whole

    files = files_of(spark, path, look).persist()
    found = files.agg(F.sum("m")).first()[0] or 0
    if found != n_variants:
        raise BadFile(f"{found} records of {n_samples} samples for {n_variants} variants")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, slab = tuple(records.BED_CODES.tolist()), max(1, RANGE_BYTES // stride)
        for p in parts:
            for name, whole, first, count, offset, wanted in zip(p["path"], p["whole"], p["first"], p["count"], p["offset"], p["records"]):
                with records.stream(name) if whole else records.opened(name) as f:
                    if whole:
                        records.exactly(f, 3)
                    for begin, n in stretches(first, count, wanted):
                        if not whole:
                            f.seek(3 + begin * stride)
                        for at in range(begin, begin + n, slab):
                            raw = records.exactly(f, min(slab, begin + n - at) * stride)
                            yield packed_rows(int(offset) + at, records.recoded(raw, codes, n_samples), n_samples)

    return of_kept(ranges(files, kept).mapInPandas(decode, PACKED), files, kept)


def of_kept(rows: DataFrame, files: DataFrame, kept: DataFrame | None) -> DataFrame:
    """rows of the kept variants alone; those of files that were read whole still have others."""
    if kept is None or not files.where("whole").limit(1).count():
        return rows
    return rows.join(kept.select("variant_id"), "variant_id", "left_semi")


def pgen_packed(spark: SparkSession, path: str, kept: DataFrame | None = None) -> DataFrame:
    """Packed rows of PGEN files with hard calls of fixed or variable width, all or those that are kept."""

    def look(name: str, _: int) -> tuple[int, int, bool]:
        whole = records.is_compressed(name)
        with records.stream(name) as f:
            m, n, _, _ = records.pgen_head(io.BytesIO(records.exactly(f, 12)))
        return m, n, whole

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, n, whole, first, count, offset, wanted in zip(p["path"], p["n"], p["whole"], p["first"], p["count"], p["offset"], p["records"]):
                with io.BytesIO(records.stream(name).read()) if whole else records.opened(name) as f:
                    for begin, length in stretches(first, count, wanted):
                        for at in range(begin, begin + length, VARIANT_RANGE):
                            g = records.pgen_rows(f, at, min(VARIANT_RANGE, begin + length - at))
                            yield packed_rows(int(offset) + at, records.packed(g), int(n))

    files = files_of(spark, path, look).persist()
    return of_kept(ranges(files, kept).mapInPandas(decode, PACKED), files, kept)


def bcf_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, first, count, place, skip, whole, offset) of the runs of records of BCF files, plain or in BGZF blocks,
    each found by going through its file once without decoding; a file compressed otherwise is one run."""

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, length in zip(p["path"], p["length"]):
                blocks, whole = records.is_bgzf(name), records.is_compressed(name)
                with records.stream(name) if whole and not blocks else records.opened(name) as f:
                    r = records.BlockReader(f, 0, int(length)) if blocks else f
                    records.bcf_header(r)
                    if whole and not blocks:
                        marks = [(0, sum(1 for _ in records.bcf_parts(r)), 0, 0)]
                    else:
                        marks = records.bcf_marks(r, VARIANT_RANGE, RANGE_BYTES)
                    for first, count, place, skip in marks:
                        yield pd.DataFrame({"path": [name], "length": length, "first": [first], "count": [count], "place": [place], "skip": [skip], "kind": ["whole" if whole and not blocks else "blocks" if blocks else "plain"]})

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    pieces = durable(files.mapInPandas(plan, "path string, length long, first long, count long, place long, skip long, kind string"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = pieces.groupBy("path").agg(F.sum("count").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    return pieces.join(offsets, "path")


def bcf_packed(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, chrom, pos, id, n, bits), runs of records in tasks; variants are counted on over the files."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, length, kind, place, skip, first, count, offset in zip(*(p[c] for c in ("path", "length", "kind", "place", "skip", "first", "count", "offset"))):
                rows = []
                with records.stream(name) if kind == "whole" else records.opened(name) as f:
                    r = records.BlockReader(f, 0, int(length)) if kind == "blocks" else f
                    header = records.bcf_header(r)
                    if kind == "blocks":
                        r = records.BlockReader(f, int(place), int(length))
                        records.exactly(r, int(skip))
                    elif kind == "plain":
                        f.seek(int(place))
                    for i, (chrom, pos, label, g) in enumerate(islice(records.bcf_records(r, header), int(count))):
                        rows.append((int(offset + first) + i, chrom, pos, label, len(g), records.packed(g[None])))
                        if len(rows) * len(g) >= BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["variant_id", "chrom", "pos", "id", "n", "bits"]
    pieces = bcf_pieces(spark, path)
    dealt = pieces.repartition(int(max(1, min(pieces.count(), MOST_TASKS))), "path", "first")
    return dealt.mapInPandas(decode, "variant_id long, chrom string, pos long, id string, n int, bits binary")


# ---- the formats ----


def read_bed(spark: SparkSession, path: str, n_samples: int, n_variants: int) -> DataFrame:
    return long_rows(bed_packed(spark, path, n_samples, n_variants))


def read_pgen(spark: SparkSession, path: str) -> DataFrame:
    return long_rows(pgen_packed(spark, path))


def read_bcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, genotypes)."""
    rows = bcf_packed(spark, path)
    return bcf_variants(rows), long_rows(rows.select("variant_id", "n", "bits"))


def bcf_variants(rows: DataFrame) -> DataFrame:
    return rows.select("variant_id", "chrom", "id", F.lit(None).cast("double").alias("cm"), "pos")


def vcf_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(variants, (variant_id, calls), samples). Lines are split, the nine fixed fields set apart and the
    samples' calls parsed by expressions; a short line lacks calls, which then are missing."""
    rows = sidecars.lines(spark, path, "#").select(F.col("idx").alias("variant_id"), F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"))
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.size(F.split("value", "\t")).alias("n")).first()
    if header is None:
        raise BadFile(f"{path} has no header line")
    n = header["n"] - 9
    if n < 1:
        raise BadFile(f"{path} has no samples")
    variants = rows.select("variant_id", F.col("f")[0].alias("chrom"), F.col("f")[2].alias("id"), F.lit(None).cast("double").alias("cm"), F.col("f")[1].try_cast("long").alias("pos"), F.col("f")[4].alias("a1"), F.col("f")[3].alias("a2"))
    calls = F.transform(F.sequence(F.lit(9), F.lit(8 + n)), lambda i: gt_genotype(F.coalesce(F.get("f", i), F.lit("."))))
    return variants, rows.select("variant_id", calls.alias("calls")), n


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants, genotypes)."""
    variants, calls, _ = vcf_calls(spark, path)
    return variants, calls.select("variant_id", F.posexplode("calls").alias("sample_id", "g"))


def packed_calls(calls: DataFrame, n: int) -> DataFrame:
    """Packed rows of arrays of calls: four make two digits of a hexadecimal number."""

    def at(i: Column) -> Column:
        return F.coalesce(F.get("calls", i), F.lit(MISSING))

    four = F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(4)), lambda i: F.lpad(F.hex(at(i) + 4 * at(i + 1) + 16 * at(i + 2) + 64 * at(i + 3)), 2, "0"))
    return calls.select("variant_id", F.lit(n).alias("n"), F.unhex(F.array_join(four, "")).alias("bits"))


def read_packed(spark: SparkSession, path: str, mode: str = "autosomes", autosomes: int = 22, chromosomes: str | list[str] | None = None, flip: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(variants, packed rows, samples) of a data set in any of the formats, its chromosomes chosen and
    its alleles counted by the rarer overall. Nothing left to read is an error."""
    kind, base = paths.format_of(path), paths.stem(path)
    file = path if paths.exists(spark, path) else paths.first_of(spark, f"{base}.{kind}")
    samples = wanted = None
    if kind == "vcf":
        variants, calls, n = vcf_calls(spark, file)
        rows = packed_calls(calls, n)
    elif kind == "bcf":
        all_rows = bcf_packed(spark, file)
        variants, rows = bcf_variants(all_rows), all_rows.select("variant_id", "n", "bits")
    else:
        side = paths.first_of(spark, f"{base}.pvar", f"{base}.bim") if kind == "pgen" else paths.first_of(spark, f"{base}.bim")
        variants = sidecars.pvar(spark, side) if ".pvar" in side else sidecars.bim(spark, side)
        wanted = chosen(variants, mode, autosomes, chromosomes).select("variant_id") if mode != "all" else None
        if kind == "bed":
            samples = sidecars.fam(spark, paths.first_of(spark, f"{base}.fam"))
            n = samples.count()
            if n == 0:
                raise BadFile("no samples")
            rows = bed_packed(spark, file, n, variants.count(), wanted)
        else:
            samples = sidecars.psam(spark, paths.first_of(spark, f"{base}.psam"))
            rows = pgen_packed(spark, file, wanted)
    kept = chosen(variants, mode, autosomes, chromosomes)
    if kept.limit(1).count() == 0:
        raise BadFile("no variant is left")
    if mode != "all" and wanted is None:
        rows = rows.join(kept.select("variant_id"), "variant_id", "left_semi")
    return kept, flip_packed(rows) if flip else rows, samples


def read(spark: SparkSession, path: str, mode: str = "autosomes", autosomes: int = 22, chromosomes: str | list[str] | None = None, flip: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """As read_packed, with genotypes in long form."""
    variants, rows, samples = read_packed(spark, path, mode, autosomes, chromosomes, flip)
    return variants, long_rows(rows), samples


__all__ = ["BadFile", "chosen", "long_rows", "read", "read_bcf", "read_bed", "read_packed", "read_pgen", "read_vcf"]
