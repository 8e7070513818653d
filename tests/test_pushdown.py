"""Chromosomes are chosen before genotypes are read: other records are neither planned nor decoded."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_reference import bed_bytes, matrix, pgen_bytes

from genostrata.sources import genotypes, records

M, N = 3000, 9


@pytest.fixture(scope="module")
def g():
    return np.random.default_rng(2).integers(0, 4, (M, N))


def chrom(i):
    return str(1 + i // 1000) if i % 7 else "X"


def sidecar(folder, name="d"):
    (folder / f"{name}.bim").write_text("".join(f"{chrom(i)} v{i} 0 {i} A G\n" for i in range(M)))
    (folder / f"{name}.fam").write_text("".join(f"f i{i} 0 0 1 -9\n" for i in range(N)))
    (folder / f"{name}.psam").write_text("#IID SEX\n" + "".join(f"i{i} 1\n" for i in range(N)))


KEPT = [i for i in range(M) if chrom(i) == "2"]


@pytest.mark.parametrize("packed", [False, True])
def test_bed(spark, tmp_path, g, packed):
    sidecar(tmp_path)
    data = bed_bytes(g)
    (tmp_path / ("d.bed.gz" if packed else "d.bed")).write_bytes(gzip.compress(data) if packed else data)
    variants, rows, _ = genotypes.read_packed(spark, f"{tmp_path}/d.bed" + (".gz" if packed else ""), chromosomes="2", flip=False)
    assert [r["variant_id"] for r in variants.orderBy("variant_id").collect()] == KEPT
    got = {r["variant_id"]: bytes(r["bits"]) for r in rows.collect()}
    assert got == {i: records.packed(g[i : i + 1].astype(np.uint8)) for i in KEPT}


def test_ranges_without_a_kept_variant_are_not_planned(spark, monkeypatch):
    monkeypatch.setattr(genotypes, "VARIANT_RANGE", 64)
    files = spark.createDataFrame([("a", 1000, N, False, 0), ("b", 2000, N, False, 1000), ("c", 500, N, True, 3000)], "path string, m long, n int, whole boolean, offset long")
    kept = spark.createDataFrame([(i,) for i in KEPT] + [(3100,)], "variant_id long")
    planned = genotypes.ranges(files, kept).collect()
    assert all(r["path"] != "a" for r in planned) and [(r["count"], r["records"]) for r in planned if r["path"] == "c"] == [(500, None)]
    some = [r for r in planned if r["path"] == "b"]
    assert sorted(r["offset"] + x for r in some for x in r["records"]) == KEPT
    assert all(r["first"] <= min(r["records"]) and max(r["records"]) < r["first"] + r["count"] and len(r["records"]) <= 64 for r in some)
    assert len(genotypes.ranges(files).collect()) == 16 + 32 + 1
    # the bytes that are read are those of the kept records
    assert sum(n for r in some for _, n in genotypes.stretches(r["first"], r["count"], np.array(r["records"]))) == len(KEPT)
    assert list(genotypes.stretches(5, 9, None)) == [(5, 9)] and list(genotypes.stretches(0, 9, np.array([1, 2, 5]))) == [(1, 2), (5, 1)]


def test_pgen_records_of_other_chromosomes_are_not_decoded(spark, tmp_path, g):
    sidecar(tmp_path)
    kinds = [0 if i % 50 == 0 else 2 for i in range(M)]
    data = bytearray(pgen_bytes(g.astype(np.uint8), kinds, 4 | 1))
    (tmp_path / "d.pgen").write_bytes(data)
    _, whole, _ = genotypes.read(spark, f"{tmp_path}/d.pgen", mode="all", flip=False)
    assert (matrix(whole, M, N) == g).all()
    for at in range(len(data) - 200, len(data)):  # the last records, of another chromosome
        data[at] = 255
    (tmp_path / "d.pgen").write_bytes(data)
    with pytest.raises(Exception):
        genotypes.read(spark, f"{tmp_path}/d.pgen", mode="all", flip=False)[1].agg(F.sum("g")).collect()
    _, rows, _ = genotypes.read_packed(spark, f"{tmp_path}/d.pgen", chromosomes=["2"], flip=False)
    assert {r["variant_id"]: bytes(r["bits"]) for r in rows.collect()} == {i: records.packed(g[i : i + 1].astype(np.uint8)) for i in KEPT}
