"""Readers, kernels, fits and alignment, on hand-made files and simulated data."""

import gzip
import io
import itertools
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from genostrata.functions import expr, kernels as kn
from genostrata.operators import align, folds, layout, mode_graph
from genostrata.plans import blocks as bl, fit
from genostrata.sources import genotypes, paths, records, sidecars, sinks
from genostrata.streaming import projection


def bed_bytes(g):
    codes = {2: 0, 3: 1, 1: 2, 0: 3}
    out = bytearray(b"\x6c\x1b\x01")
    for row in g:
        for at in range(0, len(row), 4):
            out.append(sum(codes[x] << (2 * i) for i, x in enumerate(row[at : at + 4])))
    return bytes(out)


def matrix(df, m, n):
    out = np.full((m, n), -1)
    for r in df.collect():
        out[r["variant_id"], r["sample_id"]] = r["g"]
    return out


@pytest.mark.parametrize("n", [1, 3, 4, 5])
def test_bed_bytes(n):
    g = np.array(list(itertools.islice(itertools.cycle([0, 1, 2, 3, 3, 1]), 6 * n))).reshape(6, n)
    bits = records.recoded(bed_bytes(g)[3:], tuple(records.BED_CODES.tolist()), n)
    assert (records.unpacked(bits, n) == g).all() and bits == records.packed(g)


def test_bed_files(spark, tmp_path):
    g = np.array([[0, 1, 2, 3, 1], [0, 0, 1, 3, 2], [1, 1, 1, 1, 1]])
    for suffix, pack in (("", bytes), (".gz", gzip.compress), (".zst", zstandard.ZstdCompressor().compress)):
        (tmp_path / f"d.bed{suffix}").write_bytes(pack(bed_bytes(g)))
    (tmp_path / "d.bim").write_text("1 a 0 1 A G\n\nchrX b 0 2 A G\nCHR22\tc\t0\t3\tA\tG\n")
    (tmp_path / "d.fam").write_text("".join(f"f i{i} 0 0 1 -9\n" for i in range(5)))
    for suffix in ("", ".gz", ".zst"):
        v, got, s = genotypes.read(spark, f"{tmp_path}/d.bed{suffix}", mode="all", flip=False)
        assert (matrix(got, 3, 5) == g).all() and s.count() == 5 and v.count() == 3
    v, got, _ = genotypes.read(spark, f"{tmp_path}/d.bed", flip=False)
    assert [r["id"] for r in v.orderBy("variant_id").collect()] == ["a", "c"] and got.count() == 10
    v, _, _ = genotypes.read(spark, f"{tmp_path}/d.bed", chromosomes="x")
    assert [r["id"] for r in v.collect()] == ["b"]
    with pytest.raises(genotypes.BadFile):
        genotypes.read(spark, f"{tmp_path}/d.bed", chromosomes="9")
    with pytest.raises(paths.MissingFile):
        genotypes.read(spark, f"{tmp_path}/none.bed")


def test_vcf(spark, tmp_path):
    calls = "0/0 0|1 1/1 ./. 0/. . 1 2/2 1/2 0/1:35 1/1/1 2".split()
    want = [0, 1, 2, 3, 3, 3, 2, 3, 3, 1, 2, 3]
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(12)) + "\n"
    fixed = "\t10\tv\tA\tG\t.\t.\t.\tGT\t"
    (tmp_path / "d.vcf").write_text(head + f"chr1{fixed}" + "\t".join(calls) + "\r\n" + f"2{fixed}0/1\t1\r\n")
    v, g, _ = genotypes.read(spark, f"{tmp_path}/d.vcf", flip=False)
    assert matrix(g, 2, 12).tolist() == [want, [1, 2] + [3] * 10] and [r["chrom"] for r in v.orderBy("variant_id").collect()] == ["chr1", "2"]


def bcf_bytes(rows):
    header = b'##fileformat=VCFv4.2\n##FORMAT=<ID=DP,Number=1,IDX=1>\n##FORMAT=<ID=GT,Number=1,IDX=2>\n##contig=<ID=1>\n##contig=<ID=X>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n\0'
    out = b"BCF\2\2" + struct.pack("<I", len(header)) + header
    for chrom, pos, alleles in rows:
        shared = struct.pack("<iiif", chrom, pos - 1, 1, 0.0) + struct.pack("<HH", 0, 2) + (3).to_bytes(3, "little") + b"\2" + b"\x17v\x17A\x17G\x00"
        own = b"\x11\x01\x11" + bytes([5, 6, 7]) + b"\x11\x02\x21" + bytes(alleles)
        out += struct.pack("<II", len(shared), len(own)) + shared + own
    return out


def test_bcf_and_pgen(spark, tmp_path):
    data = bcf_bytes([(0, 5, [2, 4, 4, 5, 0, 2]), (1, 6, [2, 2, 4, 0x81, 6, 6])])
    (tmp_path / "d.bcf.gz").write_bytes(gzip.compress(data))
    v, g, _ = genotypes.read(spark, f"{tmp_path}/d.bcf.gz", mode="all", flip=False)
    assert matrix(g, 2, 3).tolist() == [[1, 2, 3], [0, 2, 3]]
    assert [(r["chrom"], r["pos"]) for r in v.orderBy("variant_id").collect()] == [("1", 5), ("X", 6)]
    (tmp_path / "p.pgen").write_bytes(b"\x6c\x1b\x02" + struct.pack("<II", 2, 5) + b"\x40" + bytes([0b11100100, 1, 0b00000000, 2]))
    assert matrix(genotypes.read_pgen(spark, f"{tmp_path}/p.pgen"), 2, 5).tolist() == [[0, 1, 2, 3, 1], [0, 0, 0, 0, 2]]
    with pytest.raises(NotImplementedError):
        records.pgen_head(io.BytesIO(b"\x6c\x1b\x20" + bytes(20)))


def varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def difflist(ids, g, n):
    """Differences, written one by one."""
    if not ids:
        return b"\0"
    width = len(n.to_bytes(8, "little").rstrip(b"\0"))
    groups = [ids[i : i + 64] for i in range(0, len(ids), 64)]
    steps = [b"".join(varint(y - x) for x, y in zip(part, part[1:])) for part in groups]
    out = varint(len(ids)) + b"".join(part[0].to_bytes(width, "little") for part in groups)
    return out + bytes((len(s) - 63) % 256 for s in steps[:-1]) + records.packed(np.array([g])) + b"".join(steps)


def pgen_bytes(g, kinds, control):
    """Variable-width records of the given kinds."""
    m, n = g.shape
    body, base = [], None
    for row, kind in zip(g, kinds):
        main = kind & 7
        if main == 0:
            rec = records.packed(row[None])
        elif main == 1:
            rest = [i for i in range(n) if row[i] not in (0, 2)]
            rec = bytes([0 << 2 | 2]) + np.packbits(row == 2, bitorder="little").tobytes() + difflist(rest, row[rest], n)
        elif main in (2, 3):
            want = np.array([2, 1, 0, 3])[row] if main == 3 else row
            rest = np.flatnonzero(want != base).tolist()
            rec = difflist(rest, want[rest], n)
        else:
            rest = np.flatnonzero(row != main - 4).tolist()
            rec = difflist(rest, row[rest], n)
        if main not in (2, 3):
            base = row
        body.append(rec)
    width, wide = (control & 3) + 1, bool(control & 4)
    blocks = range(0, m, records.PGEN_BLOCK)
    index = b""
    for at in blocks:
        part = list(kinds[at : at + records.PGEN_BLOCK])
        if wide:
            index += bytes(part)
        else:
            part += [0] * (len(part) % 2)
            index += bytes(a | b << 4 for a, b in zip(part[::2], part[1::2]))
        index += b"".join(len(x).to_bytes(width, "little") for x in body[at : at + records.PGEN_BLOCK])
        index += b"\2" * len(kinds[at : at + records.PGEN_BLOCK]) * (control >> 4 & 3)
        if control >> 6 == 3:
            index += bytes((len(kinds[at : at + records.PGEN_BLOCK]) + 7) // 8)
    start = 12 + 8 * len(blocks) + len(index)
    offsets = b"".join(struct.pack("<Q", start + sum(map(len, body[:at]))) for at in blocks)
    return b"\x6c\x1b\x10" + struct.pack("<II", m, n) + bytes([control]) + offsets + index + b"".join(body)


@pytest.mark.parametrize("n,control", [(5, 0x40), (300, 0x41), (300, 0xD5), (70000, 0x42)])
def test_pgen_of_variable_width(n, control):
    rng = np.random.default_rng(n)
    g = rng.choice(4, (14, n), p=[0.7, 0.1, 0.15, 0.05]).astype(np.uint8)
    g[1] = np.where(rng.random(n) < 0.02, 3, g[0])
    g[2] = np.array([2, 1, 0, 3])[g[0]]
    kinds = [0, 2, 3, 1, 2, 4, 6, 7, 2, 0, 1, 3, 4, 0]
    data = pgen_bytes(g, kinds, control)
    for first, count in ((0, 14), (1, 3), (8, 6)):
        assert (records.pgen_rows(io.BytesIO(data), first, count) == g[first : first + count]).all()


def test_pgen_of_more_than_one_block():
    rng = np.random.default_rng(4)
    m = records.PGEN_BLOCK + 700
    g = rng.integers(0, 4, (m, 3)).astype(np.uint8)
    kinds = [0 if i % records.PGEN_BLOCK == 0 else int(k) for i, k in enumerate(rng.integers(0, 8, m))]
    kinds = [4 if k == 5 else k for k in kinds]
    f = io.BytesIO(pgen_bytes(g, kinds, 0xC0))
    for first in (0, 1024, records.PGEN_BLOCK - 1024, records.PGEN_BLOCK):
        assert (records.pgen_rows(f, first, 700) == g[first : first + 700]).all()


def test_folders_are_one_data_set(spark, tmp_path):
    """Variants are counted on from file to file, whatever the format."""
    rng = np.random.default_rng(6)
    g = rng.integers(0, 4, (2500, 5)).astype(np.uint8)
    for name in ("bed", "pgen", "bcf", "bim"):
        (tmp_path / name).mkdir()
    kinds = [0] + [1, 2, 4, 3, 6, 7, 0] * 400
    for i, (a, b) in enumerate(((0, 1100), (1100, 1103), (1103, 2500))):
        (tmp_path / f"bed/c{i}.bed").write_bytes(bed_bytes(g[a:b]) if i else gzip.compress(bed_bytes(g[a:b])))
        (tmp_path / f"pgen/c{i}.pgen").write_bytes(pgen_bytes(g[a:b], kinds[: b - a], 0x40))
        (tmp_path / f"bcf/c{i}.bcf").write_bytes(bcf_bytes([(0, 5 + i, [2, 4, 4, 5, 0, 2]), (1, 6, [2, 2, 4, 0x81, 6, 6])]))
        (tmp_path / f"bim/c{i}.bim").write_text("".join(f"1 v{v} 0 {v} A G\n" for v in range(a, b)))
    assert (matrix(genotypes.read_bed(spark, f"{tmp_path}/bed", 5, 2500), 2500, 5) == g).all()
    assert (matrix(genotypes.read_pgen(spark, f"{tmp_path}/pgen"), 2500, 5) == g).all()
    v, got = genotypes.read_bcf(spark, f"{tmp_path}/bcf")
    assert matrix(got, 6, 3).tolist() == [[1, 2, 3], [0, 2, 3]] * 3 and [r["pos"] for r in v.orderBy("variant_id").collect()] == [5, 6, 6, 6, 7, 6]
    names = sidecars.bim(spark, f"{tmp_path}/bim").orderBy("variant_id").collect()
    assert [(r["variant_id"], r["id"]) for r in names] == [(i, f"v{i}") for i in range(2500)]
    with pytest.raises(genotypes.BadFile):
        genotypes.read_bed(spark, f"{tmp_path}/bed", 5, 2499)
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\0" + bytes(10))
    with pytest.raises(Exception, match="BED"):
        genotypes.read_bed(spark, f"{tmp_path}/x.bed", 5, 5)


def test_packed_reading(spark, tmp_path):
    g = np.array([[2, 2, 2, 3, 1], [2, 0, 2, 2, 2], [0, 1, 2, 3, 0]])
    (tmp_path / "d.bed").write_bytes(bed_bytes(g))
    (tmp_path / "d.bim").write_text("1 a 0 1 A G\n2 b 0 2 A G\nX c 0 3 A G\n")
    (tmp_path / "d.fam").write_text("".join(f"f i{i} 0 0 1 -9\n" for i in range(5)))
    _, rows, _ = genotypes.read_packed(spark, f"{tmp_path}/d.bed")
    other = np.array([2, 1, 0, 3])[g[:2]]
    assert [(r["variant_id"], r["n"], bytes(r["bits"])) for r in rows.orderBy("variant_id").collect()] == [(i, 5, records.packed(other[i : i + 1])) for i in range(2)]
    _, long, _ = genotypes.read(spark, f"{tmp_path}/d.bed")
    assert (matrix(long, 2, 5) == other).all()
    calls = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(g)], "variant_id long, calls array<int>")
    assert [bytes(r["bits"]) for r in genotypes.packed_calls(calls, 5).orderBy("variant_id").collect()] == [records.packed(x[None]) for x in g]
    b = bl.packed_blocks(rows, 2, 5, block_rows=1)
    assert sorted((r["row0"], bytes(r["g"])) for r in b.frame.collect()) == [(i, other[i].astype(np.uint8).tobytes()) for i in range(2)]


def test_sidecars_and_sinks(spark, tmp_path):
    (tmp_path / "runs.tsv").write_text("# c\nrunA\t3\tq/a.Q\nrunB\t4\t/abs/b.Q\n")
    rows = sidecars.filemap(spark, f"{tmp_path}/runs.tsv").orderBy("idx").collect()
    assert [(r["run_id"], r["k"], r["path"]) for r in rows] == [("runA", 3, f"{tmp_path}/q/a.Q"), ("runB", 4, "/abs/b.Q")]
    q = spark.createDataFrame([(1, [0.25, 0.75]), (0, [1.0, 0.0])], "sample_id long, q array<double>")
    sinks.write_matrix(q, f"{tmp_path}/out.Q", "sample_id", "q")
    back = sidecars.q_matrix(spark, f"{tmp_path}/out.Q").orderBy("sample_id").collect()
    assert back[1]["q"] == pytest.approx([0.25, 0.75])


def test_chromosomes(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "chr1", "CHR22", "X", "chrX", "23", "0", None, "MT")], "chrom string")
    assert [r["chrom"] for r in df.where(expr.is_autosome("chrom")).collect()] == ["1", "chr1", "CHR22"]
    assert [r["chrom"] for r in df.where(expr.in_chromosomes("chrom", "chr1, x")).collect()] == ["1", "chr1", "X", "chrX"]


def test_fold_hash_definition(spark):
    def plain(x):
        m = (1 << 64) - 1
        x = (x + 42 + folds.STEP) & m
        x = ((x ^ x >> 30) * folds.FIRST) & m
        x = ((x ^ x >> 27) * folds.SECOND) & m
        return (x ^ x >> 31) % 5

    got = spark.range(500).select("id", folds.fold_of(F.col("id"), 5, 42).alias("f")).collect()
    assert all(r["f"] == plain(r["id"]) for r in got)


def test_small_solvers():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(50, 4))
    x = kn.to_simplex(b)
    assert np.allclose(x.sum(1), 1) and x.min() >= expr.EPS - 1e-12
    other = kn.normalize(rng.random((50, 4)))
    assert (((x - b) ** 2).sum(1) <= ((other - b) ** 2).sum(1) + 1e-9).all()
    m = rng.normal(size=(6, 4))
    a = m.T @ m
    rhs = rng.normal(size=(80, 4)) * 3
    y = kn.bounded_least_squares(a, rhs)
    slope = y @ a - rhs
    assert ((y >= 0) & (y <= 1)).all()
    assert (np.where(y < 1e-7, slope > -1e-5, np.where(y > 1 - 1e-7, slope < 1e-5, np.abs(slope) < 1e-5))).all()


@pytest.mark.parametrize("simplex", [False, True])
def test_box_qp_is_optimal(simplex):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 7, 4))
    h = np.einsum("imk,iml->ikl", m, m)
    grad, x = rng.normal(size=(60, 4)) * 5, kn.normalize(rng.random((60, 4)))
    y = kn.box_qp(h.reshape(60, 16), grad, x, simplex)
    assert y.min() >= 0 and y.max() <= 1 and (not simplex or np.allclose(y.sum(1), 1))
    value = lambda z: 0.5 * np.einsum("ik,ikl,il->i", z - x, h, z - x) - (grad * (z - x)).sum(1)
    for _ in range(200):
        z = rng.dirichlet(np.ones(4), 60) if simplex else rng.random((60, 4))
        assert (value(y) <= value(y + 0.3 * (z - y)) + 1e-6).all()


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(5)
    m, n, k = 120, 40, 3
    p, q = rng.uniform(0.05, 0.95, (m, k)), rng.dirichlet(np.full(k, 0.2), n)
    g = rng.binomial(2, np.clip(p @ q.T, 0, 1))
    g[rng.random((m, n)) < 0.03] = 3
    rows = [(int(v), int(s), int(g[v, s])) for v in range(m) for s in range(n)]
    return bl.to_blocks(spark.createDataFrame(rows, "variant_id long, sample_id int, g int"), m, n, block_rows=50), g, q


def test_em_and_newton(simulated):
    b, g, q = simulated
    start = fit.random_start(b, 3)
    f = fit.em(b, start, 4)
    assert all(x <= y + 1e-9 for x, y in zip(f.course, f.course[1:]))
    best = fit.newton(b, f, fit.Options(max_iter=12))
    assert best.log_likelihood > f.log_likelihood
    p = np.zeros((len(g), 3))
    for r in b.rows(best.p, 1, 3).collect():
        p[r["variant_id"]] = r["p"]
    assert kn.log_likelihood(g, p, best.q) == pytest.approx(best.log_likelihood, rel=1e-9)
    order = align.permutation(q, best.q)
    assert np.sqrt(((best.q[:, order] - q) ** 2).mean()) < 0.15
    again = fit.project(b, best.p, 3, fit.Options(max_iter=12))
    assert np.abs(again.q - best.q).max() < 2e-2


def test_rows_solved_where_their_sums_are_added(simulated, monkeypatch):
    b, g, q = simulated
    start = fit.random_start(b, 3)
    p = np.zeros((len(g), 3))
    for r in b.rows(start.p, 1, 3).collect():
        p[r["variant_id"]] = r["p"]
    monkeypatch.setattr(bl, "CHUNK", 50)  # four samples of 12 numbers in a chunk
    _, (total, got) = b.run(
        lambda g, s, row0: (None, [np.array([g.sum()]), np.concatenate(kn.newton_q(g, s[0], q), axis=1)]),
        start.p, 1, 3, [(1,)], lambda x, first: x[:, :3] / (first + 1 + np.arange(len(x)))[:, None],
    )
    grad, _ = kn.newton_q(g, p, q)
    assert total[0] == g.sum() and np.allclose(got, grad / (1 + np.arange(len(q)))[:, None])
    some = fit.newton(b, start, fit.Options(max_iter=3))
    monkeypatch.undo()
    assert np.allclose(some.q, fit.newton(b, start, fit.Options(max_iter=3)).q, atol=1e-9)
    y = np.where(np.arange(len(q)) % 3 == 0, np.arange(len(q)) % 2, -1)
    known = fit.newton(b, fit.supervised_start(b, np.where(np.arange(len(q)) < 3, np.arange(len(q)), y)), fit.Options(max_iter=2), y).q
    assert np.allclose(known[np.flatnonzero(y >= 0), y[y >= 0]], 1, atol=1e-3)


def test_svd(simulated):
    b, g, _ = simulated
    s, v = fit.svd(b, 3)
    exact = np.linalg.svd(fit.centred(g), compute_uv=False)[:3]
    assert np.allclose(s, exact, rtol=2e-2) and np.allclose(v.T @ v, np.eye(3), atol=1e-6)


def test_assignment_against_exhaustive():
    rng = np.random.default_rng(7)
    for _ in range(20):
        c = rng.random((4, 6))
        best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4))
        assert c[np.arange(4), align.assignment(c)].sum() == pytest.approx(best)
        d = rng.random((5, 3))
        to = align.matching(d)
        best = min(sum(d[i, j] for i, j in enumerate(p)) for p in itertools.product(range(3), repeat=5) if set(p) == {0, 1, 2})
        assert d[np.arange(5), to].sum() == pytest.approx(best) and set(to) == {0, 1, 2}


def test_permutation_and_modes(spark):
    rng = np.random.default_rng(8)
    q = rng.dirichlet(np.full(4, 0.4), 40)
    order = [2, 0, 3, 1]
    assert np.allclose(q[:, order][:, align.permutation(q, q[:, order])], q)
    bases, rows = [rng.dirichlet(np.full(3, 0.4), 30) for _ in range(2)], []
    for r in range(8):
        x = np.clip(bases[r % 2] + rng.normal(0, 1e-3, (30, 3)), 0, 1)
        x = (x / x.sum(1, keepdims=True))[:, rng.permutation(3)]
        rows += [(r, i, k, float(x[i, k])) for i in range(30) for k in range(3)]
    got = align.modes(spark.createDataFrame(rows, "run_id int, sample_id int, k int, q double"), test=False)
    assert [m["runs"] for m in got] == [[0, 2, 4, 6], [1, 3, 5, 7]] and [m["mode"] for m in got] == ["K3M1", "K3M2"]


def test_modes_across_k(spark):
    """Links, costs and orders against plain matrices."""
    rng = np.random.default_rng(9)
    top = rng.dirichlet(np.full(5, 0.3), 60)
    plain = {"K5M1": top, "K5M2": top[:, [3, 1, 0, 4, 2]], "K4M1": np.column_stack([top[:, 4], top[:, 0] + top[:, 2], top[:, 3], top[:, 1]]), "K2M1": np.column_stack([top[:, :2].sum(1), top[:, 2:].sum(1)])}
    plain["K4M2"] = kn.normalize(plain["K4M1"][:, ::-1] + rng.uniform(0, 0.1, (60, 4)))
    rows = [(m, i, k, float(q[i, k])) for m, q in plain.items() for i in range(60) for k in range(q.shape[1])]
    modes = spark.createDataFrame(rows, "mode string, sample_id int, k int, q double")
    x = mode_graph.products(modes)
    links, anchors = mode_graph.graph(x)
    for one in links:
        low, high = plain[one.low], plain[one.high]
        options = []
        for to in itertools.product(range(low.shape[1]), repeat=high.shape[1]):
            if set(to) == set(range(low.shape[1])):
                if high.shape[1] == low.shape[1] + 1:
                    merged = np.stack([high[:, [i for i, t in enumerate(to) if t == j]].sum(1) for j in range(low.shape[1])], 1)
                    options.append(((merged - low) ** 2).sum() / 60)
                else:
                    options.append(sum(((high[:, i] - low[:, t]) ** 2).mean() for i, t in enumerate(to)))
        assert one.objective == pytest.approx(min(options), abs=1e-9)
        merged = np.stack([high[:, [i for i, t in enumerate(one.targets) if t == j]].sum(1) for j in range(low.shape[1])], 1)
        assert one.cost == pytest.approx(((merged - low) ** 2).sum() / 120, abs=1e-9)
    assert [(a.low, a.high[:2]) for a in anchors] == [("K2M1", "K4"), ("K4M1", "K5")]
    places = mode_graph.orders(x)
    assert all(sorted(p) == list(range(plain[m].shape[1])) for m, p in places.items())
    got = {m: np.zeros_like(q) for m, q in plain.items()}
    for r in mode_graph.reordered(modes, places).collect():
        got[r["mode"]][r["sample_id"], r["k"]] = r["q"]
    assert np.allclose(got["K5M1"], got["K5M2"]) and np.abs(got["K4M1"] - got["K4M2"]).mean() < 0.1
    near = np.abs(got["K5M1"][:, :4] - got["K4M1"]).mean(0)
    assert (near < 1e-12).sum() == 3  # all but the column that split


def test_matrices_as_they_come(spark, tmp_path):
    q = np.array([[0.2, 0.8], [0.5, 1.5], [0, 0]])
    np.savetxt(f"{tmp_path}/a.Q", q)
    np.savetxt(f"{tmp_path}/wide.Q", q.T)
    np.save(f"{tmp_path}/b.npy", q)
    for name in ("a.Q", "wide.Q", "b.npy"):
        got = [r["q"] for r in sidecars.q_proportions(spark, f"{tmp_path}/{name}").orderBy("sample_id").collect()]
        assert np.allclose(got, [[0.2, 0.8], [0.25, 0.75], [0, 0]])
    est = [r["q"] for r in sidecars.q_matrix(spark, f"{tmp_path}/wide.Q").orderBy("sample_id").collect()]
    assert np.allclose(np.sum(est, 1), 1) and est[2] == pytest.approx([0.5, 0.5])
    (tmp_path / "one.P").write_text("0.25\n1.0\n0\n")
    assert [r["p"] for r in sidecars.p_matrix(spark, f"{tmp_path}/one.P").orderBy("variant_id").collect()] == [[0.25], [1 - expr.EPS], [expr.EPS]]
    (tmp_path / "bad.Q").write_text("1 2\n1\n1 1\n")
    with pytest.raises(genotypes.BadFile):
        sidecars.q_proportions(spark, f"{tmp_path}/bad.Q")
    assert sidecars.labels(spark, f"{tmp_path}/none.txt") is None
    (tmp_path / "map.tsv").write_text("runA\t2\ta.Q\nrunB\t2\tb.npy\n")
    assert sidecars.runs(spark, f"{tmp_path}/map.tsv").groupBy("run_id", "k_total").count().orderBy("run_id").collect() == [("runA", 2, 6), ("runB", 2, 6)]
    (tmp_path / "map.tsv").write_text("runA\t3\ta.Q\n")
    with pytest.raises(Exception, match="3 columns"):
        sidecars.runs(spark, f"{tmp_path}/map.tsv").collect()
    (tmp_path / "o.yaml").write_text("# fit\nmax-iter: 7\ntol: 0.5  # less\n")
    o = fit.options_of(sidecars.settings(spark, f"{tmp_path}/o.yaml"))
    assert (o.max_iter, o.tol) == (7, 0.5)
    with pytest.raises(ValueError):
        fit.options_of({"maxiter": "3"})
    with pytest.raises(ValueError):
        fit.options_of({"max_iter": "0"})


def test_side_by_side_bars_and_reports(spark):
    q = spark.createDataFrame([(i, [1 - i / 4, i / 4]) for i in range(4)], "sample_id long, q array<double>")
    y = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4)], "sample_id long, label string")
    assert sidecars.side_by_side(q, y, "sample_id", "labels").count() == 4
    with pytest.raises(genotypes.BadFile, match="4 against 3"):
        sidecars.side_by_side(q, y.where("sample_id > 0"), "sample_id", "labels")
    rows = layout.bars(q, y, ["label"]).orderBy("pos", "k").collect()
    assert [(r["pos"], r["sample_id"], r["label"]) for r in rows[::2]] == [(0, 2, "a"), (1, 0, "a"), (2, 1, "b"), (3, 3, "b")]
    assert all(a["high"] == pytest.approx(b["low"]) for a, b in zip(rows[::2], rows[1::2]))
    got = sinks.report(spark.createDataFrame([(1, 0.5, 2.0)], "k int, rmse double, frobenius double")).first()
    assert tuple(got) == (1, "0.5000000", "2.000000")


def test_adaptive_fits(simulated):
    """The adaptive method also projects and takes labels."""
    b, g, q = simulated
    o = fit.Options(max_iter=15)
    f = fit.em(b, fit.random_start(b, 3), 3)
    best = fit.adaptive_em(b, f, o)
    assert best.log_likelihood > f.log_likelihood
    again = fit.project(b, best.p, 3, o, adaptive=True)
    assert np.isfinite(again.q).all() and np.allclose(again.q.sum(1), 1)
    y = np.where(q.max(1) > 0.9, q.argmax(1), -1)
    known = fit.adaptive_em(b, fit.supervised_start(b, y), o, y=y)
    at = np.flatnonzero(y >= 0)
    assert len(at) and (known.q[at, y[at]] > 0.99).all()


def test_tracy_widom():
    x = np.linspace(-9, 8, 400)
    law = np.array([align.tracy_widom(v) for v in x])
    assert (np.diff(law) >= -1e-12).all() and law[0] < 1e-6 and law[-1] > 1 - 1e-6
    density = np.diff(law)
    mean = (density * (x[1:] + x[:-1]) / 2).sum()
    assert mean == pytest.approx(-1.2065, abs=5e-3)


def test_louvain():
    rng = np.random.default_rng(0)
    w = np.full((12, 12), 0.05)
    w[:6, :6] = w[6:, 6:] = 0.9
    np.fill_diagonal(w, 1)
    label = align.louvain(w)
    assert len(set(label[:6])) == len(set(label[6:])) == 1 and label[0] != label[6]
    del rng


def test_streaming_projection(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, (200, 2))
    rows = [(s, v, int(rng.binomial(2, p[v, s % 2]))) for s in range(4) for v in range(200)]
    spark.createDataFrame(rows, "sample_id long, variant_id long, g int").write.parquet(f"{tmp_path}/in")
    pt = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "variant_id long, p array<double>")
    stream = spark.readStream.schema("sample_id long, variant_id long, g int").parquet(f"{tmp_path}/in")
    q = projection.project_stream(stream, pt, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = {r["sample_id"]: r["q"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert all(got[s][s % 2] > 0.8 for s in range(4))
