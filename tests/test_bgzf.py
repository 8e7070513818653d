"""Files in BGZF blocks are read by many tasks, with the result of one."""

import gzip
import io
import random
import struct
import zlib

import pytest

from test_reference import bcf_bytes

from genostrata.sources import genotypes, records, sidecars


def bgzf(data, sizes):
    """Blocks of the given sizes, in turn, and the empty one at the end."""
    out, at, turn = b"", 0, 0
    while True:
        part = data[at : at + sizes[turn % len(sizes)]]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        if not part:
            return out
        at, turn = at + len(part), turn + 1


def text(rng, n):
    return "".join(" ".join(rng.choice(["abc", "x\x1f", "q" * rng.randrange(80), ""]) for _ in range(rng.randrange(9))) + "\n" for _ in range(n))


@pytest.mark.parametrize("step", [1, 37, 150, 1000, 10**6])
@pytest.mark.parametrize("sizes", [[1], [7, 300, 2], [60_000]])
def test_ranges_share_the_lines(step, sizes):
    rng = random.Random(step)
    data = (text(rng, 120) + "no end").encode()
    raw = bgzf(data, sizes)
    assert gzip.decompress(raw) == data and records.bgzf_size(raw) > 0
    got = [x for first in range(0, len(raw), step) for part in records.bgzf_lines(io.BytesIO(raw), first, first + step, len(raw)) for x in part]
    assert got == data.split(b"\n")


def test_what_looks_like_a_block_is_none():
    raw = bgzf(b"\x1f\x8b\x08\x04" * 500, [2000])
    inside = raw[:18] + b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\2\0\5\0" + raw[18:]
    assert records.bgzf_start(io.BytesIO(inside), 1, len(inside)) in (len(inside) - 28, len(inside))
    assert not records.bgzf_size(gzip.compress(b"x")) and not records.bgzf_size(b"\x1f\x8b\x08\x04")
    with pytest.raises(records.BadFile):
        list(records.bgzf_blocks(io.BytesIO(raw[:-5]), 0, len(raw) - 5))


def test_vcf_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    calls = ["0/0", "0/1", "1|1", "./.", "1"]
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n"
    body = "".join(f"{1 + i % 3}\t{i}\tv{i}\tA\tG\t.\t.\t.\tGT\t" + "\t".join(rng.choice(calls) for _ in range(3)) + "\n" for i in range(700))
    (tmp_path / "plain.vcf").write_text(head + body)
    (tmp_path / "blocks.vcf.gz").write_bytes(bgzf((head + body).encode(), [500, 900]))
    (tmp_path / "one.vcf.gz").write_bytes(gzip.compress((head + body).encode()))
    monkeypatch.setattr(sidecars, "BGZF_RANGE", 2000)
    assert sidecars.bgzf_rows(spark, f"{tmp_path}/one.vcf.gz") is None
    assert sidecars.bgzf_rows(spark, f"{tmp_path}/blocks.vcf.gz").select("_start").distinct().count() > 3
    want = None
    for name in ("plain.vcf", "blocks.vcf.gz", "one.vcf.gz"):
        variants, rows, _ = genotypes.read_packed(spark, f"{tmp_path}/{name}", flip=False)
        got = (sorted(tuple(r) for r in variants.collect()), sorted((r["variant_id"], bytes(r["bits"])) for r in rows.collect()))
        want = want or got
        assert len(got[1]) == 700 and got == want


def test_bcf_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    data = bcf_bytes([(i % 2, i, [rng.choice([0, 2, 4]) for _ in range(6)]) for i in range(300)])
    monkeypatch.setattr(genotypes, "VARIANT_RANGE", 32)
    (tmp_path / "a.bcf").write_bytes(data)
    (tmp_path / "b.bcf").write_bytes(bgzf(data, [100, 33, 1]))
    (tmp_path / "c.bcf").write_bytes(gzip.compress(data))
    pieces = {p: genotypes.bcf_pieces(spark, f"{tmp_path}/{p}.bcf").collect() for p in "abc"}
    assert [len(pieces[p]) for p in "abc"] == [10, 10, 1] and all(sum(r["count"] for r in x) == 300 for x in pieces.values())
    got = {p: sorted(tuple(r) for r in genotypes.bcf_packed(spark, f"{tmp_path}/{p}.bcf").collect()) for p in "abc"}
    assert [r[0] for r in got["a"]] == list(range(300)) and got["a"] == got["b"] == got["c"]
    assert [r[2] for r in got["a"]] == list(range(300))
    every = genotypes.bcf_packed(spark, f"{tmp_path}/*.bcf")
    assert every.count() == 900 and every.select("variant_id").distinct().count() == 900
