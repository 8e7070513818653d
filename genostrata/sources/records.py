"""Records of binary genotype files: opening, two-bit rows, and the layouts of PGEN and BCF.

A row of genotypes is held packed, four in a byte, the first in the lowest bits; places past the last
sample are missing, so that tables by byte give right counts.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import zstandard
from pyarrow import fs

from ..functions.expr import MISSING

#: Genotypes of the four two-bit codes of a BED file.
BED_CODES = np.array([2, MISSING, 1, 0], np.uint8)
#: First bytes of the formats.
BED_START, PGEN_START, GZIP_START, ZSTD_START = b"\x6c\x1b\x01", b"\x6c\x1b", b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
#: Fixed value: variants in a block of a PGEN index; the first of a block never builds on another.
PGEN_BLOCK = 1 << 16
SHIFTS = np.array([0, 2, 4, 6], np.uint8)


class BadFile(ValueError):
    """A file that isn't what its name says."""


# ---- files ----


def opened(path: str) -> BinaryIO:
    """A file of any store that Arrow knows, for reading at any place."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@?=&"))
    return system.open_input_file(name)


def is_compressed(path: str) -> bool:
    with opened(path) as f:
        return f.read(4).startswith((GZIP_START, ZSTD_START))


def stream(path: str) -> BinaryIO:
    """The content from its start on, decompressed piece by piece; gzip may come in blocks."""
    f = opened(path)
    head = f.read(4)
    f.seek(0)
    if head.startswith(GZIP_START):
        return gzip.GzipFile(fileobj=f)
    if head.startswith(ZSTD_START):
        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
    return f


#: Most bytes of a BGZF block, and those that are looked through for the start of one.
BGZF_BLOCK = 1 << 16


def bgzf_size(head: bytes, at: int = 0) -> int:
    """Bytes of the BGZF block that begins at a place, 0 if none does."""
    if head[at : at + 4] != b"\x1f\x8b\x08\x04" or len(head) < at + 18:
        return 0
    end = at + 12 + int.from_bytes(head[at + 10 : at + 12], "little")
    at += 12
    while at + 4 <= end:
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def is_bgzf(path: str) -> bool:
    with opened(path) as f:
        return bgzf_size(f.read(64)) > 0


def bgzf_start(f: BinaryIO, at: int, length: int) -> int:
    """The first block at a place or after it, or the file's end: a start is one if it leads to another."""
    f.seek(at)
    data = f.read(min(3 * BGZF_BLOCK, length - at))
    i = data.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        size = bgzf_size(data, i)
        if size and (at + i + size == length or bgzf_size(data, i + size) or i + size + 18 > len(data)):
            return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return length


def bgzf_blocks(f: BinaryIO, at: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from one on."""
    while at < length:
        f.seek(at)
        data = f.read(min(BGZF_BLOCK, length - at))
        size = bgzf_size(data)
        if not size or size > len(data):
            raise BadFile(f"no block at byte {at}")
        yield at, zlib.decompress(data[:size], 31)
        at += size


def bgzf_lines(f: BinaryIO, first: int, last: int, length: int) -> Iterator[list[bytes]]:
    """Lines, some at a time, of the blocks that begin from `first` on and before `last`: those that begin in them,
    the first line but for the file's first going to the blocks before, and the one after their end to them."""
    start = bgzf_start(f, first, length) if first else 0
    if start >= last:
        return
    rest, skip, past = b"", first > 0, False
    for at, data in bgzf_blocks(f, start, length):
        if at >= last:
            past = True
        cut = data.rfind(b"\n") if not past else data.find(b"\n")
        if cut < 0:
            rest += data
            continue
        found = (rest + data[: cut + 1]).split(b"\n")[:-1]
        rest = data[cut + 1 :]
        if skip:
            found, skip = found[1:], False
            if past:  # a line that goes through all of the range and begins before it
                return
        yield found
        if past:
            return
    if rest and not skip:
        yield [rest]


class BlockReader:
    """The content of BGZF blocks from one on, read forward, with the place of what is read next."""

    def __init__(self, f: BinaryIO, at: int, length: int) -> None:
        self.blocks, self.at, self.data, self.pos = bgzf_blocks(f, at, length), at, b"", 0

    def where(self) -> tuple[int, int]:
        """(the block's place, bytes into its content) of the next byte."""
        while self.pos == len(self.data):
            got = next(self.blocks, None)
            if got is None:
                break
            self.at, self.data = got
            self.pos = 0
        return self.at, self.pos

    def read(self, n: int) -> bytes:
        self.where()
        out = self.data[self.pos : self.pos + n]
        self.pos += len(out)
        return out


def exactly(f: BinaryIO, n: int) -> bytes:
    """The next n bytes, or an error."""
    parts, left = [], n
    while left:
        got = f.read(left)
        if not got:
            raise BadFile(f"{left} bytes are missing at the end")
        parts.append(got)
        left -= len(got)
    return b"".join(parts)


def rest_of(f: BinaryIO) -> int:
    n = 0
    while got := f.read(1 << 22):
        n += len(got)
    return n


# ---- two-bit rows ----


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """(rows, n) of packed rows."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, (n + 3) // 4)
    return ((b[:, :, None] >> SHIFTS) & 3).reshape(len(b), -1)[:, :n]


def packed(g: np.ndarray) -> bytes:
    """Packed rows of (rows, n)."""
    wide = np.full((len(g), -(-g.shape[1] // 4) * 4), MISSING, np.uint8)
    wide[:, : g.shape[1]] = g
    return (wide.reshape(len(g), -1, 4) << SHIFTS).sum(2, dtype=np.uint8).tobytes()


@cache
def byte_table(codes: tuple[int, ...]) -> np.ndarray:
    """For each byte, the one with each of its four genotypes replaced."""
    four = (np.arange(256, dtype=np.uint8)[:, None] >> SHIFTS) & 3
    return (np.array(codes, np.uint8)[four] << SHIFTS).sum(1, dtype=np.uint8)


def recoded(raw: bytes, codes: tuple[int, ...], n: int) -> bytes:
    """Packed rows with other codes; places past the last sample are made missing."""
    b = byte_table(codes)[np.frombuffer(raw, np.uint8)].reshape(-1, (n + 3) // 4)
    if n % 4:
        b[:, -1] |= (0xFF << 2 * (n % 4)) & 0xFF
    return b.tobytes()


# ---- PGEN ----


def varints(data: np.ndarray, count: int) -> np.ndarray:
    """The first `count` numbers written in groups of seven bits, lowest first."""
    if not count:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)[:count]
    if len(ends) < count:
        raise BadFile("a list of numbers is cut off")
    starts = np.append(0, ends[:-1] + 1)
    used = ends[-1] + 1
    place = np.arange(used) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data[:used].astype(np.int64) & 127) << 7 * place, starts)


def exceptions(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, genotypes) of a list of differences: its length, the first sample of each 64, the
    groups' sizes, the genotypes, and the steps to the other samples."""
    length = int(varints(data, 1)[0])
    if not length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = int(np.argmax(data < 128)) + 1
    groups, width = -(-length // 64), (n.bit_length() + 7) // 8
    ids = np.zeros((groups, 64), np.int64)
    first = data[at : at + groups * width].reshape(groups, width).astype(np.int64)
    ids[:, 0] = (first << 8 * np.arange(width)).sum(1)
    at += groups * width + groups - 1
    g = unpacked(data[at : at + -(-length // 4)].tobytes(), length)[0]
    steps = np.zeros(groups * 63, np.int64)
    steps[: length - groups] = varints(data[at + -(-length // 4) :], length - groups)
    ids[:, 1:] = steps.reshape(groups, 63)
    samples = ids.cumsum(1).ravel()[:length]
    if samples.max() >= n:
        raise BadFile("a sample that doesn't exist")
    return samples, g


def pgen_head(f: BinaryIO) -> tuple[int, int, int, int]:
    """(variants, samples, mode, control byte)."""
    f.seek(0)
    head = exactly(f, 12)
    if not head.startswith(PGEN_START):
        raise BadFile("not a PGEN file")
    if head[2] not in (0x02, 0x10) or head[2] == 0x10 and head[11] & 15 > 7:
        raise NotImplementedError(f"PGEN storage mode {head[2]:#x}, index {head[11] & 15}: hard calls of fixed width (0x02) and variable width (0x10) are read")
    m, n = struct.unpack_from("<II", head, 3)
    return m, n, head[2], head[11]


def pgen_index(f: BinaryIO, m: int, control: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(types, places of the records and of the last one's end) of a block of variable-width records."""
    blocks, size = -(-m // PGEN_BLOCK), min(PGEN_BLOCK, m - block * PGEN_BLOCK)
    wide, width = bool(control & 4), (control & 3) + 1
    alleles, flags = control >> 4 & 3, control >> 6 == 3
    part = PGEN_BLOCK * width + (PGEN_BLOCK if wide else PGEN_BLOCK // 2) + PGEN_BLOCK * alleles + (PGEN_BLOCK // 8 if flags else 0)
    f.seek(12 + 8 * block)
    start = struct.unpack("<Q", exactly(f, 8))[0]
    f.seek(12 + 8 * blocks + block * part)
    kinds = np.frombuffer(exactly(f, size if wide else (size + 1) // 2), np.uint8)
    if not wide:
        kinds = np.column_stack([kinds & 15, kinds >> 4]).ravel()[:size]
    sizes = np.frombuffer(exactly(f, size * width), np.uint8).reshape(size, width).astype(np.int64)
    return kinds, start + np.append(0, (sizes << 8 * np.arange(width)).sum(1).cumsum())


def pgen_record(data: np.ndarray, kind: int, n: int, base: np.ndarray | None) -> np.ndarray:
    """Genotypes of one record; kinds 2 and 3 build on the last row of another kind. What follows the
    hard calls (phases, dosages, further alleles) isn't read."""
    kind &= 7
    if kind == 0:
        return unpacked(data[: (n + 3) // 4].tobytes(), n)[0]
    if kind == 1:  # two common genotypes by a bit each
        bits = np.unpackbits(data[1 : 1 + (n + 7) // 8], bitorder="little")[:n]
        row, data = ((data[0] >> 2) + (data[0] & 3) * bits).astype(np.uint8), data[1 + (n + 7) // 8 :]
    elif kind in (2, 3):
        if base is None:
            raise BadFile("a record builds on none")
        row = base.copy()
    else:
        row = np.full(n, kind & 3, np.uint8)
    samples, g = exceptions(data, n)
    row[samples] = g
    return np.array([2, 1, 0, MISSING], np.uint8)[row] if kind == 3 else row


def pgen_rows(f: BinaryIO, first: int, count: int) -> np.ndarray:
    """(count, n) genotypes from a variant on, all in one block of the index."""
    m, n, mode, control = pgen_head(f)
    stride = (n + 3) // 4
    if mode == 0x02:
        f.seek(12 + first * stride)
        return unpacked(exactly(f, count * stride), n)
    kinds, places = pgen_index(f, m, control, first // PGEN_BLOCK)
    lo = first % PGEN_BLOCK

    def read(a: int, b: int) -> np.ndarray:
        f.seek(int(places[a]))
        return np.frombuffer(exactly(f, int(places[b] - places[a])), np.uint8)

    builds = (kinds & 6) == 2
    base = None
    if builds[lo]:
        back = int(np.flatnonzero(~builds[:lo])[-1]) if (~builds[:lo]).any() else -1
        if back < 0:
            raise BadFile("a block's first record builds on another")
        base = pgen_record(read(back, back + 1), int(kinds[back]), n, None)
    data, start = read(lo, lo + count), places[lo]
    out = np.empty((count, n), np.uint8)
    for i in range(count):
        at = lo + i
        out[i] = pgen_record(data[places[at] - start : places[at + 1] - start], int(kinds[at]), n, base)
        if not builds[at]:
            base = out[i]
    return out


# ---- BCF ----

WIDTHS = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
KINDS = {1: np.int8, 2: np.int16, 3: np.int32}


#: A header line of a dictionary entry, and each of its values.
ENTRY, VALUE = re.compile("##(contig|FORMAT|INFO|FILTER)=<(.*)>"), re.compile('(\\w+)=("[^"]*"|[^,]*)')


def bcf_header(f: BinaryIO) -> tuple[list[str], dict[int, str], list[str]]:
    """(contigs, names of the dictionary's keys, samples)."""
    start = exactly(f, 9)
    if not start.startswith(b"BCF\2"):
        raise BadFile("not a BCF2 file")
    text = exactly(f, struct.unpack_from("<I", start, 5)[0]).split(b"\0")[0].decode()
    entries = [(kind, dict(VALUE.findall(values))) for kind, values in ENTRY.findall(text)]
    contigs = [x["ID"] for kind, x in entries if kind == "contig"]
    keys = {0: "PASS"}
    for kind, x in entries:
        if kind != "contig" and x["ID"] not in keys.values():
            keys[int(x.get("IDX", len(keys)))] = x["ID"]
    samples = next((line.split("\t")[9:] for line in text.splitlines() if line.startswith("#CHROM")), [])
    return contigs, keys, samples


def bcf_marks(f: BinaryIO, every: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, count, place, bytes from there) of runs of records: `every` of them at most, or of about so many
    bytes. What is read is a BlockReader or a file that tells its place; records aren't decoded."""
    where = f.where if isinstance(f, BlockReader) else lambda: (f.tell(), 0)
    first, count, held, begin = 0, 0, 0, where()
    while head := f.read(1):
        length = sum(struct.unpack("<II", head + exactly(f, 7)))
        exactly(f, length)
        count, held = count + 1, held + length
        if count == every or held >= size:
            yield first, count, *begin
            first, count, held, begin = first + count, 0, 0, where()
    if count:
        yield first, count, *begin


def bcf_parts(f: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """The shared and the samples' part of each record."""
    while size := f.read(1):
        shared, own = struct.unpack("<II", size + exactly(f, 7))
        yield exactly(f, shared), exactly(f, own)


def typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(kind, length, place of the values)."""
    n, kind, at = data[at] >> 4, data[at] & 15, at + 1
    if n == 15:
        k = KINDS[data[at] & 15]
        n = int(np.frombuffer(data, k, 1, at + 1)[0])
        at += 1 + np.dtype(k).itemsize
    return kind, n, at


def bcf_records(f: BinaryIO, header: tuple[list[str], dict[int, str], list[str]]) -> Iterator[tuple[str, int, str, np.ndarray]]:
    """(chrom, pos, id, genotypes) of the records that follow."""
    contigs, keys, _ = header
    for shared, own in bcf_parts(f):
        chrom, pos = struct.unpack_from("<ii", shared, 0)
        n, n_formats = int.from_bytes(shared[20:23], "little"), shared[23]
        _, length, place = typed(shared, 24)
        g, at = np.full(n, MISSING, np.uint8), 0
        for _ in range(n_formats):
            kind, _, value = typed(own, at)
            key = int(np.frombuffer(own, KINDS[kind], 1, value)[0])
            kind, per, value = typed(own, value + WIDTHS[kind])
            at = value + n * per * WIDTHS[kind]
            if keys.get(key) == "GT" and kind in KINDS and at <= len(own):
                g = called(np.frombuffer(own, KINDS[kind], n * per, value).reshape(n, per))
        yield contigs[chrom] if chrom < len(contigs) else str(chrom), pos + 1, shared[place : place + length].decode(), g


def called(raw: np.ndarray) -> np.ndarray:
    """Genotypes of a typed vector of alleles: two are counted, one is doubled, more than 2 is missing."""
    ends = raw < -(2 ** (8 * raw.itemsize - 1)) + 8  # missing values and ends of vectors
    allele = (raw.astype(np.int64) >> 1) - 1
    first = allele[:, 0]
    haploid = np.ones(len(raw), bool) if raw.shape[1] == 1 else ends[:, 1]
    total = np.where(haploid, 2 * first, first + (allele[:, 1] if raw.shape[1] > 1 else 0))
    bad = (first < 0) | ends[:, 0] | (total > 2) | (~haploid & (allele[:, min(1, raw.shape[1] - 1)] < 0))
    return np.where(bad, MISSING, total).astype(np.uint8)
