"""Secrets in whole texts, also below nested encodings.

A worklist holds the layers of one text. Each layer is scanned for secrets and for encoded parts
(percent escapes, Unicode escapes and character references, base64, compressed bytes); what a part
decodes to is a new layer, until no layer gives a new one. A layer seen before, by its digest, is not
taken up again, so a part that decodes to itself ends. Every layer carries, for each of its
characters, the span of the original text that it came from, so all findings are spans of the
original. The same content at two places is two layers.

Escapes of percent signs (%252541) are taken off down to the last in one step, as the layers between
differ in nothing but how many there are: a text of them costs one layer and not one for each. An
escaped byte that is no text stands as a mark in its layer and cuts nothing else. Compressed layers within
each other are taken off one after the other, however many they are, until one has been there before.
Those of more than WINDOW_BYTES are gone through as streams, all at once, and the last one's bytes are
scanned window by window, so parts of any size are scanned whole in bounded memory; what overlaps two
windows is found if it is no longer than OVERLAP. Text of two bytes a character, and raw deflate streams
that end where their bytes do, are layers too.

Defined results: a null text counts as empty and has no spans; spans are code points with an
exclusive end, sorted by start, then kind as listed in KINDS, then end; equal spans of a kind are
given once; repeated rows each keep their row; input columns stay, except one named as the output
column, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, with_text

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed part that are held, and of the windows in which a longer one is scanned; of what each
#: window shares with the next; and of the pieces in which streams are unpacked.
WINDOW_BYTES, OVERLAP, PIECE = 4 << 20, 1 << 18, 1 << 16
#: Rows, and bytes of text, that are scanned before they go back to Spark.
SLICE, SLICE_BYTES = 512, 2 << 20

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("base", T.BooleanType(), False),
        T.StructField("layer", T.StringType(), False),
    ]
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("layer", pa.string())]))


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # runs are whole, so this is every run of 24 and more
HINTS = ("passw", "secret", "token", "api")

PERCENT = re.compile("(?:%(?:25)*[0-9A-Fa-f]{2})+")
PERCENT_UNIT = re.compile("%(?:25)*([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|apos|amp|lt|gt|equals|colon|lowbar|sol|plus);")
#: A run of either alphabet, with the lines that follow it at once.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile("[A-Za-z0-9+/_-]+")
STANDARD = str.maketrans("-_", "+/")
#: How compressed bytes may begin in base64, at the start or after what may be a separator.
MAGIC = re.compile("(?:^|(?<=[+/_-]))(?:H4sI|e[A-P]|Qlpo|KLUv)|[/_]Td6")
#: Text within other bytes; a shorter one holds neither a secret nor an encoded one.
INNER = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the secrets that stand in a text as it is."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """A text with the original span of each of its characters, or one span for all of them, as
    compressed parts have; neither: the original itself."""

    text: str
    name: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    span: tuple[int, int] | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.span:
            return self.span
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.starts, self.ends


def format_of(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return next((name for start, name in ((b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd")) if data.startswith(start)), None)


DECOMPRESSORS = {
    "gzip": lambda: zlib.decompressobj(31),
    "zlib": zlib.decompressobj,
    "deflate": lambda: zlib.decompressobj(-15),
    "bz2": bz2.BZ2Decompressor,
    "xz": lzma.LZMADecompressor,
    "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(),
}
UNREADABLE = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)
#: Bytes that tell a format, and bytes of zstd that are given at a time, as it bounds no output.
MAGIC_BYTES, ZSTD_PIECE = 6, 256


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Unpacker:
    """A compressed stream, member after member, fed and read in pieces."""

    def __init__(self, name: str) -> None:
        self.name, self.stream, self.waiting = name, DECOMPRESSORS[name](), b""
        self.between = self.ended = False

    def read(self) -> bytes:
        """The next bytes, about PIECE of them at most; none if it has ended or needs more."""
        try:
            while not self.ended:
                if self.between:
                    self.waiting = self.waiting.lstrip(b"\x00")
                    if format_of(self.waiting) != self.name:
                        self.ended = len(self.waiting) >= MAGIC_BYTES
                        return b""
                    self.stream, self.between = DECOMPRESSORS[self.name](), False
                if self.name == "zstd":
                    data, rest = self.waiting[:ZSTD_PIECE], self.waiting[ZSTD_PIECE:]
                    out = self.stream.decompress(data) if data else b""
                else:
                    data, rest = self.waiting, b""
                    out = self.stream.decompress(data, PIECE)
                self.waiting = rest or getattr(self.stream, "unconsumed_tail", b"")
                if self.stream.eof:
                    self.waiting = self.stream.unused_data + rest
                    self.between, self.ended = self.name != "deflate", self.name == "deflate"
                if out or (not self.waiting and not self.stream.eof):
                    return out
        except UNREADABLE:
            self.ended = True
        return b""


def flow(data: bytes, chain: list[Unpacker]) -> Iterator[tuple[int, bytes]]:
    """(place in the chain, bytes) of what each unpacker gives, the next one fed with it; no bytes when no
    more comes, unless the chain has grown by then. The deepest that can go on does, so no more than a piece waits at each."""
    at = 0
    while True:
        for i in range(len(chain) - 1, -1, -1):
            if out := chain[i].read():
                if i + 1 < len(chain) and not chain[i + 1].ended:
                    chain[i + 1].waiting += out
                yield i, out
                break
        else:
            if at < len(data) and not chain[0].ended:
                chain[0].waiting += data[at : at + PIECE]
                at += PIECE
                continue
            n = len(chain)
            yield n - 1, b""
            if len(chain) <= n:
                return


def unpacked(data: bytes, name: str) -> bytes | None:
    """What a stream holds, if it is no more than WINDOW_BYTES; a raw stream has to end where the data do."""
    parts, size, u = [], 0, Unpacker(name)
    for _, out in flow(data, [u]):
        parts.append(out)
        size += len(out)
        if size > WINDOW_BYTES:
            return None
    return b"" if name == "deflate" and (not u.stream.eof or u.waiting) else b"".join(parts)


def outputs(data: bytes, names: list[str]) -> list[bytes]:
    """A digest of all that each unpacker of a chain gives."""
    hashes = [hashlib.blake2b(digest_size=16) for _ in names]
    for i, out in flow(data, [Unpacker(n) for n in names]):
        hashes[i].update(out)
    return [h.digest() for h in hashes]


def streamed(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """(formats taken off, bytes) of a stream too long to be held, in windows that overlap: through as many
    unpackers at once as there are layers, so only bytes of the last one are windows. A layer that is one
    of the outer ones again, to the last byte, is not opened."""
    chain, heads = [Unpacker(name)], [digest(data[:PIECE])]
    begun = b""  # what the last unpacker gave before it is told what that is
    trial: bytes | None = None  # what the newest unpacker was fed before it gave anything
    plain = False  # the last one's bytes are no stream
    held = b""

    def opened_as_stream(start: bytes) -> bool:
        inner = format_of(start)
        if inner is None:
            return False
        if digest(start[:PIECE]) in heads:
            every = [digest(data), *outputs(data, [u.name for u in chain])]
            if every[-1] in every[:-1]:
                return False
        heads.append(digest(start[:PIECE]))
        chain.append(Unpacker(inner))
        chain[-1].waiting = start
        return True

    fresh = False
    for i, out in flow(data, chain):
        more = b""
        if trial is not None and i == len(chain) - 2:
            trial += out
            if chain[-1].ended or len(trial) > WINDOW_BYTES:  # it was no stream
                chain.pop()
                more, trial, plain = trial, None, True
        elif i == len(chain) - 1:
            if out:
                trial = None
            if not out and trial is not None:
                chain.pop()
                more, trial, plain = trial, None, True
            elif plain:
                more = out
            else:
                begun += out
                if begun and (len(begun) >= PIECE or not out):
                    if opened_as_stream(begun):
                        trial = begun
                    else:
                        more, plain = begun, True
                    begun = b""
        if more:
            held, fresh = held + more, True
            if len(held) >= WINDOW_BYTES:
                yield "".join(f">{u.name}" for u in chain), held
                held, fresh = held[-OVERLAP:], False
    if fresh:
        yield "".join(f">{u.name}" for u in chain), held


def as_text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def wide_text(data: bytes) -> str | None:
    """Text of two bytes a character, told by its mark or by many zero bytes at every other place."""
    if len(data) < 8 or len(data) % 2 or b"\x00" not in data:
        return None
    zeros = [data[i::2].count(0) for i in (0, 1)]
    code = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-le" if zeros[1] * 8 > len(data) > zeros[0] * 40 else "utf-16-be" if zeros[0] * 8 > len(data) > zeros[1] * 40 else None
    try:
        return data.decode(code) if code else None
    except UnicodeDecodeError:
        return None


def opened(data: bytes) -> Iterator[tuple[str, str]]:
    """(formats taken off, text) of bytes that are text or compressed bytes. Layer after layer is taken
    off, whatever their number, until one is no stream or has been there before, by its digest; from a
    layer of more than WINDOW_BYTES on, the layers are gone through as streams. Bytes that were
    compressed are scanned whatever they are."""
    names: list[str] = []
    seen = {digest(data)}
    while True:
        name = format_of(data)
        out = unpacked(data, name) if name else b""
        text = None
        if name is None or out == b"":
            wide = wide_text(data)
            if wide is not None:
                yield "".join([*names, ">utf-16"]), wide
                return
            text = as_text(data)
            if text is None and data:
                name = "deflate"
                out = unpacked(data, name)
        if out is None:
            for formats, window in streamed(data, name):
                yield "".join([*names, formats]), window.decode(errors="replace")
            return
        if out == b"":
            if text is None and names:
                text = data.decode(errors="replace")
            if text:
                yield "".join(names), text
            return
        names.append(f">{name}")
        data = out
        if digest(data) in seen:
            return
        seen.add(digest(data))


def byte_ends(text: str) -> np.ndarray:
    """For each character, the count of UTF-8 bytes up to its end."""
    return np.cumsum([len(c.encode()) for c in text]) if not text.isascii() else np.arange(1, len(text) + 1)


def marked_bytes(data: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text, one mark for each that is none, and the count of bytes up to each character's end."""
    text = data.decode(errors="surrogateescape")
    if text.isascii():
        return text, np.arange(1, len(data) + 1)
    ends = np.cumsum([1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text])
    return re.sub("[\udc80-\udcff]", "\ufffd", text), ends


def escape_text(x: str) -> str | bytes:
    if x[0] == "&":
        return html.unescape(x)
    if x[1] == "x":
        return bytes.fromhex(x[2:].replace("\\x", ""))
    if x[1:3] == "u{":
        n = int(x[3:-1], 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else x
    if len(x) == 12:
        return (bytes.fromhex(x[2:6]) + bytes.fromhex(x[8:])).decode("utf-16-be")
    n = int(x[2:], 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else x


def replaced(layer: Layer, pattern: re.Pattern, unit: re.Pattern | None, name: str, decode) -> Iterator[Layer]:
    """The layer with all its escapes taken off, and a layer for each run that holds compressed text.
    unit: how each byte of a run of bytes is written, if not in equal lengths."""
    found = list(pattern.finditer(layer.text))
    if not found:
        return
    mapped = layer.span is None
    if mapped:
        s, e = layer.maps()
    texts, starts, ends, at = [], [], [], 0
    for m in found:
        a, b = m.span()
        new = decode(m.group())
        if isinstance(new, bytes):
            got = new
            if format_of(got):
                for formats, text in opened(got):
                    if formats:
                        yield Layer(text, f"{layer.name}>{name}{formats}", span=layer.origin(a, b))
            new, stop = marked_bytes(got)
            if mapped:
                if unit:
                    edges = np.fromiter((x.end() for x in unit.finditer(layer.text, a, b)), np.int64, len(got))
                else:
                    edges = a + np.arange(1, len(got) + 1) * ((b - a) // len(got))
                last = edges[stop - 1]  # where each character's last byte ends
                new_s, new_e = s[np.concatenate([[a], last[:-1]])], e[last - 1]
        elif mapped:
            new_s, new_e = np.full(len(new), s[a:b].min()), np.full(len(new), e[a:b].max())
        texts += [layer.text[at:a], new]
        if mapped:
            starts += [s[at:a], new_s]
            ends += [e[at:a], new_e]
        at = b
    texts.append(layer.text[at:])
    if mapped:
        yield Layer("".join(texts), f"{layer.name}>{name}", np.concatenate([*starts, s[at:]]), np.concatenate([*ends, e[at:]]))
    else:
        yield Layer("".join(texts), f"{layer.name}>{name}", span=layer.span)


def line_groups(m: re.Match) -> Iterator[list[tuple[int, int]]]:
    """The lines of a match: those of equal width together with a last one that is no longer."""
    group: list[tuple[int, int]] = []
    for x in LINE.finditer(m.string, *m.span()):
        if group:
            width, last = group[0][1] - group[0][0], group[-1][1] - group[-1][0]
            if last < width or x.end() - x.start() > width:
                yield group
                group = []
        group.append(x.span())
    yield group


def debased(run: str) -> bytes:
    n = len(run) - (len(run) % 4 == 1)
    return binascii.a2b_base64(run[:n] + "=" * (-n % 4))


def opens(layer: Layer, lines: list[tuple[int, int]]) -> bool:
    return next(opened(debased("".join(layer.text[a:b] for a, b in lines).translate(STANDARD))), None) is not None


def opened_run(layer: Layer, lines: list[tuple[int, int]]) -> Iterator[Layer]:
    """Layers for what the base64 of these lines holds: all of it, or else the compressed parts that
    begin after a separator, and the texts within it at any offset."""
    run = "".join(layer.text[a:b] for a, b in lines)
    if len(run) < 16:
        return
    if layer.span is None:
        at = np.concatenate([np.arange(a, b) for a, b in lines])
        s, e = layer.maps()
        s, e = s[at], e[at]
    code = run.translate(STANDARD)

    def mapped(text: str, phase: int, skip: int) -> Layer:
        if layer.span:
            return Layer(text, f"{layer.name}>base64", span=layer.span)
        stop = byte_ends(text) + skip
        first = np.concatenate([[skip], stop[:-1]]) if len(text) else stop
        last = stop - 1
        return Layer(text, f"{layer.name}>base64", s[phase + first // 3 * 4 + first % 3], e[phase + last // 3 * 4 + last % 3 + 1])

    def whole(got: tuple[str, str], start: int) -> Layer:
        return Layer(got[1], f"{layer.name}>base64{got[0]}", span=layer.span or (int(s[start:].min()), int(e[start:].max())))

    data = debased(code)
    found = False
    for got in opened(data):
        found = True
        yield whole(got, 0) if got[0] else mapped(got[1], 0, 0)
    if found:
        return
    for m in MAGIC.finditer(run):
        i = m.start()
        if i and (code[i] != "e" or int.from_bytes(debased(code[i : i + 4])[:2]) % 31 == 0):
            for got in opened(debased(code[i:])):
                if got[0]:
                    yield whole(got, i)
    for phase in range(4):
        for m in INNER.finditer(data if not phase else debased(code[phase:])):
            try:
                yield mapped(m.group().decode(), phase, m.start())
            except UnicodeDecodeError:
                continue


def unbased(layer: Layer) -> Iterator[Layer]:
    """Layers for the base64 parts that hold text or compressed text."""
    for m in BASE64.finditer(layer.text):
        for group in line_groups(m):
            rest: list[tuple[int, int]] = []
            # a shorter last line may be what follows the part
            if len(group) > 1 and not opens(layer, group) and opens(layer, group[:-1]):
                group, rest = group[:-1], group[-1:]
            found = list(opened_run(layer, group))
            if not found and len(group) > 1:
                rest = group
            yield from found
            for line in rest:
                yield from opened_run(layer, [line])


def percent_bytes(x: str) -> bytes:
    return bytes.fromhex("".join(PERCENT_UNIT.findall(x)))


def known_by(layer: Layer) -> tuple[bytes, int, int]:
    """A digest of the layer's text, and the part of the original that it came from."""
    return hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.origin(0, len(layer.text))


def below(layer: Layer) -> Iterator[Layer]:
    """The layers that a layer's encoded parts give."""
    if "%" in layer.text:
        yield from replaced(layer, PERCENT, PERCENT_UNIT, "url", percent_bytes)
    if "\\" in layer.text or "&" in layer.text:
        yield from replaced(layer, ESCAPE, None, "unicode", escape_text)
    yield from unbased(layer)


def spans(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, layer) of all secrets of a text, in the defined order."""
    if not text:
        return []
    found: dict[tuple[int, int, int], tuple[bool, str]] = {}
    work, seen = [iter([Layer(text, "text")])], set()
    while work:  # depth first, layers made as they are taken up: what is held is one layer of each depth
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text and (key := known_by(layer)) not in seen:
            seen.add(key)
            for kind, a, b in matches(layer.text):
                lo, hi = layer.origin(a, b)
                found.setdefault((lo, kind, hi), (layer.name == "text", layer.name))
            work.append(below(layer))
    return [(KINDS[k], lo, hi, base, name) for (lo, k, hi), (base, name) in sorted(found.items())]


def redacted(text: str, found: list[tuple[str, int, int, bool, str]], mark: str = "[SECRET]") -> str:
    """The text with `mark` in place of each run of overlapping spans."""
    out, at = [], 0
    for _, a, b, *_ in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", into: str = "spans", clean: str | None = None) -> DataFrame:
    """docs with all secrets of each whole text, and if `clean` is named, the text without them.

    Every row is scanned where it is read; nothing is shuffled.
    """
    new = [c for c in (into, clean) if c]
    kept = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept]).add(into, T.ArrayType(SPAN, False), False)
    if clean:
        schema.add(clean, T.StringType())
    source, place = with_text(docs, kept, text)
    names = [f.name for f in SPAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, SLICE, SLICE_BYTES):
                texts = part.column(place).to_pylist()
                got = [spans(x) for x in texts]
                columns = [*part.columns[: len(kept)], pa.array([[dict(zip(names, x)) for x in g] for g in got], ARROW_SPANS)]
                if clean:
                    columns.append(pa.array([x if not g else redacted(x, g) for x, g in zip(texts, got)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return in_batches(source, run, schema)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
