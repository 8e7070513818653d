"""Byte-pair encoding and decoding of whole texts with a word-end vocabulary.

Each word is held as one contiguous array of part ids beside an array of the ranks of adjacent
pairs. The merge loop scans the ranks for the minimum, deletes that boundary and refreshes the two
neighbouring ranks. Words of more than LONG parts keep the same order of merges in a heap, so that
a text without white space costs n log n and not n squared.

Defined results: a null text counts as empty and gives no ids and an empty decoded text; repeated
rows each keep their own row; columns of the input stay unless they have the name of an output
column, which then is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import STORES, in_batches, slices, with_text

LONG = 48
NEVER = 1 << 40
#: Distinct words, and distinct chunks between white space, whose ids a worker keeps twice: the
#: newest, and those before them, from which what is still in use moves up.
CACHE = 60_000
#: Rows, and bytes of text, that are encoded before they go back to Spark.
SLICE, SLICE_BYTES = 256, 1 << 20

# Unicode white space, and the word pattern of the vocabulary's file format.
SPACE = "\t-\r\x20\x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Recent(dict):
    """A bounded store of computed values: `make` is called for a key that is in neither half."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Encoder and decoder over the content of a vocabulary file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.names = {i: t for t, i in chain(vocab.items(), added.items())}
        self.ranks: dict[int, int] = {}  # by both ids in one number
        self.made: list[int] = []  # the merged id of each rank
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + self.end] for x in letters]
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.word = regex.compile(WORD)
        self.odd = re.compile("[\x1c-\x1f]")
        self.gap = re.compile(f"[{SPACE}]+")
        self.words, self.chunks = Recent(self.one_word), Recent(self.chunk)

    def merge(self, ids: list[int]) -> list[int]:
        """The parts of one word after every merge, lowest rank first and leftmost among equals."""
        if len(ids) > LONG:
            return self.merge_long(ids)
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        n = len(ranks)
        while n and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            n -= 1
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NEVER)
            if i < n:
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, rank, made = len(ids), self.ranks.get, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(ids[x] << 20 | ids[y], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def one_word(self, w: str) -> tuple[int, ...]:
        b = w.encode("utf-8", "surrogatepass")
        ids = [self.inner[x] for x in b]
        ids[-1] = self.final[b[-1]]
        return tuple(self.merge(ids))

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a normalised text without white space."""
        words = self.word.findall(text)
        return self.words[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(self.words.__getitem__, words)))

    def plain(self, text: str) -> Iterator[int]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each character for itself: no final sigma
        chunks = self.gap.split(text) if self.odd.search(text) else text.split()
        return chain.from_iterable(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return list(self.plain(text))
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if k % 2 else self.plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Names of the ids joined by a blank: the file names no decoder, so word ends stay visible."""
        return " ".join(map(self.names.__getitem__, ids))


_LOADED: dict[int, Vocabulary] = {}


def loaded(content: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    if (key := hash(content)) not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def forget() -> bool:
    held = bool(_LOADED)
    _LOADED.clear()
    return held


STORES[__name__] = forget


def read_vocabulary(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with its texts as token ids, and if `decoded` is named, with those ids decoded again.

    vocabulary: content of the tokenizer's file, whose size bounds what tasks receive. Each row is
    encoded where it is read; nothing is shuffled. Without keep_text the text is left out.
    """
    new = [c for c in (ids, decoded) if c]
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    schema = T.StructType([docs.schema[c] for c in kept])
    schema.add(ids, T.ArrayType(T.IntegerType(), False), False)
    if decoded:
        schema.add(decoded, T.StringType(), False)
    source, place = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(vocabulary)
        for batch in batches:
            for part in slices(batch, place, SLICE, SLICE_BYTES):
                got = [v.encode(x) for x in part.column(place).to_pylist()]
                columns = [*part.columns[: len(kept)], pa.array(got, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array(map(v.decode, got), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return in_batches(source, run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with its id lists as text; a null list gives an empty text."""
    kept = [c for c in tokens.columns if c != text]
    schema = T.StructType([tokens.schema[c] for c in kept]).add(text, T.StringType(), False)
    source, place = with_text(tokens, kept, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(vocabulary)
        for batch in batches:
            got = [v.decode(x or []) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(got, pa.string())], names=[*kept, text])

    return in_batches(source, run, schema)
