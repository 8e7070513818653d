"""Genotypes as blocks of variants, and passes over them for the iterative fits.

A block row holds up to block_rows variants of all samples as bytes. Blocks are made from the long
form, dealt by block once and cached as dealt, so they stay where they are. What a fit keeps for each
variant (P, its moments, its histories) is a second table keyed by block, which is joined to the
blocks in every pass: only that table moves, not the genotypes. Q is broadcast with the kernel. Sums
of the size of Q are added within each task, over all its blocks, and leave it once, in chunks that
are added across tasks. Sums of several numbers for each element of Q, as Hessians are, go no
further: the task that adds those of some samples solves for their new rows of Q. The driver holds
Q and never P.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.expr import MISSING
from ..sources.records import unpacked

CHUNK = 1 << 16
#: Passes after which the state's lineage is cut in the shared checkpoint folder, and passes whose
#: cached results are kept; older ones, if still wanted, are computed again.
CUT_EVERY, KEEP = 6, 8

Kernel = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray | None, list[np.ndarray]]]
#: Rows of Q from the sums of samples, the first of which has the number given.
Finish = Callable[[np.ndarray, int], np.ndarray]
#: Kinds of rows that a pass gives; rows of sums by sample have the count of numbers for a sample as kind.
STATE, SUMS = -1, 0


@dataclass
class Blocks:
    """Cached blocks (block, row0, g); state tables are (block, s) with s of shape (depth, rows, width)."""

    frame: DataFrame
    n_variants: int
    n_samples: int
    passes: int = field(default=0)
    cached: list[DataFrame] = field(default_factory=list)

    def run(self, kernel: Kernel, state: DataFrame | None, depth: int, width: int, shapes: list[tuple[int, ...]], finish: Finish | None = None) -> tuple[DataFrame, list[np.ndarray]]:
        """kernel(g, s, row0) gives a block's new state, or None to keep it, and arrays to be summed.
        Returns the new state table and the sums.

        With `finish`, the kernel's last array has a row for each sample and isn't among the shapes;
        finish(sums, first) makes rows of `width` of it where the sums are added, and these are
        returned in its place."""
        joined = self.frame.join(state, "block") if state is not None else self.frame.withColumn("s", F.lit(None).cast("binary"))
        n = self.n_samples

        def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, wide = None, None
            for p in parts:
                for block, row0, raw, s in zip(p["block"], p["row0"], p["g"], p["s"]):
                    g = np.frombuffer(raw, np.uint8).reshape(-1, n)
                    old = None if s is None else np.frombuffer(s).reshape(depth, len(g), width)
                    new, sums = kernel(g, old, int(row0))
                    kept = s if new is None else np.ascontiguousarray(new, float).tobytes()
                    if finish:
                        *sums, own = sums
                        wide = np.array(own, float) if wide is None else np.add(wide, own, out=wide)
                    if sums:
                        flat = np.concatenate([np.asarray(x, float).ravel() for x in sums])
                        total = flat if total is None else np.add(total, flat, out=total)
                    yield pd.DataFrame({"kind": [STATE], "block": [block], "s": [kept], "at": [-1], "x": [None]})
            for at in range(0, 0 if total is None else len(total), CHUNK):
                yield pd.DataFrame({"kind": [SUMS], "block": [-1], "s": [None], "at": [at], "x": [total[at : at + CHUNK].tobytes()]})
            each = CHUNK if wide is None else max(1, CHUNK // wide.shape[1])
            for at in range(0, 0 if wide is None else n, each):
                yield pd.DataFrame({"kind": [wide.shape[1]], "block": [-1], "s": [None], "at": [at], "x": [wide[at : at + each].tobytes()]})

        out = joined.select("block", "row0", "g", "s").mapInPandas(one, "kind int, block long, s binary, at long, x binary")
        self.passes += 1
        if self.passes % CUT_EVERY == 0:
            out = durable(out)
        else:
            out = out.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached.append(out)
        sums = self.added(out.where(F.col("kind") != STATE).select("kind", "at", "x"), shapes, width, finish)
        while len(self.cached) > KEEP:
            self.cached.pop(0).unpersist()
        return out.where(F.col("kind") == STATE).select("block", "s"), sums

    def added(self, sums: DataFrame, shapes: list[tuple[int, ...]], width: int, finish: Finish | None) -> list[np.ndarray]:
        sizes = [int(np.prod(s)) for s in shapes]
        out, finished = np.zeros(sum(sizes)), np.zeros((self.n_samples, width))

        def across(p: pd.DataFrame) -> pd.DataFrame:
            # added in the order of their bytes, so that the order of arrival has no say
            kind, at = int(p["kind"].iloc[0]), int(p["at"].iloc[0])
            x = np.sum([np.frombuffer(x) for x in sorted(p["x"])], axis=0)
            if kind > SUMS:
                x = np.ascontiguousarray(finish(x.reshape(-1, kind), at), float)
            return pd.DataFrame({"kind": [kind], "at": [at], "x": [x.tobytes()]})

        for r in sums.groupBy("kind", "at").applyInPandas(across, "kind int, at long, x binary").collect():
            part = np.frombuffer(r["x"])
            if r["kind"] > SUMS:
                part = part.reshape(-1, width)
                finished[r["at"] : r["at"] + len(part)] = part
            else:
                out[r["at"] : r["at"] + len(part)] = part
        ends = np.cumsum([0, *sizes])
        return [*(out[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes)), *([finished] if finish else [])]

    def rows(self, state: DataFrame, depth: int, width: int, name: str = "p") -> DataFrame:
        """(variant_id, name): the first layer of a state as an array for each variant."""

        def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for row0, s in zip(p["row0"], p["s"]):
                    x = np.frombuffer(s).reshape(depth, -1, width)[0]
                    yield pd.DataFrame({"variant_id": np.arange(row0, row0 + len(x)), name: list(x)})

        return self.frame.select("block", "row0").join(state, "block").select("row0", "s").mapInPandas(one, f"variant_id long, {name} array<double>")

    def state_of(self, rows: DataFrame, width: int, name: str = "p", block_rows: int = 512) -> DataFrame:
        """A state of depth 1 from (variant_id, array)."""
        keyed = rows.select(F.floor(F.col("variant_id") / block_rows).alias("block"), F.col("variant_id").cast("long").alias("v"), F.col(name).alias("x"))

        def pack(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("v")
            return pd.DataFrame({"block": [p["block"].iloc[0]], "s": [np.array(p["x"].tolist(), float).tobytes()]})

        return keyed.groupBy("block").applyInPandas(pack, "block long, s binary")


def to_blocks(geno: DataFrame, n_variants: int, n_samples: int, block_rows: int = 512) -> Blocks:
    """Blocks of a long form whose variant_id and sample_id are dense indices from 0; a pair without
    a row is missing. A group is one block: block_rows times the number of samples."""
    v = F.col("variant_id").cast("long")
    keyed = geno.select(F.floor(v / block_rows).alias("block"), (v % block_rows).cast("int").alias("r"), F.col("sample_id").cast("int").alias("c"), F.col("g").cast("int").alias("g"))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        row0 = int(p["block"].iloc[0]) * block_rows
        g = np.full((min(block_rows, n_variants - row0), n_samples), MISSING, np.uint8)
        g[p["r"].to_numpy(), p["c"].to_numpy()] = p["g"].to_numpy()
        return pd.DataFrame({"block": [p["block"].iloc[0]], "row0": [row0], "g": [g.tobytes()]})

    parts = int(geno.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = keyed.groupBy("block").applyInPandas(pack, "block long, row0 long, g binary").repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(frame, n_variants, n_samples)


def packed_blocks(packed: DataFrame, n_variants: int, n_samples: int, block_rows: int = 512) -> Blocks:
    """Blocks of packed rows (variant_id, n, bits) as read from files, which are never spread out into a
    row for each genotype. Variants are dense indices from 0; one without a row is missing."""
    keyed = packed.select(F.floor(F.col("variant_id") / block_rows).alias("block"), F.col("variant_id").cast("long").alias("v"), "bits")

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        row0 = int(p["block"].iloc[0]) * block_rows
        g = np.full((min(block_rows, n_variants - row0), n_samples), MISSING, np.uint8)
        g[p["v"].to_numpy() - row0] = unpacked(b"".join(p["bits"]), n_samples)
        return pd.DataFrame({"block": [p["block"].iloc[0]], "row0": [row0], "g": [g.tobytes()]})

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = keyed.groupBy("block").applyInPandas(pack, "block long, row0 long, g binary").repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(frame, n_variants, n_samples)


def q_rows(spark, q: np.ndarray) -> DataFrame:
    """Q as (sample_id, q)."""
    return spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(len(q)), "q": q.tolist()}), "sample_id long, q array<double>")
