"""Samples whose genotypes arrive in pieces, held in keyed state until they are whole, and then projected.

The state of a sample is two bits for each variant and one bit for whether it has come, so it doesn't
depend on how often or in which order the pieces arrive; a genotype that comes again replaces the one
before. A sample leaves the state once, when its last variant has come; what comes later is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expr import MISSING
from ..sources.genotypes import long_rows
from ..sources.records import packed, unpacked
from .projection import project_rows

WHOLE = "sample_id long, n int, bits binary"
HELD = "bits binary, seen binary, done boolean"


def whole_samples(arriving: DataFrame, n_variants: int) -> DataFrame:
    """(sample_id, n, bits) of each sample of a stream (sample_id, variant_id, g) when all of its variants, dense
    indices from 0, have come."""

    def take(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits, seen, done = state.get if state.exists else (b"", b"", False)
        if done:
            return
        g = unpacked(bytes(bits), n_variants)[0].copy() if bits else np.full(n_variants, MISSING, np.uint8)
        here = np.unpackbits(np.frombuffer(bytes(seen), np.uint8), count=n_variants).astype(bool) if seen else np.zeros(n_variants, bool)
        for p in pieces:
            at = p["variant_id"].to_numpy()
            g[at], here[at] = p["g"].to_numpy(), True
        if here.all():
            state.update((b"", b"", True))
            yield pd.DataFrame({"sample_id": [key[0]], "n": [n_variants], "bits": [packed(g[None])]})
        else:
            state.update((packed(g[None]), np.packbits(here).tobytes(), False))

    rows = arriving.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("variant_id").cast("long").alias("variant_id"), F.coalesce("g", F.lit(MISSING)).cast("int").alias("g"))
    return rows.groupBy("sample_id").applyInPandasWithState(take, WHOLE, HELD, "append", GroupStateTimeout.NoTimeout)


def project_whole(arriving: DataFrame, p: DataFrame, n_variants: int, path: str, checkpoint: str):
    """A running query that writes Q of each sample when it is whole, as Parquet in a folder for each batch; a batch
    that is repeated after a failure replaces its folder. p is (variant_id, p)."""

    def batch(rows: DataFrame, number: int) -> None:
        # variants take the place of samples in a packed row, so they are turned back
        long = long_rows(rows.select(F.col("sample_id").alias("variant_id"), "n", "bits"))
        turned = long.select(F.col("variant_id").alias("sample_id"), F.col("sample_id").cast("long").alias("variant_id"), "g")
        project_rows(turned, p).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return whole_samples(arriving, n_variants).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).start()
