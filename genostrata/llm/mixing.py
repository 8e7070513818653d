"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by a keyed hash. A source's target in words becomes an
exact quota of block draws: every block once for each whole pass over the source, then blocks in a
keyed random order up to the one in which the target is reached, of which documents are drawn in
keyed random order up to the target. The quotas of all sources are partitioned recursively among
the output shards: each node of a binary tree splits its vector of quotas between its halves by one
multivariate hypergeometric draw, so every shard gets a random mix with exact totals. Along with
its quota each node carries where its draws begin, so the leaves name disjoint runs of each
source's permuted draws. Rows of a shard are ordered by a keyed hash.

What grows with the data stays on the executors. The driver holds one row for each source, at most
MOST_SOURCES of them; more raise an error. Blocks are of about BLOCK_WORDS words however large a
source is; their order and running totals are found in two steps, within groups of blocks and then
over the groups, so no task sees all blocks of a source.

Nothing depends on how the rows are partitioned: sources are in the order of their names, and all
keys are hashes of names and ids.

Defined results: null sizes and null texts count 0 words, and such documents go with their block;
a null source is a source of its own; all rows of equal doc_id and source fall into one block and
are drawn alike; a source of size 0 takes nothing, and its weight goes to the others; an empty
table gives an empty mix; columns of the input stay, apart from those named as the output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, durable

MOST_SOURCES = 100_000
#: Words of a block.
BLOCK_WORDS = 20_000
#: Shards of the splitting tree that a task computes.
TASK_SHARDS = 1024
#: Words of an output shard.
SHARD_WORDS = 4_000_000
#: No document is drawn more often.
MOST_PASSES = 2
ORDER = "position"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """Words of each source: by weight, none above MOST_PASSES times its size, the excess reshared."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, cap, free = np.zeros(len(sizes)), MOST_PASSES * sizes, np.ones(len(sizes), bool)
    left = share * sizes.sum()
    while free.any() and left > 0:
        level = left * weights[free] / weights[free].sum()
        above = level > cap[free]
        if not above.any():
            out[free] = level
            break
        at = np.flatnonzero(free)[above]
        out[at] = cap[at]
        left -= cap[at].sum()
        free[at] = False
    return out


def split(quota: np.ndarray, shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, begin, count) for the shards from first to last: draws of each source, by the tree.

    Every node's draw has a generator of its own, so any part of the tree can be computed alone.
    """

    def node(lo: int, hi: int, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, begin, count
            return
        mid = (lo + hi) // 2
        total = int(count.sum())
        part = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(count, part, method="marginals") if total else count * 0
        yield from node(lo, mid, begin, left)
        yield from node(mid, hi, begin + left, count - left)

    yield from node(0, shards, np.zeros(len(quota), np.int64), np.asarray(quota, np.int64))


def hashed(seed: int, *what: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def mix(
    docs: DataFrame,
    weight_of: dict[str | None, float],
    share: float,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Rows of docs as often as the mix takes them, with shard, pass_no, position and its source's
    source_size and target; a row with shard null was not taken (once for each such row).

    docs must have the size of each row in words. The rows come as they stand; `write_order` puts
    them into shards.
    """
    spark = docs.sparkSession
    known = docs.groupBy(F.col(source).alias("s")).agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("words"))
    found = known.limit(MOST_SOURCES + 1).toPandas()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    size_of = {None if pd.isna(s) else s: int(n) for s, n in zip(found["s"], found["words"])}
    sources = in_order(list(size_of))
    words = np.array([size_of[s] for s in sources], np.int64)
    want = targets(words, np.array([weight_of[s] for s in sources], float), share)
    blocks = np.maximum(np.ceil(words / BLOCK_WORDS), 1).astype(np.int64)
    whole = np.minimum(np.floor(want / np.maximum(words, 1)), MOST_PASSES).astype(np.int64)
    rest = np.where(whole >= MOST_PASSES, 0.0, want - whole * words)
    plan = spark.createDataFrame(
        pd.DataFrame({"k": np.arange(len(sources)), "s": pd.Series(sources, dtype=object), "words": words, "target": want, "blocks": blocks, "whole": whole, "rest": rest}),
        "k long, s string, words long, target double, blocks long, whole long, rest double",
    ) if sources else spark.createDataFrame([], "k long, s string, words long, target double, blocks long, whole long, rest double")
    plan = F.broadcast(plan)  # at most MOST_SOURCES rows

    # the rows travel in one column, whatever their columns are named; what isn't needed of it is not read
    kept = [c for c in docs.columns if c not in ("shard", "pass_no", ORDER, "source_size", "target")]
    unit = hashed(seed, F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(source), F.lit("")))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(source).alias("_source"), F.coalesce(size, F.lit(0)).cast("long").alias("w"), unit.alias("_unit"))
    keyed = base.join(plan, F.col("_source").eqNullSafe(F.col("s"))).withColumn("_block", F.pmod(F.shiftright("_unit", 20), F.col("blocks")))
    narrow = durable(keyed.select("k", "_block", "_unit", "blocks", "whole", "rest", "w"))

    # blocks in keyed order, another one in every pass; a group is those with like beginnings of their keys
    tally = narrow.groupBy("k", "_block", "blocks", "whole", "rest").agg(F.sum("w").alias("bw"))
    passes = F.sequence(F.lit(0), F.least(F.col("whole"), F.lit(MOST_PASSES - 1)).cast("int"))
    each = tally.withColumn("pass_no", F.explode(passes)).where("pass_no < whole or rest > 0")
    each = each.join(plan.select("k", "s"), "k").withColumn("_order", hashed(seed + 1, F.coalesce("s", F.lit("")), F.col("s").isNull(), F.col("pass_no").cast("long"), "_block"))
    each = durable(each.withColumn("_group", F.pmod("_order", F.ceil(F.sqrt("blocks")))).select("k", "pass_no", "_group", "_order", "_block", "bw", "whole", "rest"))
    groups = each.groupBy("k", "pass_no", "_group").agg(F.sum("bw").alias("gw"), F.count(F.lit(1)).alias("gn"))
    before = Window.partitionBy("k", "pass_no").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("k", "pass_no", "_group", F.coalesce(F.sum("gw").over(before), F.lit(0)).alias("g_words"), F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("g_rank"))
    inside = Window.partitionBy("k", "pass_no", "_group").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("iw", F.sum("bw").over(inside)).withColumn("ir", F.row_number().over(inside) - 1).join(groups, ["k", "pass_no", "_group"])
    placed = placed.withColumn("after", F.col("g_words") + F.col("iw")).withColumn("rank", F.col("g_rank") + F.col("ir"))

    # every block once for each whole pass; in the last, partial pass up to the block in which the target is reached
    last_pass = F.col("pass_no") >= F.col("whole")
    placed = placed.where(~last_pass | (F.col("after") - F.col("bw") < F.col("rest")))
    held = tally.groupBy("k").agg(F.count(F.lit(1)).alias("held"))
    draws = durable(
        placed.join(F.broadcast(held), "k").select(
            "k", "_block", "pass_no", (F.col("pass_no") * F.col("held") + F.col("rank")).alias("draw"), (last_pass & (F.col("after") > F.col("rest"))).alias("cut"), (F.col("rest") - F.col("after") + F.col("bw")).alias("room")
        )
    )
    # within that one block: the largest hash that still fits best
    inner = narrow.join(F.broadcast(draws.where("cut").select("k", "_block", "room")), ["k", "_block"]).groupBy("k", "_unit").agg(F.sum("w").alias("w"), F.first("room").alias("room"))
    along = Window.partitionBy("k").orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    last = inner.withColumn("after", F.sum("w").over(along)).where("after - w / 2.0D <= room").groupBy("k").agg(F.max("_unit").alias("_last"))

    quotas = draws.groupBy("k").count().toPandas()  # one row for each source
    quota = np.zeros(len(sources), np.int64)
    quota[quotas["k"].to_numpy(np.int64)] = quotas["count"].to_numpy(np.int64)
    shards = max(1, math.ceil(want.sum() / shard_words))

    def leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                lo, hi = int(pdf["id"].min()), int(pdf["id"].max()) + 1
                for shard, begin, count in split(quota, shards, seed, lo, hi):
                    at = np.flatnonzero(count)
                    yield pd.DataFrame({"k": at, "shard": shard, "begin": begin[at], "count": count[at]})

    runs = spark.range(0, shards, 1, max(1, math.ceil(shards / TASK_SHARDS))).mapInPandas(leaves, "k long, shard long, begin long, count long")
    dealt = draws.join(
        runs.select("k", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("count") - 1)).alias("draw")), ["k", "draw"]
    ).join(F.broadcast(last), "k", "left")

    until = F.when(F.col("cut"), F.coalesce("_last", F.lit(-(2**63))))
    drawn = dealt.select(F.col("k").alias("_k"), F.col("_block").alias("_b"), "pass_no", "shard", until.alias("_until"))
    taken = (F.col("k") == F.col("_k")) & (F.col("_block") == F.col("_b")) & (F.col("_until").isNull() | (F.col("_unit") <= F.col("_until")))
    return (
        keyed.select("_row", "k", "_block", "_unit", "words", "target")
        .join(drawn, taken, "left")
        .select(*(F.col(f"_row.`{c}`") for c in kept), F.col("words").alias("source_size"), "target", "shard", "pass_no", hashed(seed + 2, "_unit", "pass_no").alias(ORDER))
    )


def write_order(mixed: DataFrame, shards: int | None = None) -> DataFrame:
    """The taken rows of a mix, each shard together and shuffled within itself."""
    taken = mixed.where("shard is not null")
    return (taken.repartition(shards, "shard") if shards else taken.repartition("shard")).sortWithinPartitions("shard", ORDER)


def in_order(sources: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return [*sorted(s for s in sources if s is not None), *([None] if None in sources else [])]


def repeating_weights(sources: list[str | None], weights: tuple[float, ...]) -> dict[str | None, float]:
    """Weights repeated along the sources by code point, null last."""
    return {s: weights[i % len(weights)] for i, s in enumerate(in_order(sources))}


def source_names(docs: DataFrame, source: str = "source") -> list[str | None]:
    rows = docs.select(source).distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [r[0] for r in rows]
