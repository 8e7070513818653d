"""Helpers shared by the operators: tables, durable cuts of the lineage, Arrow batches of bounded
size, bounded joins, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import durable

#: A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

#: Words of 64 bits of a filter of keys, which is broadcast.
FILTER_WORDS = 1 << 17

#: Vertices of more neighbours are looked up by broadcast, if they were counted to be few.
MANY_NEIGHBOURS = 1000
#: Rows of two keys that a partition of the component search holds at least, if there are so many.
NARROW_ROWS = 100_000
#: Bytes of an Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

#: White space between words: ASCII only, as the word definition of the queries has it.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What operators keep from task to task in a worker process: for each module a function that lets go of it and
#: says whether there was anything.
STORES: dict[str, Callable[[], bool]] = {}


def let_go(owner: str) -> None:
    """Give back the memory that other operators' tasks left in this worker process, as workers are used again
    by the next stages of a job."""
    if any([clear() for name, clear in STORES.items() if name != owner]):
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
            ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches that are bounded by bytes as well as by rows, so that
    long texts don't add up in a task."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    own = conf.get(name, None)
    if own is None or not 0 < int(re.sub(r"\D", "", own) or 0) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    owner = run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def with_text(docs: DataFrame, kept: list[str], text: str) -> tuple[DataFrame, int]:
    """The kept columns, by whatever names, with the text among them or after them, and its place."""
    columns = [F.col(f"`{c}`") for c in kept]
    if text in kept:
        return docs.select(*columns), kept.index(text)
    return docs.select(*columns, F.col(f"`{text}`").alias("__text")), len(kept)


def slices(batch: pa.RecordBatch, place: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and bytes of the column at `place`, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, counted without reading further."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def told(rows: DataFrame, facts: DataFrame, key: str, times: str = "times") -> DataFrame:
    """rows with the facts of their key, null where there are none; facts has one row for each key,
    with the number of its rows in the column `times`, which is left out.

    Keys of very many rows are few; when counted to be, their facts are broadcast, so that their rows
    don't meet in one task.
    """
    many = F.col(times) > MANY_NEIGHBOURS
    hot = facts.where(many).drop(times)
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(facts.drop(times), key, "left")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~many).drop(times), key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def sifted(rows: DataFrame, keys: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of `keys`, and those whose key is surely none, so that the latter need not be
    moved to a join with them. Both sides have the columns `key`, as bigint.

    Each key sets one bit of a filter of at most FILTER_WORDS words. The more keys there are, the more other
    rows count as possible ones, up to all of them; none of a key is ever missed.
    """
    word, bit = F.shiftrightunsigned("_h", 6) % FILTER_WORDS, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_h").bitwiseAND(63).cast("int"))
    filled = keys.select(F.xxhash64(*key).alias("_h")).groupBy(word.alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    seen = rows.withColumn("_h", F.xxhash64(*key)).withColumn("_at", word).join(F.broadcast(filled), F.col("_at") == F.col("_w"), "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return seen.where(may).select(*rows.columns), seen.where(~may).select(*rows.columns)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many narrow rows, in no more partitions than they fill, but enough for all cores.

    A task leaves files in every shuffle and checkpoint, however few rows it has, so that many steps over
    small tables in many partitions take far more disk than the rows do.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / NARROW_ROWS)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex of `edges`.

    Alternating large-star and small-star steps, each one shuffle by vertex with a partial minimum
    first. The neighbours above a vertex would all go to one task of the join that tells them the
    minimum, and the middle of a star has very many. Such vertices are few (each takes
    MANY_NEIGHBOURS rows), so, when counted to be, their minima are broadcast and their rows don't
    move. Edges that lead to the least vertex of each star, as those of `lowest` do, leave few
    neighbours below any vertex. The work is linear in the edges and the number of rounds
    logarithmic in the longest path. The edges are counted, and every step has as many partitions as
    they fill. Nothing but counts reaches the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = durable(e)
    n = e.count()
    e = packed(e, n)
    state = None
    while True:
        # large-star: every neighbour above u is linked to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(packed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree")), n))
        hot = least.where(F.col("degree") > MANY_NEIGHBOURS).select(F.col("u").alias("_u"), F.col("m").alias("_m"))
        above = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        if 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            marked = above.join(F.broadcast(hot), F.col("u") == F.col("_u"), "left")
            told = marked.where(F.col("_u").isNotNull()).select("v", F.col("_m").alias("m"))
            told = told.union(marked.where(F.col("_u").isNull()).select("u", "v").join(least.where(F.col("degree") <= MANY_NEIGHBOURS), "u").select("v", "m"))
        else:
            told = above.join(least, "u").select("v", "m")
        large = packed(packed(told, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        # small-star: every neighbour at or below u is linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            packed(large.join(low, "u"), n)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = durable(packed(small, n))
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20)"))).first())
        if now == state:
            break
        state, n = now, now[0]
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def lowest(root: np.ndarray) -> np.ndarray:
    """Labels of groups, each replaced by the least place in its group."""
    low = np.full(len(root), len(root))
    np.minimum.at(low, root, np.arange(len(root)))
    return low[root]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal `key`, and the bounds of the groups in each, from rows sorted by it."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        k = t.column(key).to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if not len(change):
            rest = t
            continue
        yield t.slice(0, change[-1]), np.concatenate([[0], change])
        rest = t.slice(change[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


#: Fixed values of a mixing step for 64-bit numbers.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
U30, U27, U31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers dealt evenly, each to another."""
    x = (x ^ (x >> U30)) * MIX[0]
    x = (x ^ (x >> U27)) * MIX[1]
    return x ^ (x >> U31)
