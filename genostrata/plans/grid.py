"""Genotypes as a grid of tiles, and passes over them for fits of any number of samples.

A tile holds some variants of some samples, two bits for a genotype; neighbouring tiles make a part of
the grid, all of one part in one task. Tiles are dealt by part once and cached as dealt, so they stay
where they are. What a fit knows is one table of rows (kind, b, id): for each block of variants its rows
of P with all that belongs to them, for each chunk of samples its rows of Q, for each member b of a
batch of fits that go through the same passes (folds, starts). A pass sends each part of the grid the
rows it needs, each part adds up its own sums by block and by chunk, these are added in a tree, and the
task that adds the last ones makes the new rows from them. So nothing of all samples, or of all
variants, is ever in one place; the driver sees a few numbers for each member.

A grid of few variants can stand (`standing`): each row of Q has the genotypes of its chunk beside it and
stays where it is, so a pass moves sums by block alone, whatever the samples; the rows of P are on the driver.
"""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.expr import MISSING
from ..sources.records import packed, unpacked

#: Kinds of rows: of P by block, of Q by chunk, and sums that are no rows of either.
P, Q, SUMS = 0, 1, 2
STATE = "kind int, b int, id long, s binary, y binary"
PARTIAL = "kind int, b int, id long, part int, x binary, s binary, y binary"
#: Sums that one task adds up at a time; passes after which the lineage is cut, and cached states that are kept.
FAN, CUT_EVERY, KEEP = 16, 4, 6
#: Variants that a standing grid may have; new rows of Q after which its lineage is cut; chunks of a partition.
STANDING, CUT_STANDING, CHUNKS = 1024, 8, 4
#: Rows of a standing grid: of Q with the genotypes of the chunk, and sums.
PLACED = PARTIAL + ", g binary"


@dataclass(frozen=True)
class At:
    """Where a kernel is: the member of the batch, the tile, and its first variant and sample."""

    b: int
    block: int
    chunk: int
    row0: int
    col0: int
    labels: np.ndarray | None = None


#: What a tile adds to the sums of its variants, of its samples, and to those of all tiles, from the genotypes
#: and the layers that were sent of its variants and of its samples.
Kernel = Callable[[np.ndarray, np.ndarray | None, np.ndarray | None, At], tuple[np.ndarray | None, np.ndarray | None, list[float] | np.ndarray | None]]
#: The layers that are sent, the same for all members or by member.
Send = list[int] | list[list[int]]
#: New layers from the old ones and the sums (none in a pass without): (layers, sums, b, id, labels) to (layers, numbers to be added up or none).
Finish = Callable[[np.ndarray, np.ndarray | None, int, int, np.ndarray | None], tuple[np.ndarray, np.ndarray | None]]


class Frame:
    """Rows that are on the executors' disks as long as something refers to this: in memory, arrays of megabytes
    take far more of the heap than is counted."""

    def __init__(self, rows: DataFrame, age: int) -> None:
        self.rows, self.age = rows, age
        if age:
            rows.persist(StorageLevel.DISK_ONLY)
            weakref.finalize(self, let_go, rows)


def let_go(rows: DataFrame) -> None:
    if rows.sparkSession.sparkContext._jsc is not None:  # the session may have ended
        rows.unpersist()


@dataclass
class Placed:
    """A state of a standing grid: the rows of Q, those of P (s, y) by member and block, and sums by member and origin."""

    frame: Frame
    p: dict[tuple[int, int], tuple[bytes, bytes | None]]
    sums: dict[tuple[int, int], np.ndarray]


@dataclass
class Grid:
    """rows x cols genotypes in a tile, high x wide tiles in a part."""

    tiles: DataFrame
    n_variants: int
    n_samples: int
    rows: int
    cols: int
    high: int
    wide: int
    change: Callable[[np.ndarray, At], np.ndarray] | None = None
    passes: list[int] = field(default_factory=lambda: [0])
    cached: list[DataFrame] = field(default_factory=list)
    pinned: list[DataFrame] = field(default_factory=list)
    columns: DataFrame | None = None
    known: MutableMapping[DataFrame, Placed] = field(default_factory=weakref.WeakKeyDictionary)

    @property
    def blocks(self) -> int:
        return -(-self.n_variants // self.rows)

    @property
    def chunks(self) -> int:
        return -(-self.n_samples // self.cols)

    @property
    def part_rows(self) -> int:
        return -(-self.blocks // self.high)

    @property
    def part_cols(self) -> int:
        return -(-self.chunks // self.wide)

    @property
    def state_parts(self) -> int:
        """Partitions of a state: no more than it has rows for one member."""
        return min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.blocks + self.chunks)

    @property
    def places(self) -> int:
        """Partitions of a state whose rows stay, of few chunks each."""
        return min(self.chunks, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.chunks // CHUNKS)))

    @property
    def spark(self) -> SparkSession:
        return self.tiles.sparkSession

    @property
    def size(self) -> Callable[[int, int], int]:
        """The rows of a block or chunk, of which the last may have fewer, by kind and number."""
        per, whole = {P: self.rows, Q: self.cols}, {P: self.n_variants, Q: self.n_samples}
        return lambda kind, at: min(per[kind], whole[kind] - at * per[kind])

    def changed(self, change: Callable[[np.ndarray, At], np.ndarray]) -> Grid:
        """The same tiles, their genotypes changed in every pass."""
        return replace(self, change=change)

    def standing(self) -> Grid:
        """The same grid, the genotypes of each chunk in one row."""
        if self.n_variants > STANDING:
            raise ValueError(f"{self.n_variants} variants are too many to stand by each chunk")
        blocks, rows, size, blank = self.blocks, self.rows, self.size, self.n_variants

        def pack(t: pa.Table) -> pa.Table:
            chunk = t.column("chunk")[0].as_py()
            whole = np.full((blank, size(Q, chunk)), MISSING, np.uint8)
            for block, raw in zip(t.column("block").to_pylist(), t.column("g").to_pylist()):
                whole[block * rows : block * rows + size(P, block)] = unpacked(raw, size(Q, chunk))
            return pa.table({"chunk": pa.array([chunk], pa.int64()), "g": pa.array([packed(whole)], pa.binary())})

        assert blocks * rows >= blank
        columns = durable(self.tiles.groupBy("chunk").applyInArrow(pack, "chunk long, g binary"))
        return replace(self, columns=columns, known=weakref.WeakKeyDictionary())

    # ---- states ----

    def begun(self, members: int, make: Callable[[int, int, int, int], np.ndarray], kinds: tuple[int, ...] = (P, Q)) -> DataFrame:
        """A state whose layers make(kind, b, id, size) gives."""
        size, out = self.size, None
        for kind, n in ((P, self.blocks), (Q, self.chunks)):
            if kind not in kinds:
                continue

            def run(batches: Iterator[pa.RecordBatch], kind: int = kind) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for x in batch.column(0).to_pylist():
                        b, i = x % members, x // members
                        yield state_rows([(kind, b, i, make(kind, b, i, size(kind, i)), None)])

            rows = self.spark.range(n * members).mapInArrow(run, STATE)
            out = rows if out is None else out.unionByName(rows)
        return self.kept(out)

    def state_of(self, kind: int, rows: DataFrame, index: str, value: str, members: int = 1, filled: float = 0.0) -> DataFrame:
        """Rows of a state from (index, array): one layer, for each member the same; rows that aren't there are `filled`."""
        per = self.rows if kind == P else self.cols
        size = self.size
        keyed = rows.select(F.floor(F.col(index) / per).cast("long").alias("id"), F.col(index).cast("long").alias("at"), F.col(value).cast("array<double>").alias("x"))

        def pack(t: pa.Table) -> pa.Table:
            i = t.column("id")[0].as_py()
            x = np.stack(t.column("x").to_numpy())
            layer = np.full((size(kind, i), x.shape[1]), filled)
            layer[t.column("at").to_numpy() - i * per] = x
            return pa.Table.from_batches([state_rows([(kind, b, i, layer[None], None) for b in range(members)])])

        return self.kept(keyed.groupBy("id").applyInArrow(pack, STATE))

    def labelled(self, state: DataFrame, labels: DataFrame) -> DataFrame:
        """The state with the labels of (sample_id, label): a number from 0, or a negative or null one for none."""
        per, size = self.cols, self.size
        keyed = labels.where("label >= 0").select(F.floor(F.col("sample_id") / per).cast("long").alias("chunk"), (F.col("sample_id") % per).cast("int").alias("at"), F.col("label").cast("int").alias("label"))

        def pack(t: pa.Table) -> pa.Table:
            i = t.column("chunk")[0].as_py()
            y = np.full(size(Q, i), -1, np.int32)
            y[t.column("at").to_numpy()] = t.column("label").to_numpy()
            return pa.table({"chunk": [i], "known": [y.tobytes()]})

        known = keyed.groupBy("chunk").applyInArrow(pack, "chunk long, known binary")
        joined = state.join(known, (F.col("kind") == Q) & (F.col("id") == F.col("chunk")), "left")
        return self.kept(joined.select("kind", "b", "id", "s", F.when(F.col("kind") == Q, F.col("known")).alias("y")))

    def kept(self, state: DataFrame) -> DataFrame:
        """The state, to be computed once; its lineage is cut every few passes and old ones are released."""
        self.passes[0] += 1
        if self.passes[0] % CUT_EVERY == 0:
            return durable(state)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        self.cached.append(state)
        while len(self.cached) > KEEP + len(self.pinned):
            old = next((x for x in self.cached if all(x is not y for y in self.pinned)), None)
            if old is None:
                break
            self.cached = [x for x in self.cached if x is not old]
            old.unpersist()
        return state

    def pin(self, *states: DataFrame) -> None:
        """States to be kept until others are named."""
        self.pinned = list(states)

    def release(self) -> None:
        for x in self.cached:
            x.unpersist()
        self.cached, self.pinned = [], []

    # ---- passes ----

    def step(
        self, state: DataFrame, width: int, kernel: Kernel | None = None, send_p: Send = [], send_q: Send = [], finish_p: Finish | None = None, finish_q: Finish | None = None,
        active: list[int] | None = None,
    ) -> DataFrame:
        """The state after a pass. Rows of a kind without a finish stay as they are; without a kernel rows are
        finished where they are. Layers are arrays (depth, rows, width). Members that aren't active stay."""
        finish = {k: f for k, f in ((P, finish_p), (Q, finish_q)) if f}
        if self.columns is not None:
            return self.stood(state, width, kernel, {P: send_p, Q: send_q}, finish, active)
        rows = state.where(F.col("kind") != SUMS)
        if kernel is None:
            return self.kept(self.finished(rows, finish, width, active))
        partial = self.partials(rows, width, kernel, {P: send_p, Q: send_q}, active)
        return self.kept(self.reduced(partial, finish, width, active))

    def placed(self, state: DataFrame) -> Placed:
        """A state that isn't one of a pass over this grid, its rows of Q brought to their chunks."""
        if state in self.known:
            return self.known[state]
        p = {(r["b"], r["id"]): (bytes(r["s"]), r["y"] and bytes(r["y"])) for r in state.where(F.col("kind") == P).select("b", "id", "s", "y").collect()}  # of few variants
        n = self.places
        rows = state.where(F.col("kind") == Q).select("kind", "b", "id", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("x"), "s", "y")
        sized = rows.repartition(n, "id").join(self.columns.repartition(n, "chunk"), F.col("id") == F.col("chunk"), "left")
        frame = durable(sized.select(*rows.columns, "g").sortWithinPartitions("id", "b"))
        self.known[state] = Placed(Frame(frame, 0), p, {})
        return self.known[state]

    def stood(self, state: DataFrame, width: int, kernel: Kernel | None, send: dict[int, Send], finish: dict[int, Finish], active: list[int] | None) -> DataFrame:
        """The state after a pass over a standing grid: rows of Q are made where they are, and only what the tiles
        add to the sums of blocks, added up by partition, leaves its task."""
        self.passes[0] += 1
        old = self.placed(state)
        size, blocks, rows, cols, n_variants, change = self.size, self.blocks, self.rows, self.cols, self.n_variants, self.change
        of = lambda kind, b: send[kind] if not send[kind] or isinstance(send[kind][0], int) else send[kind][b]
        moving = lambda b: active is None or b in active
        told = {(b, i): layers(s, size(P, i), width)[of(P, b)].copy() for (b, i), (s, _) in old.p.items() if kernel is not None and of(P, b) and moving(b)}
        finish_q = finish.get(Q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            whole, at_chunk = None, None

            def add(at: tuple[int, int, int], x: np.ndarray | list[float] | None) -> None:
                if x is not None:
                    x = np.asarray(x, float)
                    if at in sums:
                        sums[at] += x
                    else:
                        sums[at] = x.copy()

            for batch in batches:
                for b, i, s, y, raw in zip(*(batch.column(c) for c in ("b", "id", "s", "y", "g"))):
                    b, i, s, y, raw = b.as_py(), i.as_py(), s.as_py(), y.as_py(), raw.as_py()
                    if not moving(b):
                        if finish_q:
                            yield placed_rows([(Q, b, i, -1, None, s, y, raw)])
                        continue
                    n, own = size(Q, i), labels(y)
                    x, total = layers(s, n, width), None
                    if kernel is not None:
                        if i != at_chunk:
                            whole, at_chunk = np.full((n_variants, n), MISSING, np.uint8) if raw is None else unpacked(raw, n), i
                        sent = x[of(Q, b)] if of(Q, b) else None
                        for block in range(blocks):
                            at = At(b, block, i, block * rows, i * cols, own)
                            g = whole[block * rows : (block + 1) * rows]
                            p, q, numbers = kernel(g if change is None else change(g, at), told.get((b, block)), sent, at)
                            add((P, b, block), p)
                            add((SUMS, b, 0), numbers)
                            if q is not None:
                                total = np.array(q, float) if total is None else np.add(total, q, out=total)
                    if finish_q:
                        new, numbers = finish_q(x, None if total is None else total.reshape(n, -1), b, i, own)
                        add((SUMS, b, 2), numbers)
                        yield placed_rows([(Q, b, i, -1, None, np.ascontiguousarray(new, float).tobytes(), y, raw)])
            part = TaskContext.get().partitionId()
            for at in sorted(sums):
                yield placed_rows([(*at, part, sums[at].tobytes(), None, None, None)])

        found: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
        frame = old.frame
        if kernel is not None or finish_q:
            out = frame.rows.where(F.col("part") < 0).mapInArrow(run, PLACED)
            most = self.places
            if finish_q:
                age = (frame.age + 1) % CUT_STANDING
                if not age:
                    collected(out)
                frame = Frame(out if age else durable(out), age)
                out = frame.rows.where(F.col("part") >= 0)
            out = out.select("kind", "b", "id", "part", "x", "s", "y")
            while most > FAN:
                out = out.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("kind", "b", "id", "up").applyInArrow(added, PARTIAL)
                most = -(-most // FAN)
            for r in out.select("kind", "b", "id", "part", "x").collect():  # those of few variants from FAN parts at most
                found.setdefault((r["kind"], r["b"], r["id"]), []).append((r["part"], bytes(r["x"])))
        totals = {at: np.sum([np.frombuffer(x) for _, x in sorted(xs)], axis=0) for at, xs in found.items()}
        sums = {(b, i): x for (kind, b, i), x in totals.items() if kind == SUMS}
        p = dict(old.p)
        if P in finish:
            for b, i in sorted(k for k in old.p if moving(k[0])):
                s, y = old.p[b, i]
                n, total = size(P, i), totals.get((P, b, i))
                new, numbers = finish[P](layers(s, n, width), None if total is None else total.reshape(n, -1), b, i, labels(y))
                p[b, i] = (np.ascontiguousarray(new, float).tobytes(), y)
                if numbers is not None:
                    sums[b, 1] = sums.get((b, 1), 0) + np.asarray(numbers, float)
        few = [*((P, b, i, s, y) for (b, i), (s, y) in p.items()), *((SUMS, b, i, x.tobytes(), None) for (b, i), x in sums.items())]
        state = self.spark.createDataFrame(few, STATE).unionByName(frame.rows.where(F.col("part") < 0).select("kind", "b", "id", "s", "y"))
        self.known[state] = Placed(frame, p, sums)
        return state

    def partials(self, state: DataFrame, width: int, kernel: Kernel, send: dict[int, Send], active: list[int] | None = None) -> DataFrame:
        """(kind, b, id, part, x, s, y): what each part adds to the sums, x; and the rows of the state, s, which
        go along with what is sent to one of the parts, so that a pass reads the state once."""
        size, per = self.size, {P: self.rows, Q: self.cols}
        last = {P: self.n_variants - (self.blocks - 1) * self.rows, Q: self.n_samples - (self.chunks - 1) * self.cols}
        count = {P: self.blocks, Q: self.chunks}

        def cut(kind: int, layers: list[int]) -> Column:
            """The bytes of some layers of the rows of a kind."""
            n = F.when(F.col("id") == count[kind] - 1, last[kind]).otherwise(per[kind]) * (8 * width)
            return F.concat(*(F.substring("s", (n * i + 1).cast("int"), n.cast("int")) for i in layers))

        x = F.lit(None).cast("binary")
        for kind, which in send.items():
            if not which:
                continue
            if isinstance(which[0], int):
                got = cut(kind, which)
            else:
                got = F.lit(None).cast("binary")
                for b, own in enumerate(which):
                    got = F.when(F.col("b") == b, cut(kind, own)).otherwise(got)
            x = F.when(F.col("kind") == kind, got).otherwise(x)
        if active is not None:
            x = F.when(F.col("b").isin(*active), x)
        seen = state.select("kind", "b", "id", x.alias("x"), "s", "y")
        across, down = self.part_cols, self.part_rows
        own = F.when(F.col("kind") == P, F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda c: F.floor(F.col("id") / self.high) * across + c)).otherwise(
            F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: r * across + F.floor(F.col("id") / self.wide))
        )
        own = F.when(F.col("x").isNull(), F.slice(own, 1, 1)).otherwise(own)
        sent = seen.select("kind", "b", "id", "x", "s", "y", F.posexplode(own.cast("array<int>")).alias("_nth", "part"))
        sent = sent.select("part", "kind", "b", "id", "x", *(F.when(F.col("_nth") == 0, F.col(c)).alias(c) for c in ("s",)), "y")
        rows, cols, change = self.rows, self.cols, self.change

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            known: dict[tuple[int, int, int], np.ndarray] = {}
            told: dict[tuple[int, int], np.ndarray | None] = {}
            members: set[int] = set()
            out = []
            for kind, b, i, x, s, y in zip(*(right.column(c).to_pylist() for c in ("kind", "b", "id", "x", "s", "y"))):
                if s is not None:
                    out.append((kind, b, i, -1, None, s, y))
                if x is not None:
                    known[kind, b, i] = layers(x, size(kind, i), width)
                    members.add(b)
                    if kind == Q:
                        told[b, i] = labels(y)
            sums: dict[tuple[int, int, int], np.ndarray] = {}

            def add(at: tuple[int, int, int], x: np.ndarray | None) -> None:
                if x is not None:
                    x = np.asarray(x, float)
                    if at in sums:
                        sums[at] += x
                    else:
                        sums[at] = x.copy()

            for block, chunk, raw in sorted(zip(*(left.column(c).to_pylist() for c in ("block", "chunk", "g")))):
                whole = unpacked(raw, size(Q, chunk))
                for b in sorted(members):
                    at = At(b, block, chunk, block * rows, chunk * cols, told.get((b, chunk)))
                    g = whole if change is None else change(whole, at)
                    p, q, numbers = kernel(g, known.get((P, b, block)), known.get((Q, b, chunk)), at)
                    add((P, b, block), p)
                    add((Q, b, chunk), q)
                    add((SUMS, b, 0), numbers)
            part = key[0].as_py()
            return partial_rows([*out, *((*n, part, sums[n].tobytes(), None, None) for n in sorted(sums))])

        found = self.tiles.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, PARTIAL)
        most = max(across, down, across * down)
        while most > FAN:
            found = found.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("kind", "b", "id", "up").applyInArrow(added, PARTIAL)
            most = -(-most // FAN)
        return found

    def reduced(self, partial: DataFrame, finish: dict[int, Finish], width: int, active: list[int] | None) -> DataFrame:
        """The new state from all that belongs to each of its rows."""
        size = self.size

        def run(t: pa.Table) -> pa.Table:
            kind, b, i = (t.column(c)[0].as_py() for c in ("kind", "b", "id"))
            total = total_of(t)
            if kind == SUMS:
                return pa.Table.from_batches([state_rows([(SUMS, b, 0, total, None)])])
            s, y = next((s, y) for s, y in zip(t.column("s").to_pylist(), t.column("y").to_pylist()) if s is not None)
            if kind not in finish or (active is not None and b not in active):
                return pa.Table.from_batches([state_rows([(kind, b, i, s, y)])])
            n = size(kind, i)
            new, numbers = finish[kind](layers(s, n, width), None if total is None else total.reshape(n, -1), b, i, labels(y))
            return pa.Table.from_batches([state_rows([(kind, b, i, new, y), *([(SUMS, b, 1 + kind, numbers, None)] if numbers is not None else [])])])

        return partial.repartition(self.state_parts, "kind", "b", "id").groupBy("kind", "b", "id").applyInArrow(run, STATE)

    def finished(self, rows: DataFrame, finish: dict[int, Finish], width: int, active: list[int] | None) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, b, i, s, y in rows_of(batch):
                    if kind not in finish or (active is not None and b not in active):
                        yield state_rows([(kind, b, i, s, y)])
                        continue
                    new, numbers = finish[kind](layers(s, size(kind, i), width), None, b, i, labels(y))
                    yield state_rows([(kind, b, i, new, y), *([(SUMS, b, 1 + kind, numbers, None)] if numbers is not None else [])])

        return rows.mapInArrow(run, STATE)

    def numbers(self, *states: DataFrame) -> dict[tuple[int, int], np.ndarray]:
        """The sums of a state, by member and origin: 0 the tiles, 1 the blocks, 2 the chunks; those of the next
        state from 3 on, and so on."""

        if all(x in self.known for x in states):
            return {(b, i + 3 * at): x for at, state in enumerate(states) for (b, i), x in self.known[state].sums.items()}

        def run(t: pa.Table) -> pa.Table:
            x = np.sum([np.frombuffer(s) for s in sorted(t.column("s").to_pylist())], axis=0)
            return pa.Table.from_batches([state_rows([(SUMS, t.column("b")[0].as_py(), t.column("id")[0].as_py(), x, None)])])

        sums = [x.where(F.col("kind") == SUMS).withColumn("id", F.col("id") + 3 * i) for i, x in enumerate(states)]
        found = reduce(DataFrame.unionByName, sums).groupBy("b", "id").applyInArrow(run, STATE)
        return {(r["b"], r["id"]): np.frombuffer(r["s"]).copy() for r in found.collect()}  # at most three rows for each member and state

    def arrays(self, state: DataFrame, kind: int, width: int, name: str, index: str, layer: int = 0) -> DataFrame:
        """(b, index, name): one layer as an array for each variant or sample."""
        size, per = self.size, self.rows if kind == P else self.cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, b, i, s, _ in rows_of(batch):
                    x = layers(s, size(k, i), width)[layer]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b] * len(x), pa.int32()), pa.array(np.arange(i * per, i * per + len(x))), pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, np.int32), np.ascontiguousarray(x).ravel())],
                        names=["b", index, name],
                    )

        out = state.where(F.col("kind") == kind).mapInArrow(run, f"b int, {index} long, {name} array<double>")
        return out if self.columns is None else durable(out)  # while the state is there


def layers(s: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(s).reshape(-1, size, width)


def labels(y: bytes | None) -> np.ndarray | None:
    return None if y is None else np.frombuffer(y, np.int32)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, bytes | None]]:
    return zip(*(batch.column(c).to_pylist() for c in ("kind", "b", "id", "s", "y")))


def state_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    binary = [s if isinstance(s, bytes) else np.ascontiguousarray(s, float).tobytes() for s in columns[3]]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(binary, pa.binary()), pa.array(columns[4], pa.binary())], names=["kind", "b", "id", "s", "y"]
    )


def placed_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "b", "id", "part", "x", "s", "y", "g"])


def collected(rows: DataFrame) -> None:
    """Have the driver collect its garbage, with which the cuts of states that nothing refers to any more go."""
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()


def total_of(t: pa.Table) -> np.ndarray | None:
    """The sum of the rows that have one, in the order of their parts, so that the order of arrival has no say."""
    rows = sorted((part, x) for part, x in zip(t.column("part").to_pylist(), t.column("x").to_pylist()) if x is not None)
    if not rows:
        return None
    total = np.frombuffer(rows[0][1]).copy()
    for _, x in rows[1:]:
        total += np.frombuffer(x)
    return total


def partial_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 7
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "b", "id", "part", "x", "s", "y"), columns, kinds)})


def added(key: tuple, t: pa.Table) -> pa.Table:
    """One row of sums for several parts; the rows of the state, in the part -1, as they are."""
    part = key[3].as_py()
    if part < 0:
        return t.set_column(t.column_names.index("part"), "part", pa.array([-1] * t.num_rows, pa.int32())).select(["kind", "b", "id", "part", "x", "s", "y"])
    kind, b, i = (t.column(c)[0].as_py() for c in ("kind", "b", "id"))
    return partial_rows([(kind, b, i, part, total_of(t).tobytes(), None, None)])


def to_grid(geno: DataFrame, n_variants: int, n_samples: int, rows: int = 512, cols: int = 4096, high: int = 4, wide: int = 4) -> Grid:
    """The grid of a long form whose variant_id and sample_id are dense indices from 0; a pair without a row
    is missing. A group is one tile."""
    v, c = F.col("variant_id").cast("long"), F.col("sample_id").cast("long")
    keyed = geno.select(
        F.floor(v / rows).alias("block"), F.floor(c / cols).alias("chunk"), (v % rows).cast("int").alias("r"), (c % cols).cast("int").alias("c"), F.col("g").cast("int").alias("g")
    )

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        block, chunk = int(p["block"].iloc[0]), int(p["chunk"].iloc[0])
        g = np.full((min(rows, n_variants - block * rows), min(cols, n_samples - chunk * cols)), MISSING, np.uint8)
        g[p["r"].to_numpy(), p["c"].to_numpy()] = p["g"].to_numpy()
        return pd.DataFrame({"block": [block], "chunk": [chunk], "g": [packed(g)]})

    return dealt(keyed.groupBy("block", "chunk").applyInPandas(pack, "block long, chunk long, g binary"), n_variants, n_samples, rows, cols, high, wide)


def packed_grid(bits: DataFrame, n_variants: int, n_samples: int, rows: int = 512, cols: int = 4096, high: int = 4, wide: int = 4) -> Grid:
    """The grid of packed rows (variant_id, n, bits) as read from files, each cut into the bytes of its chunks and
    never spread out into a row for each genotype. cols is a multiple of four."""
    if cols % 4:
        raise ValueError("a chunk has to begin with a new byte")
    v, wide_bytes = F.col("variant_id").cast("long"), cols // 4
    chunk = F.explode(F.sequence(F.lit(0), F.lit(-(-n_samples // cols) - 1)))
    cut = bits.select(F.floor(v / rows).alias("block"), (v % rows).cast("int").alias("r"), "bits", chunk.alias("chunk")).select(
        "block", "r", F.col("chunk").cast("long").alias("chunk"), F.substring("bits", F.col("chunk") * wide_bytes + 1, F.lit(wide_bytes)).alias("bits")
    )

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        block, at = int(p["block"].iloc[0]), int(p["chunk"].iloc[0])
        n = min(cols, n_samples - at * cols)
        g = np.full((min(rows, n_variants - block * rows), n), MISSING, np.uint8)
        g[p["r"].to_numpy()] = unpacked(b"".join(p["bits"]), n)
        return pd.DataFrame({"block": [block], "chunk": [at], "g": [packed(g)]})

    return dealt(cut.groupBy("block", "chunk").applyInPandas(pack, "block long, chunk long, g binary"), n_variants, n_samples, rows, cols, high, wide)


def dealt(tiles: DataFrame, n_variants: int, n_samples: int, rows: int, cols: int, high: int, wide: int) -> Grid:
    """Tiles by part, each part in one task and in order, cut and cached so."""
    g = Grid(tiles, n_variants, n_samples, rows, cols, high, wide)
    part = (F.floor(F.col("block") / high) * g.part_cols + F.floor(F.col("chunk") / wide)).cast("int")
    n = min(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), g.part_rows * g.part_cols)
    g.tiles = durable(tiles.select(part.alias("part"), "block", "chunk", "g").repartition(n, "part").sortWithinPartitions("part")).persist(StorageLevel.MEMORY_AND_DISK)
    return g


def products(grid: Grid) -> DataFrame:
    """(i, j, n, ga, gb, gg) of every two variants, i <= j, that samples were called at both: the number of these, the
    alleles of either and the products of both, as whole numbers.

    Tiles go to the pairs of rows of parts that they are in; each pair is multiplied tile by tile, and the
    products of two blocks are added over the chunks.
    """
    down, high, wide, rows, size, change = grid.part_rows, grid.high, grid.wide, grid.rows, grid.size, grid.change
    own = F.floor(F.col("block") / high)
    other = F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high"))))
    tiles = grid.tiles.select("block", "chunk", "g", F.floor(F.col("chunk") / wide).cast("int").alias("part"), other.alias("pair")).select("block", "chunk", "g", "part", "pair.low", "pair.high")

    def multiply(key: tuple, t: pa.Table) -> pa.Table:
        low, up, part = (k.as_py() for k in key)
        held = {}
        for block, chunk, raw in zip(*(t.column(c).to_pylist() for c in ("block", "chunk", "g"))):
            g = unpacked(raw, size(Q, chunk))
            g = g if change is None else change(g, At(0, block, chunk, 0, 0))
            seen = (g != MISSING).astype(float)
            held[block, chunk] = (seen, g * seen)
        blocks, chunks = sorted({b for b, _ in held}), sorted({c for _, c in held})
        out = []
        for i in (b for b in blocks if b // high == low):
            for j in (b for b in blocks if b // high == up and b >= i):
                x = 0
                for c in (c for c in chunks if (i, c) in held and (j, c) in held):
                    (si, gi), (sj, gj) = held[i, c], held[j, c]
                    x = x + np.stack([si @ sj.T, gi @ sj.T, si @ gj.T, gi @ gj.T])
                if not isinstance(x, int):
                    out.append((i, j, part, x.tobytes()))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bi", "bj", "part", "x"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))})

    shape = "bi long, bj long, part int, x binary"
    found, most = tiles.groupBy("low", "high", "part").applyInArrow(multiply, shape), grid.part_cols

    def add(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"bi": t.column("bi").slice(0, 1), "bj": t.column("bj").slice(0, 1), "part": pa.array([key[2].as_py()], pa.int32()), "x": pa.array([total_of(t).tobytes()], pa.binary())})

    while most > FAN:
        found = found.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("bi", "bj", "up").applyInArrow(add, shape)
        most = -(-most // FAN)

    def spread(t: pa.Table) -> pa.Table:
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        x = total_of(t).reshape(4, size(P, bi), size(P, bj))
        a, b = np.nonzero(np.triu(x[0]) if bi == bj else x[0])
        whole = x[:, a, b].astype(np.int64)
        return pa.table({"i": pa.array(bi * rows + a), "j": pa.array(bj * rows + b), **{c: pa.array(v) for c, v in zip(("n", "ga", "gb", "gg"), whole)}})

    return found.groupBy("bi", "bj").applyInArrow(spread, "i long, j long, n long, ga long, gb long, gg long")
