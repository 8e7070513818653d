"""The data of bar charts of ancestry proportions: orders, segments, stacks and label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable


def dominant_cluster(q: DataFrame) -> DataFrame:
    """(sample_id, cluster, share) of (sample_id, q array): the first largest element."""
    most = F.array_max("q")
    return q.select("sample_id", (F.array_position("q", most) - 1).cast("int").alias("cluster"), most.alias("share"))


def sample_order(q: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(sample_id, label, cluster, share, pos): by label, dominant cluster and its share.

    The position in a label's part is counted in the part, and the parts' sizes, one row a label,
    are added, so no task sees all samples.
    """
    d = dominant_cluster(q).join(labels.select("sample_id", F.col(label).alias("label")), "sample_id")
    within = Window.partitionBy("label").orderBy("cluster", "share", "sample_id")
    sizes = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("label", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return d.withColumn("_r", F.row_number().over(within)).join(F.broadcast(offsets), "label").select("sample_id", "label", "cluster", "share", (F.col("offset") + F.col("_r") - 1).alias("pos"))


def numbered(rows: DataFrame, keys: list[str], into: str = "pos") -> DataFrame:
    """rows with their place, from 0, in the order of the keys. Rows are dealt by range of the keys and
    written once, as another evaluation may deal them otherwise; then they are counted by part, and the
    counts of the parts before, one row for each part, are added. No task sees all rows."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", part).withColumn("_place", place))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(into, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def order_by_levels(q: DataFrame, labels: DataFrame | None = None, levels: list[str] = []) -> DataFrame:
    """(sample_id, pos) by the labels of two and more levels, the outermost last in `levels`; by one
    level, dominant cluster and its share; or without labels by the last two."""
    d = dominant_cluster(q)
    if labels is not None:
        d = d.join(labels.select("sample_id", *levels), "sample_id")
    keys = [*reversed(levels), "sample_id"] if len(levels) > 1 else [*levels, "cluster", "share", "sample_id"]
    return numbered(d, keys).select("sample_id", "pos")


def group_ticks(ordered: DataFrame, label: str = "label") -> DataFrame:
    """(label, tick, boundary) of labels that each stand side by side along pos: the middle and the end."""
    g = ordered.groupBy(F.col(label).alias("label")).agg(F.avg("pos").alias("mean"), F.max("pos").alias("last"), (F.max("pos") - F.min("pos") + 1 == F.count(F.lit(1))).alias("side"))
    one = F.when(F.col("side"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label not in one piece: "), F.col("label").cast("string"))))
    return g.select(one.alias("label"), (F.col("mean") + 0.5).alias("tick"), (F.col("last") + 0.5).alias("boundary"))


def order_within_groups(q: DataFrame, labels: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(sample_id, label, place): samples of a label by their shares of its clusters, its largest
    cluster's first, each falling."""
    totals = q.join(labels.select("sample_id", F.col(label).alias("label")), "sample_id")
    sums = totals.groupBy("label").agg(F.array(*(F.round(F.sum(F.get("q", F.lit(i))), 9) for i in range(k))).alias("totals"))
    order = F.transform(F.array_sort(F.transform("totals", lambda x, i: F.struct((-x).alias("t"), i.alias("i")))), lambda x: x["i"])
    orders = sums.select("label", order.alias("order"))
    shares = totals.join(orders, "label").withColumn("shares", F.transform("order", lambda i: -F.get("q", i)))
    return shares.select("sample_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("shares", "sample_id")) - 1).alias("place"))


def combined_bars(fits: list[tuple[int, DataFrame]], order: DataFrame) -> DataFrame:
    """(k_total, pos, k, low, high): the bars of fits of several K, all in one order of the samples."""
    out = None
    for k_total, q in fits:
        one = cumulative_bars(q).join(order, "sample_id").select(F.lit(k_total).alias("k_total"), "pos", "k", "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def bars(q: DataFrame, labels: DataFrame | None = None, levels: list[str] = []) -> DataFrame:
    """(pos, sample_id, levels..., k, low, high): all that a chart of (sample_id, q array) shows, samples
    in the order of their labels."""
    order = order_by_levels(q, labels, levels)
    stacks = cumulative_bars(q.select("sample_id", F.posexplode("q").alias("k", "q")))
    out = order.join(stacks, "sample_id")
    if labels is not None:
        out = out.join(labels.select("sample_id", *levels), "sample_id")
    return out.select("pos", "sample_id", *(levels if labels is not None else []), "k", "low", "high")


def label_segments(ordered: DataFrame) -> DataFrame:
    """(label, first_pos, last_pos, tick) of each run of equal labels along pos.

    Positions less the rank within the label are constant along a run.
    """
    island = F.col("pos") - F.row_number().over(Window.partitionBy("label").orderBy("pos"))
    runs = ordered.withColumn("island", island).groupBy("label", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return runs.select("label", "first_pos", "last_pos", ((F.col("first_pos") + F.col("last_pos") + 1) / 2).alias("tick"))


def cumulative_bars(q: DataFrame) -> DataFrame:
    """(sample_id, k, low, high) of (sample_id, k, q): stacked within the sample."""
    w = Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("q").over(w)
    return q.withColumn("high", high).select("sample_id", "k", (F.col("high") - F.col("q")).alias("low"), "high")


def hierarchy_conflicts(samples: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parents): labels that stand under more than one parent."""
    return samples.groupBy(F.col(child).alias("child")).agg(F.count_distinct(parent).alias("parents")).where("parents > 1")


def contiguity(samples: DataFrame, label: str, pos: str = "sample_id") -> DataFrame:
    """(label, n, contiguous): whether a label's samples stand side by side."""
    g = samples.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.max(pos) - F.min(pos) + 1).alias("span"))
    return g.select("label", "n", (F.col("span") == F.col("n")).alias("contiguous"))


def group_cluster_order(q: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, k, total, place): clusters of each label by their total, largest first."""
    total = q.join(labels.select("sample_id", F.col(label).alias("label")), "sample_id").groupBy("label", "k").agg(F.round(F.sum("q"), 9).alias("total"))
    return total.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.col("total").desc(), "k")))
