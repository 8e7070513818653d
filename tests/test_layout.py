"""Places of rows in a global order, on many rows and partitionings."""

import pytest
from pyspark.sql import functions as F

from genostrata.operators import layout


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 4, 16, 64])
def test_places_are_distinct_and_in_order(spark, parts, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        n = 400_000
        key = (F.xxhash64("id") % 5000).alias("key")
        rows = spark.range(n, numPartitions=max(2, parts // 2)).select(key, "id", F.md5(F.col("id").cast("string")).alias("carried"))
        got = layout.numbered(rows, ["key", "id"])
        assert got.columns == ["key", "id", "carried", "pos"]
        assert tuple(got.agg(F.count("pos"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum((F.md5(F.col("id").cast("string")) == F.col("carried")).cast("int"))).first()) == (n, n, 0, n - 1, n)
        pair = F.struct("key", "id")
        by_thousand = got.groupBy((F.col("pos") / 1000).cast("int").alias("at")).agg(F.min(pair).alias("low"), F.max(pair).alias("high")).orderBy("at").collect()
        assert all(tuple(a["high"]) < tuple(b["low"]) for a, b in zip(by_thousand, by_thousand[1:]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_places_of_no_rows(spark):
    assert layout.numbered(spark.createDataFrame([], "key long, x string"), ["key"]).collect() == []
