"""Samples that arrive in pieces over several batches."""

import numpy as np

from genostrata.streaming import assembly, projection

SCHEMA = "sample_id long, variant_id long, g int"


def test_a_sample_split_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = 120
    p = rng.uniform(0.05, 0.95, (m, 2))
    rows = [(s, v, int(rng.binomial(2, p[v, s % 2])) if (s + v) % 11 else 3) for s in range(5) for v in range(m)]
    order = rng.permutation(len(rows))
    parts = [[rows[i] for i in part] for part in np.array_split(order, 3)]
    late = [r for r in rows if r[0] == 4 and r[1] < 3]
    parts[2] = [r for r in parts[2] if not (r[0] == 3 and r[1] == 5)]  # sample 3 is never whole, if its variant 5 comes last
    parts[0] = [r for r in parts[0] if not (r[0] == 3 and r[1] == 5)]
    parts[1] = [r for r in parts[1] if not (r[0] == 3 and r[1] == 5)] + parts[0][:7]  # some come twice
    for i, part in enumerate([*parts, late]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    pt = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "variant_id long, p array<double>")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = assembly.project_whole(stream, pt, m, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    assert q.exception() is None and q.lastProgress["batchId"] >= 2
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["sample_id"] for r in got) == [0, 1, 2, 4]
    want = {r["sample_id"]: r["q"] for r in projection.project_rows(spark.createDataFrame(rows, SCHEMA), pt).collect()}
    for r in got:
        assert np.allclose(r["q"], want[r["sample_id"]], atol=1e-9) and r["q"][r["sample_id"] % 2] > 0.7
