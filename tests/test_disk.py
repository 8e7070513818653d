"""What stays on disk while a job goes on."""

from pyspark.sql import functions as F

import corpus_pipeline
from genostrata import durable as cut
from genostrata.llm import common, ngram_join


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffles_of_a_cut_are_removed_at_once(spark):
    df = spark.range(5000).repartition(6, "id").groupBy((F.col("id") % 50).alias("k")).agg(F.count("id").alias("n"))
    before = shuffle_files(spark)
    out = cut.durable(df)
    assert common.durable is cut.durable and shuffle_files(spark) <= before
    assert out.count() == 50 and cut.durable(df.join(out, "k")).count() == 50 and {r["n"] for r in df.collect()} == {100}
    assert spark.conf.get(cut.FREED) == "false"


def test_sifted_rows_are_all_and_no_key_is_missed(spark, monkeypatch):
    rows = spark.createDataFrame([(None if i % 50 == 7 else i, -i * 7919, f"t{i}") for i in range(2000)], "k long, h long, t string")
    keys = rows.where("t like 't1%'").select("k", "h")
    wanted = {r["t"] for r in rows.where("t like 't1%'").collect()}
    for words, most in ((common.FILTER_WORDS, 1), (64, 700)):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        some, rest = ([r["t"] for r in x.collect()] for x in common.sifted(rows, keys, "k", "h"))
        assert sorted(some + rest) == sorted(f"t{i}" for i in range(2000)) and wanted <= set(some)
        assert len(some) - len(wanted) <= most
    some, rest = common.sifted(rows, keys.limit(0), "k", "h")
    assert some.count() == 0 and rest.count() == 2000


def test_texts_without_copies_stay_where_they_are(spark, monkeypatch):
    """Of the rows' texts only those of linked classes are moved, and dropped rows alone are joined away."""
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(400)), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame([*plain, *((1000 + i, plain[i][1] + " end", "en", "s", 0) for i in range(3))], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).persist()
    moved = []

    def kept(df):
        tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        df.select("*").collect()
        moved.append(sum(x.length() for x in [tracker.getAllFiles().apply(i) for i in range(tracker.getAllFiles().size())] if "/shuffle_" in x.getPath() and x.getPath() not in seen))
        seen.update(shuffle_files(spark))
        return real(df)

    seen, real = shuffle_files(spark), cut.durable
    for module in (ngram_join, corpus_pipeline):
        monkeypatch.setattr(module, "durable", kept)
    out = kept(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(300))
    size = sum(len(t) for _, t, *_ in plain)
    assert sum(moved) < size, moved
    docs.unpersist()
