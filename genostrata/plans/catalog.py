"""Registered queries: each operator applied to the whole genotype views, rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import EPS, clip_array, in_chromosomes, is_autosome, normalized, simplex_projection
from ..operators import align, compare, folds, frequency, layout, model
from . import grid, views
from .views import K, long_form

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Variants and samples of a tile of the views' small grids, and tiles of a part.
TILE = {"rows": 16, "cols": 4096, "high": 1, "wide": 1}


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The dense view and its numbers of variants and samples; the vectors' ids are dense from 0, or are made
    so by rank."""
    g = views.dense(spark, sf_dir)
    shape = g.agg(F.max("variant_id") + 1, F.max("sample_id") + 1, F.count_distinct("sample_id")).first()
    if shape[1] != shape[2]:
        rank = layout.numbered(g.select("sample_id").distinct(), ["sample_id"], "at")
        g = g.join(rank, "sample_id").drop("sample_id").withColumnRenamed("at", "sample_id")
    return g, shape[0], shape[2]


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


@query
def geno_long_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dense(spark, sf_dir)


@query
def geno_long_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sparse(spark, sf_dir)


@query
def allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.allele_frequency(views.dense(spark, sf_dir)).withColumn("f", r6("f"))


def kept_variants(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    """Frequencies of the sparse view's variants that a predicate keeps; the sidecar is filtered first."""
    wanted = views.variants(spark, sf_dir).where(keep).select("variant_id")
    return frequency.allele_frequency(views.sparse(spark, sf_dir).join(wanted, "variant_id", "left_semi")).withColumn("f", r6("f"))


@query
def allele_freq_autosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_variants(spark, sf_dir, is_autosome("chrom"))


@query
def allele_freq_chrom_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_variants(spark, sf_dir, in_chromosomes("chrom", "chr11, 12 x"))


@query
def skipped_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many variants the autosome filter keeps and skips."""
    keep = is_autosome("chrom")
    return views.variants(spark, sf_dir).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped"))


@query
def global_mean_and_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.global_mean(views.sparse(spark, sf_dir)).withColumn("mean", r6("mean"))


@query
def flipped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype counts after the global swap of alleles."""
    return frequency.flip_alleles(views.sparse(spark, sf_dir)).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.sample_calls(views.dense(spark, sf_dir))


@query
def variant_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frequency.allele_frequency(views.dense(spark, sf_dir))
    return f.select("variant_id", "n_missing", r6(F.col("n_missing") / (F.col("n_called") + F.col("n_missing"))).alias("share"))


@query
def pack_2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.pack(views.dense(spark, sf_dir))


@query
def unpack_2bit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype counts by sample after packing and unpacking."""
    return frequency.unpack(frequency.pack(views.dense(spark, sf_dir))).groupBy("sample_id", "g").agg(F.count(F.lit(1)).alias("n"))


@query
def centered_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.dense(spark, sf_dir)
    m = frequency.centered_moments(g, frequency.allele_frequency(g))
    return m.select("variant_id", F.abs(r6("mean")).alias("mean"), r6("sum_squares").alias("sum_squares"))


@query
def gram_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the centred rows of every two variants over all samples."""
    g, n_variants, n_samples = places(spark, sf_dir)
    sums = grid.products(grid.to_grid(g, n_variants, n_samples, **TILE))
    return frequency.centred_products(sums, frequency.allele_frequency(g)).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("xx", 2).alias("xx"))


@query
def pop_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(frequency.population_frequency(views.dense(spark, sf_dir), K), "p").withColumn("p", r6("p"))


@query
def first_seen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.numbered_labels(views.samples(spark, sf_dir))


@query
def supervised_q_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below 7 are known, the others are not."""
    known = views.labelled(spark, sf_dir).withColumn("label", F.when(F.col("label") < 7, F.col("label")))
    return long_form(frequency.supervised_start(known, K)).withColumn("q", r6("q"))


def start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genotypes, P from the labels and Q near the labels."""
    g = views.dense(spark, sf_dir)
    return g.select("sample_id", "variant_id", "g"), frequency.population_frequency(g, K), views.q_true(spark, sf_dir)


@query
def loglik_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.log_likelihood_by_variant(*start(spark, sf_dir)).withColumn("loglik", F.round("loglik", 4))


@query
def loglik_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.log_likelihood_by_variant(*start(spark, sf_dir)).agg(F.round(F.sum("loglik"), 2).alias("loglik"))


@query
def em_step_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(model.em_step(*start(spark, sf_dir), K)[0], "p").withColumn("p", r6("p"))


@query
def em_step_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(model.em_step(*start(spark, sf_dir), K)[1]).withColumn("q", r6("q"))


@query
def em_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, q = start(spark, sf_dir)
    return long_form(model.em_step(g, *model.em_step(g, p, q, K), K)[1]).withColumn("q", r6("q"))


@query
def adam_step_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first adaptive step of Q from its start."""
    g, p, q = start(spark, sf_dir)
    zero = F.transform("q", lambda x: F.lit(0.0))
    return long_form(model.adam_step_q(q, model.em_step(g, p, q, K)[1], zero, zero, 1).select("sample_id", "q")).withColumn("q", r6("q"))


@query
def grad_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(model.newton_q(*start(spark, sf_dir), K).select("sample_id", "grad"), "grad").withColumn("grad", F.round("grad", 3))


def square(h: DataFrame, key: str) -> DataFrame:
    """(key, i, j, value) of K by K matrices in one array each."""
    return h.select(key, F.posexplode("hess").alias("at", "x")).select(key, F.floor(F.col("at") / K).cast("int").alias("i"), (F.col("at") % K).alias("j"), F.round("x", 1).alias("value"))


@query
def hess_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return square(model.newton_q(*start(spark, sf_dir), K), "sample_id")


@query
def grad_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(model.newton_p(*start(spark, sf_dir), K).select("variant_id", "grad"), "grad").withColumn("grad", F.round("grad", 3))


@query
def hess_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return square(model.newton_p(*start(spark, sf_dir), K), "variant_id")


@query
def loglik_inverse_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood when P counts the other allele."""
    g, p, q = start(spark, sf_dir)
    other = p.select("variant_id", F.transform("p", lambda x: 1 - x).alias("p"))
    return model.log_likelihood_by_variant(g, other, q).agg(F.round(F.sum("loglik"), 2).alias("loglik"))


@query
def clip_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("p"))
    return long_form(e.select("sample_id", clip_array("p").alias("p")), "p").withColumn("p", r6("p"))


def first_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unconstrained rows: the first K elements of each vector."""
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.slice(F.col("embedding").cast("array<double>"), 1, K).alias("q"))


@query
def normalize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(first_ten(spark, sf_dir).select("sample_id", normalized("q").alias("q"))).withColumn("q", r6("q"))


@query
def simplex_projection_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(first_ten(spark, sf_dir).select("sample_id", simplex_projection("q", K).alias("q"))).withColumn("q", r6("q"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.dense(spark, sf_dir)
    return folds.with_folds(g, views.table(spark, sf_dir, "embeddings").count())


@query
def cv_folds_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("sample_id", "variant_id", "fold")


@query
def cv_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query
def cv_masked_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies without the genotypes of fold 0."""
    return frequency.allele_frequency(folds.masked(folded(spark, sf_dir), 0)).withColumn("f", r6("f"))


@query
def cv_deviance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of fold 0 under the starting P and Q."""
    _, p, q = start(spark, sf_dir)
    held = folded(spark, sf_dir).where("fold = 0")
    return model.cv_deviance(held, p, q).withColumn("cv_index", r6("cv_index"))


def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(views.runs(spark, sf_dir))


@query
def cluster_cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare.cluster_costs(long_form(views.q_est(spark, sf_dir, 0, 0)), long_form(views.q_est(spark, sf_dir, 1, 1)))
    return c.withColumn("cost", r6("cost"))


@query
def run_pair_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compare.run_measures(long_runs(spark, sf_dir))
    return m.select("run1", "run2", *(r6(c).alias(c) for c in ("rmse", "jsd", "frobenius", "cost")))


@query
def rmse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and divergence of an estimate, whose columns are in an order of their own, against the truth."""
    two = long_form(views.q_true(spark, sf_dir)).withColumn("run_id", F.lit(0)).unionByName(long_form(views.q_est(spark, sf_dir, 0, 3)).withColumn("run_id", F.lit(1)))
    return compare.run_measures(two).select(r6("rmse").alias("rmse"), r6("jsd").alias("jsd"))


@query
def corr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare.run_measures(long_runs(spark, sf_dir))
    return c.select("run1", "run2", r6("correlation").alias("correlation"))


@query
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compare.stability(long_runs(spark, sf_dir))
    return s.select(*(r6(c).alias(c) for c in s.columns))


@query
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns summed in pairs."""
    mapping = spark.range(K).select(F.col("id").cast("int").alias("k"), F.floor(F.col("id") / 2).cast("int").alias("target"))
    return compare.merged(long_form(views.q_est(spark, sf_dir)), mapping).withColumn("q", r6("q"))


@query
def representative_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.representative(compare.run_measures(long_runs(spark, sf_dir))).withColumn("total", r6("total"))


@query
def mode_mean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the runs, their columns in the first one's order."""
    return compare.mode_mean(compare.aligned_to(long_runs(spark, sf_dir), 0)).withColumn("q", r6("q"))


@query
def membership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the vectors that are no memberships, and why."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("q"))
    return compare.membership_problems(e).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def inverse_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of run 0 that those of the others go with, both ways."""
    m = compare.column_map(align.run_distances(long_runs(spark, sf_dir)), long_runs(spark, sf_dir)).where("run1 = 0")
    back = compare.inverted(m.where("run2 = 1").select("k", F.col("k2").alias("target")))
    return m.select("run2", "k", "k2").unionByName(back.select(F.lit(-1).alias("run2"), "k", F.col("target").alias("k2")))


@query
def runs_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs have each number of clusters, and their first."""
    size = long_runs(spark, sf_dir).groupBy("run_id").agg((F.max("k") + 1).alias("n_clusters"))
    return size.groupBy("n_clusters").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))


@query
def cv_folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of equal size."""
    g = views.dense(spark, sf_dir)
    return folds.shuffled_folds(g, views.table(spark, sf_dir, "embeddings").count()).select("sample_id", "variant_id", "fold")


@query
def community_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as communities of runs, ranked by size."""
    members = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("community"))
    return compare.ranked_communities(members)


@query
def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant_cluster(views.q_est(spark, sf_dir)).withColumn("share", r6("share"))


def rounded_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.q_est(spark, sf_dir).withColumn("q", F.transform("q", lambda x: F.round(x, 9)))


@query
def sample_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sample_order(rounded_q(spark, sf_dir), views.labelled(spark, sf_dir)).select("sample_id", "pos")


@query
def sample_order_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.order_by_levels(rounded_q(spark, sf_dir))


@query
def sample_order_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by region and nation."""
    q = views.samples(spark, sf_dir).select("sample_id", F.array(F.lit(1.0)).alias("q"))
    return layout.order_by_levels(q, views.samples(spark, sf_dir), ["label1", "label2"])


@query
def group_tick_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles and ends of the labels' parts of the bars."""
    return layout.group_ticks(layout.sample_order(rounded_q(spark, sf_dir), views.labelled(spark, sf_dir)))


@query
def order_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.order_within_groups(rounded_q(spark, sf_dir), views.labelled(spark, sf_dir), K)


@query
def combined_sweep_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two numbers of clusters in one order of the samples."""
    q = long_form(views.q_est(spark, sf_dir))
    mapping = spark.range(K).select(F.col("id").cast("int").alias("k"), F.floor(F.col("id") / 2).cast("int").alias("target"))
    b = layout.combined_bars([(K // 2, compare.merged(q, mapping)), (K, q)], layout.order_by_levels(rounded_q(spark, sf_dir)))
    return b.select("k_total", "pos", "k", F.abs(r6("low")).alias("low"), r6("high").alias("high"))


@query
def label_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels in the samples' own order."""
    w = views.labelled(spark, sf_dir).select("label", F.col("sample_id").alias("pos"))
    return layout.label_segments(w)


@query
def cumulative_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.cumulative_bars(long_form(views.q_est(spark, sf_dir)))
    return b.select("sample_id", "k", F.abs(r6("low")).alias("low"), r6("high").alias("high"))


@query
def label_hierarchy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments, which stand under many nations."""
    c = views.table(spark, sf_dir, "customer")
    return layout.hierarchy_conflicts(c, "c_mktsegment", "c_nationkey")


@query
def label_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.contiguity(views.samples(spark, sf_dir), "label1")


@query
def group_cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_cluster_order(long_form(views.q_est(spark, sf_dir)), views.labelled(spark, sf_dir)).withColumn("total", r6("total"))


# ---- the same in SQL ----

DENSE = """dense AS (
  SELECT sample_id, label, variant_id, CASE WHEN x < -0.2 THEN 3 WHEN x < 0.05 THEN 0 WHEN x < 0.15 THEN 1 ELSE 2 END AS g
  FROM (SELECT vec_id AS sample_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS variant_id, unnest(embedding)::DOUBLE AS x FROM embeddings))"""
SPARSE = """sparse AS (
  SELECT l_suppkey AS sample_id, l_partkey AS variant_id, (sum(l_linenumber) % 3)::INT AS g FROM lineitem GROUP BY ALL)"""
VARIANTS = """variants AS (
  SELECT p_partkey AS variant_id, CASE WHEN p_partkey % 17 = 0 THEN 'chrX' WHEN p_partkey % 3 = 0 THEN 'chr' || d WHEN p_partkey % 3 = 1 THEN 'CHR' || d ELSE d END AS chrom,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE d::INT END AS number
  FROM (SELECT *, regexp_extract(p_brand, '[0-9]+') AS d FROM part))"""
SAMPLES = """samples AS (
  SELECT s_suppkey AS sample_id, n_name AS label1, r_name AS label2 FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
KS = f"ks AS (SELECT unnest(range({K}))::INT AS k)"
QTRUE = f"{KS}, qtrue AS (SELECT vec_id AS sample_id, k, CASE WHEN k = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END AS q FROM embeddings, ks)"


def q_est_sql(name: str, run: int, rotate: int) -> str:
    return f"""{name} AS (SELECT sample_id, k, w / sum(w) OVER (PARTITION BY sample_id) AS q FROM (
  SELECT vec_id AS sample_id, k, CASE WHEN (k + {rotate}) % {K} = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END
         + ((vec_id * {7 + run} + ((k + {rotate}) % {K}) * 3) % 11) / 220.0::DOUBLE AS w FROM embeddings, ks))"""


RUNS = ", ".join([KS, *(q_est_sql(f"q{r}", r, r) for r in range(4))]) + ", runs AS (" + " UNION ALL ".join(f"SELECT {r} AS run_id, * FROM q{r}" for r in range(4)) + ")"
def matched_sql(runs: str) -> str:
    """Values of every two runs, each column of the first with the nearest one of the second."""
    return f"""near AS (
  SELECT a.run_id AS run1, b.run_id AS run2, a.k AS k, b.k AS k2, avg(pow(a.q - b.q, 2)) AS d FROM {runs} a JOIN {runs} b ON a.sample_id = b.sample_id AND a.run_id < b.run_id GROUP BY ALL),
 cols AS (SELECT run1, run2, k, arg_min(k2, d) AS k2 FROM near GROUP BY ALL),
 pairs AS (
  SELECT run1, run2, a.sample_id, a.k, a.q AS a, b.q AS b FROM cols JOIN {runs} a ON a.run_id = run1 AND a.k = cols.k JOIN {runs} b ON b.run_id = run2 AND b.k = cols.k2 AND a.sample_id = b.sample_id)"""


RUN_PAIRS = RUNS + ", " + matched_sql("runs")
CLIP = f"greatest({EPS}::DOUBLE, least((1 - {EPS})::DOUBLE, %s))"
OBSERVED = "count(*) FILTER (g <> 3)"
FREQ = f"coalesce(sum(g) FILTER (g <> 3) / nullif(2 * {OBSERVED}, 0)::DOUBLE, 0)"
FREQS = f"round({FREQ}, 6) AS f, {OBSERVED}::BIGINT AS n_called, (count(*) FILTER (g = 3))::BIGINT AS n_missing"
POP = f"""{KS}, p0 AS (
  SELECT v.variant_id, k, {CLIP % "coalesce(sum(g) FILTER (g <> 3) / nullif(2 * count(*) FILTER (g <> 3), 0)::DOUBLE, 0.5)"} AS p
  FROM (SELECT DISTINCT variant_id FROM dense) v CROSS JOIN ks LEFT JOIN dense d ON d.variant_id = v.variant_id AND d.label = k GROUP BY ALL)"""
START = f"WITH {DENSE}, {POP}, q0 AS (SELECT vec_id AS sample_id, k, CASE WHEN k = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END AS q FROM embeddings, ks)"


def expected_sql(n: int) -> str:
    """Observed genotypes with r under step n's P and Q."""
    return f"""r{n} AS (SELECT o.sample_id, o.variant_id, o.g, sum(p * q) AS r FROM dense o JOIN q{n} USING (sample_id) JOIN p{n} USING (variant_id, k) WHERE g <> 3 GROUP BY ALL)"""


def em_sql(n: int) -> str:
    return f"""{expected_sql(n)}, ab{n} AS (SELECT *, g / r AS a, (2 - g) / (1 - r) AS b FROM r{n}),
 s{n} AS (SELECT variant_id, k, sum(q * a) AS aa, sum(q * b) AS bb FROM ab{n} JOIN q{n} USING (sample_id) GROUP BY ALL),
 p{n + 1} AS (SELECT variant_id, k, {CLIP % "aa * p / (p * (aa - bb) + bb)"} AS p FROM s{n} JOIN p{n} USING (variant_id, k)),
 t{n} AS (SELECT sample_id, k, sum(p * (a - b) + b) / (2 * count(*)) AS t FROM ab{n} JOIN p{n} USING (variant_id) GROUP BY ALL),
 c{n} AS (SELECT sample_id, k, {CLIP % "q * t"} AS c FROM t{n} JOIN q{n} USING (sample_id, k)),
 q{n + 1} AS (SELECT sample_id, k, c / sum(c) OVER (PARTITION BY sample_id) AS q FROM c{n})"""


HELD = "greatest(1e-10::DOUBLE, least((1 - 1e-10)::DOUBLE, r))"
NEWTON = f"{START}, {expected_sql(0)}, h AS (SELECT sample_id, variant_id, g / {HELD} AS u, (2 - g) / (1 - {HELD}) AS w, {HELD} AS r FROM r0)"
TEN = f"ten AS (SELECT vec_id AS sample_id, (generate_subscripts(embedding, 1) - 1)::INT AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), rows AS (SELECT * FROM ten WHERE k < {K})"
M64 = "18446744073709551616::UHUGEINT"
FOLDS = f"""{DENSE}, h0 AS (SELECT sample_id, variant_id, g, ((variant_id::UHUGEINT * (SELECT count(*) FROM embeddings)::UHUGEINT + sample_id::UHUGEINT + 42 + {folds.STEP}::UHUGEINT) % {M64})::UBIGINT AS x FROM dense WHERE g <> 3),
 h1 AS (SELECT * EXCLUDE x, ((xor(x, x >> 30)::UHUGEINT * {folds.FIRST}::UHUGEINT) % {M64})::UBIGINT AS x FROM h0),
 h2 AS (SELECT * EXCLUDE x, ((xor(x, x >> 27)::UHUGEINT * {folds.SECOND}::UHUGEINT) % {M64})::UBIGINT AS x FROM h1),
 folded AS (SELECT sample_id, variant_id, g, (xor(x, x >> 31) % 5)::INT AS fold FROM h2)"""
MEASURES = """sqrt(avg(pow(a - b, 2))) AS rmse,
  (sum(a * ln(a / ((a + b) / 2) + 1e-10)) + sum(b * ln(b / ((a + b) / 2) + 1e-10))) / count(DISTINCT sample_id) / 2 AS jsd,
  sqrt(sum(pow(a - b, 2))) AS frobenius, sum(pow(a - b, 2)) / (2 * count(DISTINCT sample_id)) AS cost"""

ORACLES: dict[str, str] = {
    "geno_long_dense": f"WITH {DENSE} SELECT * FROM dense",
    "geno_long_sparse": f"WITH {SPARSE} SELECT * FROM sparse",
    "allele_freq": f"WITH {DENSE} SELECT variant_id, {FREQS} FROM dense GROUP BY 1",
    "allele_freq_autosomes": f"WITH {SPARSE}, {VARIANTS} SELECT variant_id, {FREQS} FROM sparse WHERE variant_id IN (SELECT variant_id FROM variants WHERE number BETWEEN 1 AND 22) GROUP BY 1",
    "allele_freq_chrom_list": f"WITH {SPARSE}, {VARIANTS} SELECT variant_id, {FREQS} FROM sparse WHERE variant_id IN (SELECT variant_id FROM variants WHERE number IN (11, 12) OR chrom = 'chrX') GROUP BY 1",
    "skipped_variants": f"WITH {VARIANTS}, k AS (SELECT coalesce(number BETWEEN 1 AND 22, false) AS keep FROM variants) SELECT count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS skipped FROM k",
    "global_mean_and_flip": f"WITH {SPARSE} SELECT round({FREQ}, 6) AS mean, {FREQ} >= 0.5 AS flip FROM sparse",
    "flipped_counts": f"WITH {SPARSE}, m AS (SELECT {FREQ} >= 0.5 AS flip FROM sparse) SELECT CASE WHEN flip AND g <> 3 THEN 2 - g ELSE g END AS g, count(*) AS n FROM sparse, m GROUP BY 1",
    "sample_call_counts": f"WITH {DENSE} SELECT sample_id, 2 * {OBSERVED} AS n_alleles, count(*) FILTER (g = 3) AS n_missing FROM dense GROUP BY 1",
    "variant_missingness": f"WITH {DENSE} SELECT variant_id, count(*) FILTER (g = 3) AS n_missing, round((count(*) FILTER (g = 3)) / count(*)::DOUBLE, 6) AS share FROM dense GROUP BY 1",
    "pack_2bit": f"WITH {DENSE} SELECT sample_id, (variant_id // 4)::BIGINT AS block, sum(g * (1 << (2 * (variant_id % 4))))::INT AS byte FROM dense GROUP BY ALL",
    "unpack_2bit_roundtrip": f"WITH {DENSE} SELECT sample_id, g, count(*) AS n FROM dense GROUP BY ALL",
    "centered_moments": f"WITH {DENSE}, f AS (SELECT variant_id, {FREQ} AS f FROM dense GROUP BY 1), x AS (SELECT variant_id, CASE WHEN g <> 3 THEN g - 2 * f ELSE 0 END AS x FROM dense JOIN f USING (variant_id)) SELECT variant_id, abs(round(avg(x), 6)) AS mean, round(sum(x * x), 6) AS sum_squares FROM x GROUP BY 1",
    "gram_by_variant": f"WITH {DENSE}, f AS (SELECT variant_id, {FREQ} AS f FROM dense GROUP BY 1), s AS (SELECT a.variant_id AS i, b.variant_id AS j, count(*) AS n, sum(a.g)::BIGINT AS ga, sum(b.g)::BIGINT AS gb, sum(a.g * b.g)::BIGINT AS gg FROM dense a JOIN dense b ON a.sample_id = b.sample_id AND a.variant_id <= b.variant_id AND a.g <> 3 AND b.g <> 3 GROUP BY ALL) SELECT i, j, round(gg - 2 * fj.f * ga - 2 * fi.f * gb + 4 * fi.f * fj.f * n, 2) AS xx FROM s JOIN f fi ON fi.variant_id = i JOIN f fj ON fj.variant_id = j",
    "pop_freq": f"WITH {DENSE}, {POP} SELECT variant_id, k, round(p, 6) AS p FROM p0",
    "first_seen_labels": f"WITH {SAMPLES}, f AS (SELECT label1 AS label, min(sample_id) AS first_sample FROM samples GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_sample)::INT AS y FROM f",
    "supervised_q_init": f"WITH {KS} SELECT vec_id AS sample_id, k, round(CASE WHEN label >= 7 THEN 1.0::DOUBLE / {K} WHEN k = label THEN 1 - {EPS}::DOUBLE ELSE {EPS}::DOUBLE / {K - 1} END, 6) AS q FROM embeddings, ks",
    "loglik_by_variant": f"{START}, {expected_sql(0)} SELECT variant_id, round(sum(g * ln(r) + (2 - g) * ln(1 - r)), 4) AS loglik FROM r0 GROUP BY 1",
    "loglik_total": f"{START}, {expected_sql(0)} SELECT round(sum(g * ln(r) + (2 - g) * ln(1 - r)), 2) AS loglik FROM r0",
    "em_step_p": f"{START}, {em_sql(0)} SELECT variant_id, k, round(p, 6) AS p FROM p1",
    "em_step_q": f"{START}, {em_sql(0)} SELECT sample_id, k, round(q, 6) AS q FROM q1",
    "em_two_steps": f"{START}, {em_sql(0)}, {em_sql(1)} SELECT sample_id, k, round(q, 6) AS q FROM q2",
    "adam_step_q": f"{START}, {em_sql(0)}, d AS (SELECT sample_id, k, q0.q, q1.q - q0.q AS d FROM q0 JOIN q1 USING (sample_id, k)), c AS (SELECT sample_id, k, {CLIP % 'q + 0.005::DOUBLE * d / (sqrt(d * d) + 1e-8::DOUBLE)'} AS c FROM d) SELECT sample_id, k, round(c / sum(c) OVER (PARTITION BY sample_id), 6) AS q FROM c",
    "grad_q": f"{NEWTON} SELECT sample_id, k, round(sum(u * p + w * (1 - p)), 3) AS grad FROM h JOIN p0 USING (variant_id) GROUP BY ALL",
    "hess_q": f"{NEWTON} SELECT sample_id, a.k AS i, b.k AS j, round(sum(u / r * a.p * b.p + w / (1 - r) * (1 - a.p) * (1 - b.p)), 1) AS value FROM h JOIN p0 a USING (variant_id) JOIN p0 b USING (variant_id) GROUP BY ALL",
    "grad_p": f"{NEWTON} SELECT variant_id, k, round(sum((u - w) * q), 3) AS grad FROM h JOIN q0 USING (sample_id) GROUP BY ALL",
    "hess_p": f"{NEWTON} SELECT variant_id, a.k AS i, b.k AS j, round(sum((u / r + w / (1 - r)) * a.q * b.q), 1) AS value FROM h JOIN q0 a USING (sample_id) JOIN q0 b USING (sample_id) GROUP BY ALL",
    "clip_p": f"WITH {TEN} SELECT sample_id, k, round({CLIP % 'x'}, 6) AS p FROM ten",
    "normalize_q": f"WITH {TEN}, c AS (SELECT sample_id, k, {CLIP % 'x'} AS c FROM rows) SELECT sample_id, k, round(c / sum(c) OVER (PARTITION BY sample_id), 6) AS q FROM c",
    "simplex_projection_q": f"""WITH {TEN}, b AS (SELECT sample_id, k, x - {EPS}::DOUBLE AS b, row_number() OVER (PARTITION BY sample_id ORDER BY x DESC) AS i FROM rows),
 s AS (SELECT *, (sum(b) OVER (PARTITION BY sample_id ORDER BY i) - (1 - {K} * {EPS}::DOUBLE)) / i AS theta, lead(b) OVER (PARTITION BY sample_id ORDER BY i) AS nxt FROM b),
 t AS (SELECT sample_id, arg_min(s.theta, i) AS theta FROM s WHERE nxt IS NULL OR theta >= nxt GROUP BY 1)
 SELECT sample_id, k, round(greatest(b - theta, 0) + {EPS}::DOUBLE, 6) AS q FROM b JOIN t USING (sample_id)""",
    "cv_folds_hash": f"WITH {FOLDS} SELECT sample_id, variant_id, fold FROM folded",
    "cv_fold_sizes": f"WITH {FOLDS} SELECT fold, count(*) AS n FROM folded GROUP BY 1",
    "cv_masked_freq": f"WITH {FOLDS}, m AS (SELECT variant_id, CASE WHEN fold = 0 THEN 3 ELSE g END AS g FROM folded) SELECT variant_id, {FREQS} FROM m GROUP BY 1",
    "cv_deviance": f"""WITH {FOLDS}, {POP}, q0 AS (SELECT vec_id AS sample_id, k, CASE WHEN k = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END AS q FROM embeddings, ks),
 r AS (SELECT o.sample_id, o.variant_id, o.g, 2 * sum(p * q) AS mu FROM folded o JOIN q0 USING (sample_id) JOIN p0 USING (variant_id, k) WHERE fold = 0 GROUP BY ALL)
 SELECT round(sum(CASE WHEN g > 0 THEN g * ln(g / mu) ELSE 0 END + CASE WHEN g < 2 THEN (2 - g) * ln((2 - g) / (2 - mu)) ELSE 0 END) / count(*), 6) AS cv_index, count(*) AS n FROM r""",
    "cluster_cost_matrix": f"WITH {RUNS} SELECT a.k AS k1, b.k AS k2, round(avg(pow(a.q - b.q, 2)), 6) AS cost FROM q0 a JOIN q1 b USING (sample_id) GROUP BY ALL",
    "run_pair_cost": f"WITH {RUN_PAIRS}, m AS (SELECT run1, run2, {MEASURES} FROM pairs GROUP BY 1, 2) SELECT run1, run2, round(rmse, 6) AS rmse, round(jsd, 6) AS jsd, round(frobenius, 6) AS frobenius, round(cost, 6) AS cost FROM m",
    "rmse_runs": f"WITH {QTRUE}, {q_est_sql('q0', 0, 3)}, two AS (SELECT 0 AS run_id, * FROM qtrue UNION ALL SELECT 1, * FROM q0), {matched_sql('two')}, m AS (SELECT {MEASURES} FROM pairs) SELECT round(rmse, 6) AS rmse, round(jsd, 6) AS jsd FROM m",
    "corr_runs": f"WITH {RUN_PAIRS}, c AS (SELECT run1, run2, k, corr(a, b) AS r FROM pairs GROUP BY ALL) SELECT run1, run2, round(avg(r), 6) AS correlation FROM c GROUP BY ALL",
    "stability_summary": f"WITH {RUN_PAIRS}, c AS (SELECT run1, run2, k, corr(a, b) AS r FROM pairs GROUP BY ALL), d AS (SELECT run1, run2, avg(r) AS r FROM c GROUP BY ALL), m AS (SELECT run1, run2, {MEASURES} FROM pairs GROUP BY 1, 2) SELECT round(avg(r), 6) AS corr_mean, round(stddev_pop(r), 6) AS corr_std, round(avg(frobenius), 6) AS frob_mean, round(stddev_pop(frobenius), 6) AS frob_std FROM d JOIN m USING (run1, run2)",
    "merge_clusters": f"WITH {KS}, {q_est_sql('q0', 0, 0)} SELECT sample_id, k // 2 AS k, round(sum(q), 6) AS q FROM q0 GROUP BY ALL",
    "representative_run": f"WITH {RUN_PAIRS}, m AS (SELECT run1, run2, {MEASURES} FROM pairs GROUP BY 1, 2), b AS (SELECT run1 AS run_id, cost FROM m UNION ALL SELECT run2, cost FROM m), t AS (SELECT run_id, sum(cost) AS total FROM b GROUP BY 1) SELECT run_id, round(total, 6) AS total FROM t ORDER BY round(t.total, 12), run_id LIMIT 1",
    "mode_mean_q": f"WITH {RUN_PAIRS}, a AS (SELECT sample_id, k, q FROM runs WHERE run_id = 0 UNION ALL SELECT sample_id, k, b FROM pairs WHERE run1 = 0) SELECT sample_id, k, round(avg(q), 6) AS q FROM a GROUP BY ALL",
    "community_rank": "WITH s AS (SELECT c_nationkey AS community, count(*) AS size, min(c_custkey) AS first_run FROM customer GROUP BY 1) SELECT *, row_number() OVER (ORDER BY size DESC, first_run)::INT AS rank FROM s",
    "dominant_cluster": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, m AS (SELECT sample_id, max(q) AS share FROM q0 GROUP BY 1) SELECT sample_id, min(k) AS cluster, round(any_value(share), 6) AS share FROM q0 JOIN m USING (sample_id) WHERE q = share GROUP BY 1",
    "sample_sort_order": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, m AS (SELECT sample_id, max(round(q, 9)) AS share FROM q0 GROUP BY 1), d AS (SELECT sample_id, min(k) AS cluster, any_value(share) AS share FROM q0 JOIN m USING (sample_id) WHERE round(q, 9) = share GROUP BY 1) SELECT sample_id, row_number() OVER (ORDER BY label, cluster, share, sample_id) - 1 AS pos FROM d JOIN embeddings ON vec_id = sample_id",
    "label_segments": "WITH i AS (SELECT label, vec_id AS pos, vec_id - row_number() OVER (PARTITION BY label ORDER BY vec_id) AS island FROM embeddings) SELECT label, min(pos) AS first_pos, max(pos) AS last_pos, (min(pos) + max(pos) + 1) / 2 AS tick FROM i GROUP BY label, island",
    "cumulative_bars": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, h AS (SELECT sample_id, k, q, sum(q) OVER (PARTITION BY sample_id ORDER BY k) AS high FROM q0) SELECT sample_id, k, abs(round(high - q, 6)) AS low, round(high, 6) AS high FROM h",
    "label_hierarchy_conflicts": "SELECT c_mktsegment AS child, count(DISTINCT c_nationkey) AS parents FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1",
    "label_contiguity": f"WITH {SAMPLES} SELECT label1 AS label, count(*) AS n, max(sample_id) - min(sample_id) + 1 = count(*) AS contiguous FROM samples GROUP BY 1",
    "group_cluster_order": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, t AS (SELECT label, k, round(sum(q), 9) AS total FROM q0 JOIN embeddings ON vec_id = sample_id GROUP BY ALL) SELECT label, k, round(t.total, 6) AS total, row_number() OVER (PARTITION BY label ORDER BY t.total DESC, k)::INT AS place FROM t",
    "loglik_inverse_p": f"{START}, pi AS (SELECT variant_id, k, 1 - p AS p FROM p0), r0 AS (SELECT o.sample_id, o.variant_id, o.g, sum(p * q) AS r FROM dense o JOIN q0 USING (sample_id) JOIN pi USING (variant_id, k) WHERE g <> 3 GROUP BY ALL) SELECT round(sum(g * ln(r) + (2 - g) * ln(1 - r)), 2) AS loglik FROM r0",
    "membership_check": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, CASE WHEN min(x) < 0 OR max(x) > 1 THEN 'range' WHEN abs(sum(x) - 1) > 1e-6 THEN 'sum' END AS problem FROM x GROUP BY 1) SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1",
    "inverse_mapping": f"WITH {RUN_PAIRS} SELECT run2, k, k2 FROM cols WHERE run1 = 0 UNION ALL SELECT -1, k2, k FROM cols WHERE run1 = 0 AND run2 = 1",
    "runs_by_k": f"WITH {RUNS}, s AS (SELECT run_id, max(k) + 1 AS n_clusters FROM runs GROUP BY 1) SELECT n_clusters, count(*) AS runs, min(run_id) AS first_run FROM s GROUP BY 1",
    "cv_folds_shuffled": f"WITH {FOLDS}, r AS (SELECT sample_id, variant_id, row_number() OVER (ORDER BY xor(x, x >> 31), variant_id, sample_id) - 1 AS place FROM h2) SELECT sample_id, variant_id, (place % 5)::INT AS fold FROM r",
    "sample_order_unlabelled": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, m AS (SELECT sample_id, max(round(q, 9)) AS share FROM q0 GROUP BY 1), d AS (SELECT sample_id, min(k) AS cluster, any_value(share) AS share FROM q0 JOIN m USING (sample_id) WHERE round(q, 9) = share GROUP BY 1) SELECT sample_id, row_number() OVER (ORDER BY cluster, share, sample_id) - 1 AS pos FROM d",
    "sample_order_two_levels": f"WITH {SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY label2, label1, sample_id) - 1 AS pos FROM samples",
    "group_tick_positions": "WITH p AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM embeddings) SELECT label, avg(pos) + 0.5 AS tick, max(pos)::DOUBLE + 0.5 AS boundary FROM p GROUP BY 1",
    "order_in_groups": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, r AS (SELECT sample_id, label, k, round(q, 9) AS q FROM q0 JOIN embeddings ON vec_id = sample_id), t AS (SELECT label, k, round(sum(q), 9) AS total FROM r GROUP BY ALL), l AS (SELECT r.sample_id, r.label, list(-q ORDER BY t.total DESC, r.k) AS shares FROM r JOIN t ON t.label = r.label AND t.k = r.k GROUP BY ALL) SELECT sample_id, label, (row_number() OVER (PARTITION BY label ORDER BY shares, sample_id) - 1)::INT AS place FROM l",
    "combined_sweep_bars": f"WITH {KS}, {q_est_sql('q0', 0, 0)}, m AS (SELECT sample_id, max(round(q, 9)) AS share FROM q0 GROUP BY 1), d AS (SELECT sample_id, min(k) AS cluster, any_value(share) AS share FROM q0 JOIN m USING (sample_id) WHERE round(q, 9) = share GROUP BY 1), o AS (SELECT sample_id, row_number() OVER (ORDER BY cluster, share, sample_id) - 1 AS pos FROM d), a AS (SELECT {K} AS k_total, sample_id, k, q FROM q0 UNION ALL SELECT {K // 2}, sample_id, k // 2, sum(q) FROM q0 GROUP BY ALL), h AS (SELECT k_total, pos, k, q, sum(q) OVER (PARTITION BY k_total, pos ORDER BY k) AS high FROM a JOIN o USING (sample_id)) SELECT k_total, pos, k, abs(round(high - q, 6)) AS low, round(high, 6) AS high FROM h",
}
