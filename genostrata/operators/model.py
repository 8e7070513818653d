"""The admixture model as DataFrame operations: g ~ Binomial(2, sum_k p_k q_k).

P is (variant_id, p array), Q is (sample_id, q array), genotypes are (sample_id, variant_id, g). All
sums are grouped aggregations with partial sums before the shuffle; each genotype row carries two
short arrays, so nothing is expanded by population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, clip_array, dot, half_deviance, log_likelihood, normalized, observed


def sums(terms: list[Column]) -> Column:
    return F.array(*(F.sum(t) for t in terms))


def expected(geno: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """Observed genotypes with p, q and r, the expected allele frequency."""
    return geno.where(observed()).select("sample_id", "variant_id", "g").join(q, "sample_id").join(p, "variant_id").withColumn("r", dot("p", "q"))


def log_likelihood_by_variant(geno: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    return expected(geno, p, q).groupBy("variant_id").agg(F.sum(log_likelihood(F.col("g"), F.col("r"))).alias("loglik"))


def em_terms(geno: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    return expected(geno, p, q).withColumn("a", F.col("g") / F.col("r")).withColumn("b", (2 - F.col("g")) / (1 - F.col("r")))


def em_step(geno: DataFrame, p: DataFrame, q: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The next P and Q, both from the given ones."""
    t = em_terms(geno, p, q)
    pk, qk = (lambda i: F.col("p")[i]), (lambda i: F.col("q")[i])
    stats = t.groupBy("variant_id").agg(F.first("p").alias("p"), sums([qk(i) * F.col("a") for i in range(k)]).alias("A"), sums([qk(i) * F.col("b") for i in range(k)]).alias("B"))
    new_p = stats.select(
        "variant_id",
        F.array(*(clip(F.col("A")[i] * pk(i) / (pk(i) * (F.col("A")[i] - F.col("B")[i]) + F.col("B")[i])) for i in range(k))).alias("p"),
    )
    totals = t.groupBy("sample_id").agg(
        F.first("q").alias("q"), sums([pk(i) * (F.col("a") - F.col("b")) + F.col("b") for i in range(k)]).alias("T"), (2 * F.count(F.lit(1))).alias("n")
    )
    new_q = totals.select("sample_id", normalized(F.array(*(qk(i) * F.col("T")[i] / F.col("n") for i in range(k)))).alias("q"))
    # what has no call keeps what it had
    new_p = p.select("variant_id", F.col("p").alias("old")).join(new_p, "variant_id", "left").select("variant_id", F.coalesce("p", "old").alias("p"))
    new_q = q.select("sample_id", F.col("q").alias("old")).join(new_q, "sample_id", "left").select("sample_id", F.coalesce("q", "old").alias("q"))
    return new_p, new_q


def adam_step_q(q: DataFrame, target: DataFrame, m: Column, v: Column, step: int, lr: float = 0.005, b1: float = 0.80, b2: float = 0.88, eps: float = 1e-8) -> DataFrame:
    """(sample_id, q, m, v): one adaptive step of Q towards an EM target; m and v are array columns of q."""
    d = F.zip_with("new", "q", lambda x, y: x - y)
    joined = q.withColumn("m", m).withColumn("v", v).join(target.select("sample_id", F.col("q").alias("new")), "sample_id").withColumn("d", d)
    joined = joined.withColumn("m", F.zip_with("m", "d", lambda x, y: b1 * x + (1 - b1) * y)).withColumn("v", F.zip_with("v", "d", lambda x, y: b2 * x + (1 - b2) * y * y))
    moved = F.zip_with(
        "q", F.zip_with("m", "v", lambda x, y: lr * (x / (1 - b1**step)) / (F.sqrt(y / (1 - b2**step)) + eps)), lambda x, y: x + y
    )
    return joined.select("sample_id", normalized(moved).alias("q"), "m", "v")


def held(r: Column) -> Column:
    return F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), r))


def newton_q(geno: DataFrame, p: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(sample_id, grad, hess): gradient and Hessian, row by row, of the log-likelihood in Q."""
    t = expected(geno, p, q).withColumn("r", held(F.col("r")))
    u, w = F.col("g") / F.col("r"), (2 - F.col("g")) / (1 - F.col("r"))
    u2, w2 = u / F.col("r"), w / (1 - F.col("r"))
    pk = lambda i: F.col("p")[i]
    return t.groupBy("sample_id").agg(
        sums([u * pk(i) + w * (1 - pk(i)) for i in range(k)]).alias("grad"),
        sums([u2 * pk(i) * pk(j) + w2 * (1 - pk(i)) * (1 - pk(j)) for i in range(k) for j in range(k)]).alias("hess"),
    )


def newton_p(geno: DataFrame, p: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(variant_id, grad, hess) of the log-likelihood in P."""
    t = expected(geno, p, q).withColumn("r", held(F.col("r")))
    u, w = F.col("g") / F.col("r"), (2 - F.col("g")) / (1 - F.col("r"))
    qk = lambda i: F.col("q")[i]
    return t.groupBy("variant_id").agg(
        sums([(u - w) * qk(i) for i in range(k)]).alias("grad"),
        sums([(u / F.col("r") + w / (1 - F.col("r"))) * qk(i) * qk(j) for i in range(k) for j in range(k)]).alias("hess"),
    )


def cv_deviance(held_out: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: the mean half deviance of held-out genotypes."""
    return expected(held_out, p, q).agg((F.sum(half_deviance(F.col("g"), F.col("r"))) / F.count(F.lit(1))).alias("cv_index"), F.count(F.lit(1)).alias("n"))


def clip_p(p: DataFrame) -> DataFrame:
    return p.withColumn("p", clip_array("p"))
