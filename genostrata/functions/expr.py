"""Column expressions on genotypes, frequencies and ancestry proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genotype code of a missing call, and the bound that keeps P and Q off 0 and 1.
MISSING, EPS = 3, 1e-5


def observed(g: Column | str = "g") -> Column:
    return (F.col(g) if isinstance(g, str) else g) != MISSING


def clip(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def clip_array(x: Column | str) -> Column:
    return F.transform(x, clip)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def normalized(q: Column | str) -> Column:
    """Each element clipped, then all divided by their sum."""
    c = clip_array(q)
    return F.transform(c, lambda x: x / array_sum(c))


def simplex_projection(b: Column | str, k: int) -> Column:
    """The nearest point whose elements are at least EPS and sum to 1.

    With the elements above the floor in falling order, the cut theta is that of the first prefix
    whose mean excess is not below the next element, or of all of them.
    """
    mass = 1 - k * EPS
    above = F.transform(b, lambda x: x - EPS)
    falling = F.sort_array(above, asc=False)
    theta = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda n: F.struct(((array_sum(F.slice(falling, 1, n)) - mass) / n).alias("theta"), F.get(falling, n).alias("next")),
    )
    first = F.get(F.filter(theta, lambda t: t["next"].isNull() | (t["theta"] >= t["next"])), F.lit(0))["theta"]
    return F.transform(above, lambda x: F.greatest(x - first, F.lit(0.0)) + EPS)


def chromosome_number(chrom: Column | str) -> Column:
    """The number in a chromosome label, with or without `chr`; null if it is not a number."""
    c = F.trim(F.col(chrom) if isinstance(chrom, str) else chrom)
    return F.regexp_extract(c, r"^(?i:chr)?([0-9]+)$", 1).try_cast("int")


def is_autosome(chrom: Column | str, autosomes: int = 22) -> Column:
    return F.coalesce(chromosome_number(chrom).between(1, autosomes), F.lit(False))


def in_chromosomes(chrom: Column | str, wanted: str | list[str]) -> Column:
    """Whether a label is one of a list: numbers by value, other labels by name in any case."""
    items = list(dict.fromkeys(x for part in ([wanted] if isinstance(wanted, str) else wanted) for x in part.replace(",", " ").split()))
    bare = [x.lower().removeprefix("chr") for x in items]
    name = F.regexp_replace(F.lower(F.trim(F.col(chrom) if isinstance(chrom, str) else chrom)), "^chr", "")
    numbers = [int(x) for x in bare if x.isdigit()]
    names = [x for x in bare if not x.isdigit()]
    return F.coalesce(chromosome_number(chrom).isin(numbers), F.lit(False)) | name.isin(names)


def flipped(g: Column, flip: Column) -> Column:
    """The genotype counted by the other allele."""
    return F.when(flip & (g != MISSING), 2 - g).otherwise(g)


def centered(g: Column, f: Column) -> Column:
    return F.when(g != MISSING, g - 2 * f).otherwise(F.lit(0.0))


def gt_genotype(field: Column) -> Column:
    """The genotype of a VCF sample field: its first two alleles counted, haploid calls doubled."""
    gt = F.regexp_replace(F.split(field, ":")[0], r"\r$", "")
    parts = r"^([0-9]+|[.-]?)(?:[^0-9.:-]([0-9]+|[.-]?))?"
    a, b = F.regexp_extract(gt, parts, 1), F.regexp_extract(gt, parts, 2)
    na, nb = a.try_cast("int"), b.try_cast("int")
    haploid = ~gt.rlike(r"^[0-9]+[^0-9]")
    one = F.when(na <= 1, 2 * na)
    two = F.when(na + nb <= 2, na + nb)
    return F.coalesce(F.when(na.isNull(), F.lit(None).cast("int")).when(haploid, one).otherwise(two), F.lit(MISSING))


def log_likelihood(g: Column, r: Column) -> Column:
    """Of one observed genotype given the expected allele frequency r."""
    return g * F.ln(r) + (2 - g) * F.log1p(-r)


def half_deviance(g: Column, r: Column) -> Column:
    """Of one observed genotype, with the mean held off 0 and 2."""
    mu = F.greatest(F.lit(1e-10), F.least(F.lit(2 - 1e-10), 2 * r))
    return F.when(g > 0, g * F.ln(g / mu)).otherwise(0.0) + F.when(g < 2, (2 - g) * F.ln((2 - g) / (2 - mu))).otherwise(0.0)
