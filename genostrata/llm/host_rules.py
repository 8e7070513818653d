"""Quality rules of documents, and verdicts on whole hosts from how often their documents fail.

Each document is measured by itself. For each host and rule the failures are counted, and the rate
is shrunk towards all hosts by a beta prior whose two parameters come from the hosts' own rates
(method of moments, hosts weighing as their documents). A host whose shrunk rate of a rule is above
the rule's limit is rejected, with all its documents.

Defined results: a null text has no words and fails as too short; a null host is no host and is
never rejected as one; a table with fewer than two hosts, or whose hosts don't differ by more than
chance, gets the strongest prior (all hosts are shrunk to the common rate); repeated rows each count
and each keep their row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, in_batches, small_or_shuffled, with_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: Percent of a text's words in repeated windows above which it fails.
MOST_REPEATED = 50
WINDOW = 3
#: Weight of the prior, in documents, when hosts differ by no more than chance.
STRONGEST = 1e6
#: A rule's shrunk failure rate above which its host is rejected.
LIMITS = {"short": 0.5, "repeats": 0.5, "symbols": 0.6, "dup_lines": 0.6}


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """MEASURES of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif line.strip(" \t\x0b\x0c\r"):
            lines.add(line)
    n, repeated = len(words), 0
    if n > WINDOW:
        first: dict[tuple[bytes, ...], int] = {}
        again: set[int] = set()
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if (j := first.setdefault(w, i)) != i:
                again.add(i)
                again.add(j)
        if again:
            covered = bytearray(n)
            for i in again:
                covered[i : i + WINDOW] = b"\1\1\1"
            repeated = covered.count(1)
    return n, chars, symbols, dup, repeated


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, its text left out, with MEASURES."""
    kept = [c for c in docs.columns if c != text and c not in MEASURES]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(m, T.LongType(), False) for m in MEASURES])
    source, place = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(x.as_py()) for x in batch.column(place)]
            new = [pa.array(x, pa.int64()) for x in zip(*got)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *MEASURES])

    return in_batches(source, run, schema)


def rules() -> dict[str, Column]:
    """Whether a document fails each rule."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 10 * F.col("n_symbols") > 3 * F.greatest(n, F.lit(1)),
        "dup_lines": 4 * F.col("n_dup_lines") > F.greatest(n, F.lit(1)),
    }


def host_rates(docs: DataFrame, host: str = "host") -> DataFrame:
    """For each host, its documents n, and for each rule the failures f_, and the shrunk rate p_.

    Counts are summed before they are shuffled, so a host with very many documents costs no more.
    The prior is one row.
    """
    names = list(rules())
    hosts = docs.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules().items())
    )
    hosts = durable(hosts)
    total = F.sum("n")
    common = hosts.agg(total.alias("all_n"), F.count(F.lit(1)).alias("all_h"), F.sum(F.pow("n", F.lit(2.0))).alias("all_n2"), *(F.try_divide(F.sum(f"f_{r}"), total).alias(f"m_{r}") for r in names))
    spread = hosts.crossJoin(F.broadcast(common)).groupBy("all_n", "all_h", "all_n2", *(f"m_{r}" for r in names)).agg(
        *(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.col(f"m_{r}"), F.lit(2.0))).alias(f"s_{r}") for r in names)
    )
    # E[s] = m(1-m)(H-1) + v(N - N2/N) for a variance v between hosts; v = m(1-m)/(a+b+1)
    prior = []
    for r in names:
        m = F.col(f"m_{r}")
        between = F.try_divide(F.col(f"s_{r}") - m * (1 - m) * (F.col("all_h") - 1), F.col("all_n") - F.try_divide(F.col("all_n2"), F.col("all_n").cast("double")))
        weight = F.when(between > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(1.0), m * (1 - m) / between - 1))).otherwise(F.lit(STRONGEST))
        prior += [m, weight.alias(f"w_{r}")]
    return hosts.crossJoin(F.broadcast(spread.select(*prior))).select(
        host, "n", *(f"f_{r}" for r in names), *(((F.col(f"f_{r}") + F.col(f"m_{r}") * F.col(f"w_{r}")) / (F.col("n") + F.col(f"w_{r}"))).alias(f"p_{r}") for r in names)
    )


def verdicts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs without its text, with MEASURES, base_failed, and kept.

    The hosts' rates are joined back by broadcast when they were counted to be few; else as rejected
    hosts only, by a shuffle that splits large hosts.
    """
    m = durable(measured(docs, text))
    rates = host_rates(m.select(F.col(f"`{host}`").alias("__host"), *MEASURES), "__host")
    bad = None
    for r, limit in LIMITS.items():
        c = F.col(f"p_{r}") > limit
        bad = c if bad is None else bad | c
    rejected = small_or_shuffled(rates.where(bad).select(F.col("__host"), F.lit(True).alias("__bad")))
    fails = rules()
    m = m.withColumn("base_failed", fails["short"] | fails["repeats"])
    names = [c for c in m.columns if c != "kept"]
    # the rows travel in one column, whatever their columns are named
    rows = m.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{host}`").alias("_host"))
    joined = rows.join(rejected, F.col("_host") == F.col("__host"), "left")
    return joined.select(*(F.col(f"_row.`{c}`") for c in names), (~F.col("_row.base_failed") & F.col("__bad").isNull()).alias("kept"))
