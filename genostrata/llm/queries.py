"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, embed_dedup, host_rules, html_extract, lang_id, licenses, line_quality, mixing, ngram_join, pii, secret_scan, vector_codes
from .common import durable, table, told

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def bpe_digest(docs: DataFrame) -> DataFrame:
    tokens = bpe.encode(docs.select("doc_id", "text"), bpe.read_vocabulary(WORD_BPE), ids="ids", decoded="decoded", keep_text=False)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of all documents, as digests."""
    return bpe_digest(table(spark, sf_dir, "documents"))


def secret_digest(docs: DataFrame) -> DataFrame:
    found = secret_scan.scan(docs.select("doc_id", "text"), into="found")
    base = F.filter("found", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as they stand and below nested encodings."""
    return secret_digest(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents and the verdict on each, with sources as hosts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules.verdicts(docs).select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


# the rules, the prior and the limits of host_rules in SQL
ORACLES["op3_quality"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, source, i, w[i] || chr(32) || w[i+1] || chr(32) || w[i+2] AS g
  FROM (SELECT doc_id, source, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id),
r AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         10 * n_symbols > 3 * greatest(n_words, 1) AS symbols, 4 * n_dup_lines > greatest(n_words, 1) AS dups
  FROM m),
h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(fails::INT)::DOUBLE AS f
  FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([short, repeats, symbols, dups]) AS fails FROM r WHERE source IS NOT NULL)
  GROUP BY source, rule),
c AS (SELECT rule, sum(n) AS nn, count(*) AS hh, sum(n * n) AS n2, sum(f) / sum(n) AS mean FROM h GROUP BY rule),
s AS (SELECT h.rule, nn, hh, n2, mean, sum(n * pow(f / n - mean, 2)) AS s FROM h JOIN c USING (rule) GROUP BY ALL),
b AS (SELECT rule, mean, CASE WHEN nn - n2 / nn <> 0 THEN (s - mean * (1 - mean) * (hh - 1)) / (nn - n2 / nn) END AS v FROM s),
p AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(1e6, greatest(1, mean * (1 - mean) / v - 1)) ELSE 1e6 END AS wt FROM b),
bad AS (
  SELECT DISTINCT source FROM h JOIN p USING (rule)
  WHERE (f + mean * wt) / (n + wt) > CASE rule WHEN 'short' THEN 0.5 WHEN 'repeats' THEN 0.5 ELSE 0.6 END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND source NOT IN (SELECT source FROM bad) IS NOT FALSE AS kept
FROM r
"""


#: Weights of the mix, repeated along the sources, and its size as a share of all words.
MIX_WEIGHTS, MIX_SHARE = (5.0, 2.0, 1.0), 1.5


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = durable(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    weights = mixing.repeating_weights(mixing.source_names(docs), MIX_WEIGHTS)
    # the passes that take a document are at most two rows of it; rows of the same doc_id stay apart
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    mixed = mixing.mix(rows, weights, MIX_SHARE)
    return (
        mixed.groupBy("row")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.count("shard").alias("times"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
    )


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by a network learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = lang_id.learned(docs)
    found = lang_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, and each one's number of links."""
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


ORACLES["op10_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (
  SELECT a AS v, b AS w FROM l
  UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
c AS (SELECT v, least(v, min(w)) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.v = e.vec_id
"""


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of license templates in all documents."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("coverage", F.round("coverage", 6))


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


# the same text for pages that have one article and no boilerplate inside it, as the tables do
ORACLES["op6_html"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS block
  FROM (SELECT page_id, string_split(regexp_replace(body, '</?(p|h1|h2|h3|ul|ol|li|div)(\s[^>]*)?>', chr(1), 'g'), chr(1)) AS bs FROM a)),
t AS (
  SELECT page_id, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(block, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', chr(160)), '&amp;?', '&', 'g'), '[\s\x{a0}]+', ' ', 'g')) AS line
  FROM b),
j AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM t WHERE line <> '' GROUP BY page_id)
SELECT a.page_id, a.url, coalesce(j.text, '') AS text, length(coalesce(j.text, ''))::BIGINT AS n_chars
FROM a LEFT JOIN j ON j.page_id = a.page_id
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates")


#: Parts of a vector, entries of a codebook and rounds of its fit.
CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS = 8, 16, 6


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, and the errors of their labels."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = vector_codes.compress(vectors, parts=CODE_PARTS, entries=CODE_ENTRIES, rounds=CODE_ROUNDS)
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = durable(coded.select("vec_id", label.alias("_label"), F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "").alias("code"), "error"))
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    facts = rows.groupBy("_label").agg(total.cast("decimal(38,0)").alias("label_error"), F.count(F.lit(1)).alias("times"))
    digest = F.sha2(F.lit(books.written()), 256).alias("codebooks_sha256")
    return told(rows, facts, "_label").select("vec_id", "code", "error", F.expr("try_cast(label_error AS bigint)").alias("label_error"), digest)


def code_rounds() -> str:
    """The rounds of the codebooks in SQL, one after the other, and the codes at the end."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT x.r, x.p, arg_min(c.e, ({d}) * 256 + c.e) AS e, min({d}) AS d
  FROM x JOIN c{i} c ON c.p = x.p GROUP BY x.r, x.p)"""
    after = """
c{j} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(n.v, c.v) AS v
  FROM c{i} c LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS v
    FROM (SELECT p, e, i, ((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS v
          FROM (SELECT x.p, a.e, unnest(x.v) AS v, generate_subscripts(x.v, 1) AS i FROM x JOIN a{i} a ON a.r = x.r AND a.p = x.p) GROUP BY p, e, i)
    GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""
    d = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(CODE_ROUNDS + 1):
        steps.append(nearest.format(i=i, d=d))
        if i < CODE_ROUNDS:
            steps.append(after.format(i=i, j=i + 1))
    return ",".join(steps)


ORACLES["op13_vector_codes"] = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda y: floor({vector_codes.SCALE} * y::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
w AS (SELECT (max(len(v)) + {CODE_PARTS - 1}) // {CODE_PARTS} AS w FROM k),
x AS MATERIALIZED (
  SELECT r, p, list_resize(v, w * {CODE_PARTS}, 0)[p * w + 1 : (p + 1) * w] AS v
  FROM k, w, range({CODE_PARTS}) t(p)),
c0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= {CODE_ENTRIES}),{code_rounds()},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{CODE_ROUNDS} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{CODE_ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN f USING (r), b
"""


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the damage leaves them; dropped ones stay, not present, to tell of their conversation."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    told = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_way"))
    way = F.col("_way")
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.select("conv_id", "turn", F.when(way == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (way != 0).alias("present"), times.alias("_copy"))


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of all conversations after damage by rule."""
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = conversation_repair.repair(rows, present="present")
    return found.select("conv_id", *conversation_repair.COUNTS, F.col("edits").alias("audit"), F.col("digest").alias("repaired_sha256"))


# the costs from the end of each conversation, turn by turn, and then its edits, letter by letter
ORACLES["op11_conversations"] = r"""
WITH RECURSIVE polynomial AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations),
way AS MATERIALIZED (
  SELECT conv_id, k, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS way
  FROM keyed, polynomial),
damaged AS (
  SELECT k, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM way, range(2) c(copy) WHERE way <> 0 AND (copy = 0 OR way = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, again) AS i, left(role, 1) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged)),
faulty AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY k ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS odd
  FROM placed),
counts AS MATERIALIZED (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
  FROM faulty GROUP BY k),
costs AS (
  SELECT k, n + 1 AS i, [0, 4, 2, 0] AS h FROM counts
  UNION ALL
  SELECT k, i, [least(m[1], 2 + least(m[3], 2 + m[4])), least(m[2], 2 + least(m[3], 2 + m[4])), least(m[3], 2 + m[4]), least(m[4], 2 + m[3])]
  FROM (
    SELECT f.k, f.i, CASE WHEN fault IN ('blank', 'duplicate') THEN list_transform(h, lambda c: c + 3) ELSE [
        least(h[1] + 3, h[3] + 2 + cut, CASE r WHEN 's' THEN h[2] + cut WHEN 'u' THEN h[3] + cut END),
        least(h[2] + 3, h[3] + 2 + cut, CASE r WHEN 'u' THEN h[3] + cut END),
        least(h[3] + 3, h[4] + 2 + cut, CASE r WHEN 'a' THEN h[4] + cut END),
        least(h[4] + 3, h[3] + 2 + cut, CASE r WHEN 'u' THEN h[3] + cut END)] END AS m
    FROM costs c JOIN (SELECT *, (fault = 'truncated')::INT AS cut FROM faulty) f ON f.k = c.k AND f.i = c.i - 1)),
known AS MATERIALIZED (SELECT * FROM costs),
edits AS (
  SELECT k, n, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT k, n, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE [2, 2, 3, 2][s + 1] END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT e.*, f.role, f.text, kept,
           CASE WHEN e.i > n THEN 'I' WHEN after.h[s + 1] + 3 = h.h[s + 1] THEN 'D' WHEN h.h[[2, 2, 3, 2][s + 1] + 1] + 2 = h.h[s + 1] THEN 'I'
                WHEN after.h[kept + 1] + (fault = 'truncated')::INT = h.h[s + 1] THEN 'K' ELSE 'R' END AS e
    FROM edits e JOIN known h ON h.k = e.k AND h.i = e.i LEFT JOIN known after ON after.k = e.k AND after.i = e.i + 1
      LEFT JOIN (SELECT *, unnest([0, 1, 2, 3]) AS state FROM faulty) f ON f.k = e.k AND f.i = e.i AND f.state = e.s,
      LATERAL (SELECT CASE WHEN s = 0 AND f.r = 's' THEN 1 WHEN s IN (0, 1, 3) AND f.r = 'u' THEN 2 WHEN s = 2 AND f.r = 'a' THEN 3 END AS kept) x
    WHERE e.i <= n OR s IN (1, 2))),
ended AS (SELECT * FROM edits WHERE i > n AND s IN (0, 3))
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(h.h[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM way) w LEFT JOIN counts c ON c.k = w.k LEFT JOIN ended e ON e.k = w.k LEFT JOIN known h ON h.k = w.k AND h.i = 1
"""


#: A document of this score and more is predicted to have label 1.
GOOD_SCORE = 0.7


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, by a field learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_quality.learned(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    found = line_quality.judge(docs, field)
    return found.select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))
