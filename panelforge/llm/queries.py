"""The registered queries of the document operators, over whole tables, and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.decontaminate import benchmark_leaks
from panelforge.llm.divergence import source_divergence
from panelforge.llm.frames import load, scratch_path, ship
from panelforge.llm.hard_negatives import hard_negatives
from panelforge.llm.licences import licence_scan
from panelforge.llm.line_dedup import line_bitmaps, without_lines
from panelforge.llm.lz_fingerprint import compare_fingerprints
from panelforge.llm.minhash_dedup import near_duplicates
from panelforge.llm.mixing import mix_plan
from panelforge.llm.pu_quality import learn_quality, score_quality
from panelforge.llm.sharding import interleave_shards
from panelforge.llm.suffix_dedup import remove_repeats
from panelforge.llm.token_counts import token_counts
from panelforge.llm.warc import read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return function
    return keep


@query("op3_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards by rows, each with the mixture of all documents."""
    out = interleave_shards(load(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
weighted AS (
  SELECT k, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3) + 1] AS DOUBLE) AS w
  FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT k, source_size,
         CASE WHEN level >= ratio THEN cap
              ELSE w * (SELECT l.level FROM levels l WHERE l.level < l.ratio ORDER BY l.ratio, l.k LIMIT 1)
         END AS target,
         CAST(('0x' || substr(md5('11|' || k), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY s.k ORDER BY
           16 * greatest(length(bin(size)) - 5, 0) + (size >> greatest(length(bin(size)) - 5, 0)) DESC,
           h, doc_id, size) AS r
  FROM sized s JOIN targets t USING (k))
SELECT doc_id, source, size, source_size, target,
       CAST(floor(u + r * rate) - floor(u + (r - 1) * rate) AS BIGINT) AS copies,
       CAST(floor(u + r * rate) - floor(u + (r - 1) * rate) AS BIGINT) * size AS taken
FROM placed
"""


@query("op7_mix", MIX_SQL)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at one and a half times their words."""
    return mix_plan(load(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


@query("op10_token_counts")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by word_bpe_49k.json."""
    return token_counts(load(spark, sf_dir, "documents"), limit=2048)


@query("op1_lz_fingerprints")
def lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents, against their edited texts and their neighbours."""
    return compare_fingerprints(load(spark, sf_dir, "documents"), size=128)


@query("op4_licences")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of all documents."""
    return licence_scan(load(spark, sf_dir, "documents"))


@query("op9_warc")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files with revisits for equal payloads, and read back."""
    path = scratch_path(spark, "warc")
    write_archive(load(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return read_archive(spark, path)


@query("op8_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 75 % of five-word shingles."""
    return near_duplicates(load(spark, sf_dir, "documents"), percent=75, width=5)


@query("op2_pu_quality")
def pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from trusted positives and unlabelled text."""
    docs = load(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, load(spark, sf_dir, "labels")), threshold=0.3)


@query("op5_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds, whole or edited."""
    return benchmark_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op6_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that stand in two places."""
    return remove_repeats(load(spark, sf_dir, "documents"), length=400)


DIVERGENCE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
terms AS (SELECT d, lang, source, unnest(ws) AS term FROM words),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
pairs0 AS (SELECT DISTINCT lang, source FROM words),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lang_c, l.n AS lang_n, l.v,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM pairs0 g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM pairs0 a JOIN pairs0 b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM grid WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language over all documents, by pairs and by terms."""
    return source_divergence(load(spark, sf_dir, "documents"), min_docs=10, top=10)


NEGATIVES_SQL = r"""
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every hundredth vector, from all vectors."""
    vectors = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10,
                          low=30, high=90, scale=256)


LINES_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS dropped FROM keyed LEFT JOIN common ON keyed.k = common.k),
texts AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '') AS kept
  FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM split JOIN texts USING (r)
"""


@query("op13_line_dedup", LINES_SQL)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in ten documents or more."""
    docs = load(spark, sf_dir, "documents")
    kept = without_lines(docs, line_bitmaps(docs, min_docs=10, min_chars=1, keep="none"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
