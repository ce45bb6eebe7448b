"""Registered queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, unigram
from .decontaminate import leaks
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .line_templates import drop_recurring_lines
from .near_dedup import near_dedup
from .merkle import manifest
from .pii import personal_data
from .sharding import shard_by_bytes
from ..plans.staging import table
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .vantage import nearest


def piece_model() -> str:
    """The public piece vocabulary on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines went, and the text that is left."""
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_dropped", "text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source as host) and pages (markup, address and host); the other id is null."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_sample(docs)
    none = F.lit(None).cast("bigint")
    a = language_id.from_documents(docs).select(F.col("id").alias("doc_id"), none.alias("page_id"), "declared", "host", "text")
    b = language_id.from_pages(table(spark, sf_dir, "pages")).select(none.alias("doc_id"), F.col("id").alias("page_id"), "declared", "host", "text")
    return language_id.identify(a.unionByName(b), model, ["doc_id", "page_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), piece_model())


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids, and whether decoding them gives the text back."""
    coded = unigram.encode(table(spark, sf_dir, "documents"), piece_model())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id 50 divides, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per language; every row whose id's checksum 7 divides is tampered with."""

    def tamper(c):
        return F.crc32(c["doc_id"].cast("string")) % 7 == 0, {"n_chars": c["n_chars"] + 1}

    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", tamper)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id 100 divides; where 7 divides it the label is moved on first."""
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_nearest": op11_nearest,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(norm) AS text_sha256
FROM k""",
    "op12_merkle": """
WITH RECURSIVE
f AS (
  SELECT doc_id, lang, hit, concat_ws('', d, s, l) AS a, coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS n,
         coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS m, t
  FROM (SELECT doc_id, lang, n_chars, 
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 7 = 0 AS hit,
               coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') AS d, coalesce(octet_length(encode(source)) || ':' || source, '-') AS s,
               coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS l, coalesce(octet_length(encode(text)) || ':' || text, '-') AS t
        FROM documents)),
leaf AS (
  SELECT doc_id, lang, sha256(a || n || t) AS leaf, CASE WHEN hit THEN sha256(a || m || t) ELSE sha256(a || n || t) END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM f),
up AS (
  SELECT lang, 0 AS lvl, i, leaf AS h, n FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS lvl, i, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, i // 2, n),
p AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, i, n, '' AS sib, tampered AS h FROM leaf
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.lvl + 1, p.i // 2, (p.n + 1) // 2, p.sib || coalesce(s.h, ''),
         CASE WHEN p.i % 2 = 1 THEN sha256(s.h || p.h) ELSE sha256(p.h || coalesce(s.h, '')) END
  FROM p LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = p.lvl AND s.i = xor(p.i, 1)
  WHERE p.n > 1),
q AS (
  SELECT p.doc_id, p.leaf, sub.h AS subroot, 0 AS lvl, sub.i, sub.n, p.sib, p.h FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT q.doc_id, q.leaf, q.subroot, q.lvl + 1, q.i // 2, (q.n + 1) // 2, q.sib || coalesce(s.h, ''),
         CASE WHEN q.i % 2 = 1 THEN sha256(s.h || q.h) ELSE sha256(q.h || coalesce(s.h, '')) END
  FROM q LEFT JOIN high s ON s.lvl = q.lvl AND s.i = xor(q.i, 1)
  WHERE q.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(sib) AS proof_sha256, q.h AS folded_root,
       q.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM q WHERE n = 1""",
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE k <= 10""",
}
