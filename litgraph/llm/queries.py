"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litgraph.llm import bitplanes, bpe, dialogue, fim, langid, mixing, packing, quality, secrets, sharding, winnow
from litgraph.llm.common import documents
from litgraph.llm.near_dedup import near_duplicates
from litgraph.llm.toxicity import toxicity


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bitplanes.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digests(documents(spark, sf_dir, "conversations"))


def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_minimax_sharding": op4_minimax_sharding,
    "op5_language_id": op5_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op7_bit_planes": op7_bit_planes,
    "op8_winnowing": op8_winnowing,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_level_bpe": op13_byte_level_bpe,
}

ORACLE: dict[str, str] = {
    "op6_source_mixing": r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM base GROUP BY source),
capped AS (   -- sources in the order in which they reach their bound
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM src WINDOW o AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT max(CAST(total - full_before AS DOUBLE) / CAST(w_all - w_before AS DOUBLE)) AS level FROM capped),
goal AS (
  SELECT source, source_size, least(CAST(w AS DOUBLE) * level, CAST(3 * source_size AS DOUBLE)) AS target
  FROM src, lev),
placed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(least(budget % source_size - bef, size), 0) END AS BIGINT)
         AS taken
FROM placed""",
    "op11_fill_in_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, w, len(w) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d1, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d2
  FROM units),
parts AS (
  SELECT doc_id, t, n,
         coalesce(array_to_string(list_slice(w, 1, least(c1, c2)), ''), '') AS p,
         coalesce(array_to_string(list_slice(w, least(c1, c2) + 1, greatest(c1, c2)), ''), '') AS m,
         coalesce(array_to_string(list_slice(w, greatest(c1, c2) + 1, n), ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d1 >= 90 THEN 'plain'
              WHEN d2 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts""",
}
