"""The queries of this subpackage, each over the whole of its tables, and SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.llm import decontaminate, fingerprint, linededup, mixing, neardup, pii, quality, sharding, substrings, toxicity
from marlstone.llm.common import table

QUERIES = {
    "op1_source_mixing": lambda spark, d: mixing.replicate(table(spark, d, "documents")),
    "op2_fingerprint": lambda spark, d: fingerprint.fingerprints(table(spark, d, "documents")),
    "op3_decontamination": lambda spark, d: decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_pii": lambda spark, d: pii.digest(pii.find(table(spark, d, "documents"))),
    "op5_substring_dedup": lambda spark, d: substrings.repeats(table(spark, d, "documents")),
    "op6_near_dedup": lambda spark, d: neardup.near_duplicates(table(spark, d, "documents")),
    "op7_sharding": lambda spark, d: sharding.shard(table(spark, d, "documents")),
    "op8_quality": lambda spark, d: quality.classify(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_toxicity": lambda spark, d: toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_line_dedup": lambda spark, d: linededup.digest(linededup.dedup_lines(table(spark, d, "documents"))),
}

ORACLE_SQL = {
    "op1_source_mixing": mixing.ORACLE,
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL AND k.doc_id <> o.last) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE o.key IS NULL OR k.doc_id = o.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id
""",
}
