"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from sparkvec.llm import bpe, decontaminate, fingerprints, licenses, neardup, quality, secrets, sharding, substrings, toxicity
from sparkvec.llm._util import table

#: The vocabulary of op8; any file of base64 tokens and ranks will do.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_license_scans(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op6_substring_dedup(spark, sf_dir):
    return substrings.report(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op7_simhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    ranks = bpe.read_ranks(VOCABULARY)
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_secret_scans(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_document_fingerprints,
        op3_license_scans,
        op4_toxicity,
        op5_benchmark_decontamination,
        op6_substring_dedup,
        op7_simhash_neardup,
        op8_byte_bpe,
        op9_secret_scans,
        op10_quality_classifier,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_benchmark_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS pattern
  FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i)
  WHERE len(w) > 0),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN patterns USING (n, pattern)),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: (rule, pattern, group, least size) as in secrets.RULES; offsets are sums over the pieces between matches.
_RULE_SQL = """
  SELECT doc_id, '{name}' AS rule, {nth} AS nth, i,
         list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in found[1:i - 1]]), 0) AS "start",
         len(found[i]) AS size
  FROM (SELECT doc_id, gaps, found, kept, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found,
                     regexp_extract_all(t, '{pattern}', {group}) AS kept
              FROM texts WHERE regexp_matches(t, '{pattern}')))
  WHERE len(kept[i]) >= {least}"""

ORACLE_SQL["op9_secret_scans"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_RULE_SQL.format(name=r.name, nth=i, pattern=r.pattern.replace("'", "''"), group=r.group, least=r.least) for i, r in enumerate(secrets.RULES))}),
named AS (SELECT *, rule || ':' || CAST("start" AS BIGINT) || ':' || CAST("start" + size AS BIGINT) AS span FROM spans),
of_doc AS (
  SELECT doc_id, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access,
         count(*) FILTER (rule = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY "start", nth) FILTER (nth < 3) AS base, string_agg(span, ',' ORDER BY "start", nth) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN of_doc USING (doc_id)
"""

ORACLE_SQL["op6_substring_dedup"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
first AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN first USING (win) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM dw),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS line
  FROM each ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""
