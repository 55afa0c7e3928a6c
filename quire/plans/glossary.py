"""Registered queries over glossaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import glossary, store
from quire.session import spread, table


def _entries(spark, folder):
    return store.records(table(spark, folder, "glossary_entries"), "entry_id", "loaded_at")


def _approved(spark, folder):
    """Entries with a rendering count as approved, so that there are some."""
    rows = _entries(spark, folder).where("target <> ''").withColumn("status", F.lit("approved"))
    return glossary.effective(rows, "job_id", F.struct("loaded_at", "entry_id"))


def _units(spark, folder):
    return store.records(table(spark, folder, "chunks").select("job_id", "id", "source_text", "translated_text", "updated_at")).drop("updated_at")


def _lexicon(spark, folder):
    """The word list as a glossary of every job, with its words."""
    words = table(spark, folder, "lexicon").select(F.col("en").alias("source"), F.col("tr").alias("target"), F.lit(1).alias("all"))
    units = _units(spark, folder).withColumn("all", F.lit(1))
    return units, words


def _merged(spark, folder):
    rows = _entries(spark, folder).where("source is not null")
    cols = ["job_id", "source", "target", "count", "status", "origin", "note"]
    one = rows.groupBy("job_id", "source").agg(F.max(F.struct("entry_id", "target", "count", "status", "origin", "note")).alias("r")).select("job_id", "source", "r.*")
    fresh = one.where("origin = 'discovered'").select(*cols).withColumn("count", F.col("count") + 1).withColumn("target", F.lit("")).withColumn("status", F.lit("proposed"))
    old = one.where("target <> '' or origin <> 'discovered'").select(*cols)
    return glossary.merge_existing(fresh, old, ["job_id", "source"])


def _precedence(spark, folder):
    rows = _entries(spark, folder).where("source is not null").select("job_id", "source", "target", "count", "origin", "entry_id")
    return glossary.merge_with_precedence([rows.where("origin = 'discovered'"), rows.where("origin <> 'discovered'")], ["job_id", "source"])


def _discovered(spark, folder):
    """Terms of all texts of a job; ``lang`` is missing or wrong too often to choose by."""
    return glossary.discover_terms(spread(table(spark, folder, "documents").select("job_id", "doc_id", "text")), "job_id", "doc_id", "text")


def _found(spark, folder):
    units, words = _lexicon(spark, folder)
    return glossary.terms_in_texts(units, words, ["all"], "id", "source_text").groupBy("source").agg(F.count("*").alias("texts"))


def _missed(spark, folder):
    units, words = _lexicon(spark, folder)
    return glossary.glossary_misses(units, words, ["all"], "id", "source_text", "translated_text").select("id", "source")


def _own_terms(spark, folder):
    """Two words of each job's first text as its glossary: in how many texts of the job they stand."""
    units = _units(spark, folder)
    first = units.groupBy("job_id").agg(F.min_by("source_text", "id").alias("t"))
    words = first.select("job_id", F.regexp_extract("t", r"([A-Za-z]+ [A-Za-z]+)", 1).alias("source"), F.lit("x").alias("target")).where("source <> ''")
    return glossary.terms_in_texts(units, words, ["job_id"], "id", "source_text").groupBy("job_id", "source").agg(F.count("*").alias("texts"))


def _planted_markers(spark, folder):
    """Texts against themselves without some of their markers."""
    c = F.col("text")
    fewer = F.when(F.col("doc_id") % 3 == 0, F.replace(c, F.lit("**"), F.lit(""))).when(F.col("doc_id") % 3 == 1, F.replace(c, F.lit("`"), F.lit(""))).otherwise(F.replace(c, F.lit("[^"), F.lit("[")))
    return glossary.marker_mismatches(table(spark, folder, "documents").select("doc_id", "text", fewer.alias("fewer")), "doc_id", "text", "fewer")


QUERIES = {
    "own_terms": _own_terms,
    "planted_markers": _planted_markers,
    "effective_glossary": _approved,
    "glossary_signature": lambda s, d: glossary.signature(_approved(s, d), "job_id"),
    "merged_glossary": _merged,
    "glossary_precedence": _precedence,
    "discovered_terms": _discovered,
    "term_texts": _found,
    "glossary_misses": _missed,
    "job_terms": lambda s, d: glossary.terms_in_texts(_units(s, d), _approved(s, d), ["job_id"], "id", "source_text").select("id", "source", "target"),
    "marker_mismatches": lambda s, d: glossary.marker_mismatches(_units(s, d), "id", "source_text", "translated_text"),
}

_S = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
_E = "WITH e AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM glossary_entries WHERE entry_id IS NOT NULL) WHERE k = 1)"
_U = "u AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1)"
_A = _E + rf""", a AS (SELECT job_id, nfc_normalize(regexp_replace(source, '^[{_S}]+|[{_S}]+$', '', 'g')) AS source, nfc_normalize(regexp_replace(target, '^[{_S}]+|[{_S}]+$', '', 'g')) AS target, loaded_at, entry_id FROM e WHERE target <> ''),
 eff AS (SELECT job_id, source, arg_max(target, (loaded_at, entry_id, target)) AS target FROM a WHERE source <> '' AND target <> '' GROUP BY job_id, source)"""
# The cheap test comes first, as every pair compiles its own pattern.
_PRESENT = r"CASE WHEN contains(u.source_text, {}) THEN regexp_matches(u.source_text, '(^|\W)' || regexp_escape({}) || '($|\W)') ELSE false END"

SQL = {
    "effective_glossary": _A + " SELECT job_id, source, target FROM eff",
    "glossary_signature": _A + " SELECT job_id, count(*) AS entries, sha256(string_agg(source || chr(9) || target, chr(10) ORDER BY -length(source), source)) AS glossary_hash FROM eff GROUP BY job_id",
    "merged_glossary": _E + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, source ORDER BY entry_id DESC) AS k FROM e WHERE source IS NOT NULL) WHERE k = 1),
 n AS (SELECT job_id, source, '' AS target, count + 1 AS count, 'proposed' AS status, origin, note FROM one WHERE origin = 'discovered'),
 o AS (SELECT job_id, source, target, count, status, origin, note, true AS there FROM one WHERE target <> '' OR origin <> 'discovered')
 SELECT coalesce(n.job_id, o.job_id) AS job_id, coalesce(n.source, o.source) AS source, coalesce(n.count, o.count) AS count, CASE WHEN there THEN o.target ELSE n.target END AS target,
 CASE WHEN there THEN o.status ELSE n.status END AS status, CASE WHEN there THEN o.origin ELSE n.origin END AS origin, CASE WHEN there THEN o.note ELSE n.note END AS note
 FROM n FULL OUTER JOIN o ON n.job_id IS NOT DISTINCT FROM o.job_id AND n.source = o.source""",
    "glossary_precedence": _E + """ SELECT job_id, source, target, count, origin, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, source ORDER BY (origin <> 'discovered') DESC, target DESC, count DESC NULLS LAST, origin DESC, entry_id DESC) AS k
 FROM e WHERE source IS NOT NULL AND origin IS NOT NULL) WHERE k = 1""",
    "term_texts": "WITH " + _U + f" SELECT en AS source, count(*) AS texts FROM u JOIN lexicon ON {_PRESENT.format('en', 'en')} GROUP BY 1",
    "glossary_misses": "WITH " + _U + f""" SELECT id, en AS source FROM u JOIN lexicon ON {_PRESENT.format('en', 'en')}
 WHERE translated_text IS NOT NULL AND tr <> '' AND NOT contains(lower(translate(translated_text, 'Iİ', 'ıi')), lower(translate(left(tr, greatest(4, length(tr) - 2)::BIGINT), 'Iİ', 'ıi')))""",
    "job_terms": _A + ", " + _U + f" SELECT id, eff.source, eff.target FROM u JOIN eff ON u.job_id = eff.job_id AND {_PRESENT.format('eff.source', 'eff.source')}",
    "own_terms": "WITH " + _U + r""", f AS (SELECT job_id, regexp_extract(arg_min(source_text, id), '([A-Za-z]+ [A-Za-z]+)', 1) AS source FROM u GROUP BY job_id)
 SELECT u.job_id, f.source, count(*) AS texts FROM u JOIN f ON u.job_id = f.job_id AND f.source <> '' AND """ + _PRESENT.format("f.source", "f.source") + " GROUP BY ALL",
    "planted_markers": """WITH u AS (SELECT doc_id, text AS source_text, CASE doc_id % 3 WHEN 0 THEN replace(text, '**', '') WHEN 1 THEN replace(text, '`', '') ELSE replace(text, '[^', '[') END AS translated_text FROM documents WHERE text IS NOT NULL),
 m AS (SELECT doc_id, [(length(source_text) - length(replace(source_text, p, ''))) // length(p) FOR p IN ['**', '*', '`', '[^']] AS s,
 [(length(translated_text) - length(replace(translated_text, p, ''))) // length(p) FOR p IN ['**', '*', '`', '[^']] AS t FROM u)
 SELECT doc_id, unnest(list_filter([CASE WHEN s[1] <> t[1] THEN '**' END, CASE WHEN s[2] - 2 * s[1] <> t[2] - 2 * t[1] THEN '*' END, CASE WHEN s[3] <> t[3] THEN '`' END, CASE WHEN s[4] <> t[4] THEN '[^' END], lambda x: x IS NOT NULL)) AS marker FROM m""",
    "marker_mismatches": "WITH " + _U + """, m AS (SELECT id, [(length(source_text) - length(replace(source_text, p, ''))) // length(p) FOR p IN ['**', '*', '`', '[^']] AS s,
 [(length(translated_text) - length(replace(translated_text, p, ''))) // length(p) FOR p IN ['**', '*', '`', '[^']] AS t FROM u WHERE translated_text IS NOT NULL AND source_text IS NOT NULL)
 SELECT id, unnest(list_filter([CASE WHEN s[1] <> t[1] THEN '**' END, CASE WHEN s[2] - 2 * s[1] <> t[2] - 2 * t[1] THEN '*' END, CASE WHEN s[3] <> t[3] THEN '`' END, CASE WHEN s[4] <> t[4] THEN '[^' END], lambda x: x IS NOT NULL)) AS marker FROM m""",
}
