"""Registered queries over the lines and texts of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import language, lines, store
from quire.session import spread, table


def _lines(spark, folder):
    return lines.explode_lines(spread(table(spark, folder, "documents").select("job_id", "doc_id", "text")), ["job_id", "doc_id"])


def _detect(spark, folder):
    return language.detect_language(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def _ratios(spark, folder):
    return language.language_ratios(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def _running(spark, folder):
    return lines.running_patterns(_lines(spark, folder), "job_id", "doc_id", "line", min_pages=2)


def _running_share(spark, folder):
    rows = table(spark, folder, "documents").withColumn("shelf", F.substring_index("source", "/", 1))
    return lines.running_patterns(lines.explode_lines(rows, ["shelf", "doc_id"]), "shelf", "doc_id", "line", share=0.005)


def _kept(spark, folder):
    rows = _lines(spark, folder)
    kept = lines.drop_lines(rows, lines.running_patterns(rows, "job_id", "doc_id", "line", min_pages=2), "job_id", "line")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def _compounds(spark, folder):
    return lines.compounds(_lines(spark, folder), "line")


def _duplicates(spark, folder):
    return lines.duplicates(table(spark, folder, "documents"), "doc_id", "text")


def _line_kinds(spark, folder):
    rows = _lines(spark, folder).where("line is not null")
    c = F.col("line")
    marker, note, image, legend = T.list_marker(c), T.footnote_definition(c), T.image_line(c), T.legend_marker(c)
    flags = {
        "page_numbers": T.is_page_number(c), "list_items": marker.isNotNull(), "numbered_items": marker.marker != "-",
        "notes": note.isNotNull(), "images": image.isNotNull(), "legends": legend.isNotNull(),
        "captions": T.looks_like_caption(c), "strict_captions": T.matches_caption(c), "numbered": T.numbered_level(c).isNotNull(),
        "title_case": T.is_title_case(c), "with_letters": T.has_letters(c), "terminal": T.ends_with_terminal(c),
    }
    return rows.groupBy("doc_id").agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])


def _list_items(spark, folder):
    rows = _lines(spark, folder).withColumn("m", T.list_marker(F.col("line"))).where("m is not null")
    return rows.select("doc_id", "line_no", F.col("m.marker").alias("marker"), F.col("m.content").alias("content"))


def _scalars(spark, folder):
    c = F.col("text")
    return spread(table(spark, folder, "documents").select("doc_id", "text", "title", "n_chars", "section_no", "created_at")).select(
        "doc_id", T.content_hash(c).alias("content_hash"), F.length(T.squeezed(c)).alias("squeezed_chars"), F.size(T.words(F.coalesce(c, F.lit("")))).alias("words"),
        T.truncated(c, 100).alias("short"), F.length(T.strip_markup(c)).alias("plain_chars"), T.escape_markup(c).alias("escaped"),
        T.turkish_fold(F.col("title")).alias("folded_title"), T.target_stem(F.col("title")).alias("stem"), T.to_superscript(F.col("n_chars").cast("string")).alias("raised"),
        T.occurrences(c, "**").alias("bold"), T.timestamp_text(F.col("created_at")).alias("created"), T.block_name(F.col("section_no"), F.col("section_no") + 1).alias("block"),
        T.figure_file(F.col("doc_id")).alias("figure"),
    )


def _answers(spark, folder):
    s, t = F.col("source_text"), F.col("translated_text")
    rows = store.records(table(spark, folder, "chunks").select("id", "job_id", "status", "source_text", "translated_text", "updated_at")).where("status = 'COMPLETED'")
    return rows.groupBy("job_id").agg(F.count_if(T.is_empty_answer(s, t)).alias("empty"), F.count_if(F.coalesce(T.is_truncated_answer(s, t), F.lit(False))).alias("truncated"))


_S = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
_W = r"\p{L}\p{N}_"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_PATTERN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}+', '#', 'g'), '[^{_W}{_S}#]', '', 'g'), '[{_S}]+', ' ', 'g'), '^[{_S}]+|[{_S}]+$', '', 'g')"
_NUMBER = rf"(?i)^[{_S}]*(?:page[{_S}]+)?(?:\p{{Nd}}{{1,4}}|[ivxlcdm]{{1,7}})(?:[{_S}]*(?:/|of)[{_S}]*\p{{Nd}}{{1,4}})?[{_S}]*$"
_LINES = r"""
raw AS (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, job_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM raw)
"""
_SEEN = f"seen AS (SELECT DISTINCT job_id, doc_id, {_PATTERN} AS pattern FROM lines WHERE NOT regexp_matches(line, '{_NUMBER}'))"
_RUNNING = "running AS (SELECT job_id, pattern, count(*) AS pages FROM seen WHERE pattern NOT IN ('', '#') GROUP BY ALL HAVING count(*) >= 2)"
_SHARES = (
    r"""WITH toks AS (SELECT doc_id, list_transform(list_slice(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]+'), 1, 20000), lambda w: lower(replace(w, 'İ', 'i̇'))) AS t FROM documents),
stop(lang, rank, words) AS (VALUES """
    + ", ".join(f"('{x}', {i}, string_split('{language.STOPWORDS[x]}', ' '))" for i, x in enumerate(language.ORDER))
    + """), shares AS (SELECT doc_id, lang, rank, len(list_filter(t, lambda w: list_contains(words, w))) / greatest(len(t), 1) AS share FROM toks, stop)
"""
)
_BULLET = r"[•·▪■□◦‣○●►▸➢✓–—\-\*]"

QUERIES = {
    "detect_language": _detect,
    "language_ratios": _ratios,
    "running_lines": _running,
    "running_lines_by_share": _running_share,
    "lines_kept": _kept,
    "compounds": _compounds,
    "duplicate_texts": _duplicates,
    "line_kinds": _line_kinds,
    "list_items": _list_items,
    "text_scalars": _scalars,
    "answer_checks": _answers,
}

SQL = {
    "detect_language": _SHARES
    + """, best AS (SELECT doc_id, max(share) AS top, arg_max(lang, (share, -rank)) AS lang FROM shares GROUP BY doc_id)
SELECT doc_id, CASE WHEN top > 0 THEN lang END AS language, round_even(top, 4) AS ratio, lang = 'en' AND top >= 0.15 AS is_english FROM best""",
    "language_ratios": _SHARES + "SELECT doc_id, lang, round_even(share, 4) AS ratio FROM shares",
    "running_lines": f"WITH {_LINES}, {_SEEN}, {_RUNNING} SELECT job_id, pattern, pages FROM running WHERE job_id IS NOT NULL OR true",
    "running_lines_by_share": f"""WITH {_LINES}, rows AS (SELECT split_part(source, '/', 1) AS shelf, doc_id, line, {_PATTERN} AS pattern, regexp_matches(line, '{_NUMBER}') AS number FROM lines),
least AS (SELECT shelf, greatest(3, ceil(count(DISTINCT doc_id) * 0.005)) AS least FROM rows GROUP BY shelf),
counts AS (SELECT shelf, pattern, count(DISTINCT doc_id) AS pages FROM rows WHERE NOT number AND pattern NOT IN ('', '#') GROUP BY ALL)
SELECT shelf, pattern, pages FROM counts JOIN least USING (shelf) WHERE pages >= least""",
    "lines_kept": f"""WITH {_LINES}, {_SEEN}, {_RUNNING}
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines
WHERE NOT regexp_matches(line, '{_NUMBER}') AND NOT EXISTS (SELECT 1 FROM running r WHERE r.job_id = lines.job_id AND r.pattern = {_PATTERN})
GROUP BY doc_id""",
    # Without look-around: candidates are runs of word characters and hyphens that aren't at the end of the line.
    "compounds": rf"""WITH {_LINES}, runs AS (SELECT unnest(regexp_extract_all(regexp_replace(line, '[{_S}]+$', ''), '[{_W}-]+[^{_W}-]')) AS r FROM lines)
SELECT lower(left(r, length(r) - 1)) AS compound, count(*) AS n FROM runs WHERE regexp_full_match(left(r, length(r) - 1), '[\p{{L}}\p{{Nl}}\p{{No}}]+-[\p{{L}}\p{{Nl}}\p{{No}}]+') GROUP BY 1""",
    "duplicate_texts": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_key, count(*) AS copies FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "line_kinds": rf"""WITH {_LINES}, t AS (SELECT *, {_trim('line')} AS tl FROM lines)
SELECT doc_id, count_if(regexp_matches(line, '{_NUMBER}')) AS page_numbers,
 count_if(regexp_matches(tl, '^{_BULLET}[{_S}]+[^{_S}]') OR regexp_matches(tl, '^(\p{{Nd}}{{1,3}}|[a-z])[.)][{_S}]+[^{_S}]')) AS list_items,
 count_if(regexp_matches(tl, '^\p{{Nd}}{{1,3}}[.)][{_S}]+[^{_S}]')) AS numbered_items,
 count_if(regexp_matches(line, '^[{_S}]*(\p{{Nd}}{{1,3}}|[*†‡])[.):]?[{_S}]+.')) AS notes,
 count_if(regexp_matches(line, '^<!--\s*image:(\d+)((?:\s+[a-z]+="[^"\n]*")*)\s*-->[ \t]*$')) AS images,
 count_if(regexp_matches(line, '^<!--\s*legend:(\d+)(?:\s+more="(\d+)")?\s*-->[ \t]*$')) AS legends,
 count_if(regexp_matches(tl, '(?i)^(figure|fig|table|illustration)([^{_W}]|$)')) AS captions,
 count_if(regexp_matches(tl, '^(Figure|Fig\.|Table|Illustration|Plate|Listing)[{_S}]*[\p{{Nd}}A-Z]')) AS strict_captions,
 count_if(regexp_matches(tl, '(?i)^(chapter|part|book)[{_S}]+(\p{{Nd}}+|[ivxlcdm]+)([^{_W}]|$)') OR regexp_matches(tl, '^(\p{{Nd}}+(\.\p{{Nd}}+)*)\.?[{_S}]+[^{_S}]')) AS numbered,
 count_if(len(list_filter(regexp_extract_all(line, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: length(w) >= 4)) > 0 AND len(list_filter(regexp_extract_all(line, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0) AS title_case,
 count_if(regexp_matches(line, '\p{{L}}')) AS with_letters,
 count_if(regexp_matches(regexp_replace(line, '[{_S}⁰¹²³⁴⁵⁶⁷⁸⁹]+$', ''), '[.!?:”"’)…]$')) AS terminal
FROM t GROUP BY doc_id""",
    "list_items": rf"""WITH {_LINES}, t AS (SELECT *, {_trim('line')} AS tl FROM lines)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN regexp_matches(tl, '^\p{{Nd}}') THEN regexp_extract(tl, '^(\p{{Nd}}{{1,3}})', 1) || '.' ELSE '-' END AS marker,
 regexp_extract(tl, '^(?:{_BULLET}|\p{{Nd}}{{1,3}}[.)]|[a-z][.)])[{_S}]+((?s:.+))$', 1) AS content
FROM t WHERE regexp_matches(tl, '^{_BULLET}[{_S}]+[^{_S}]') OR regexp_matches(tl, '^(\p{{Nd}}{{1,3}}|[a-z])[.)][{_S}]+[^{_S}]')""",
    "text_scalars": rf"""SELECT doc_id, sha256(text) AS content_hash, length({_trim(f"regexp_replace(text, '[{_S}]+', ' ', 'g')")}) AS squeezed_chars,
 len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS words,
 CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS short,
 length(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g')) AS plain_chars,
 replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
 lower(translate(title, 'Iİ', 'ıi')) AS folded_title, left(title, greatest(4, length(title) - 2)::BIGINT) AS stem,
 translate(n_chars::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, ((length(text) - length(replace(text, '**', ''))) // 2)::INT AS bold,
 strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created, printf('p%03d-b%03d', section_no, section_no + 1) AS block, printf('img-%05d.png', doc_id) AS figure
FROM documents""",
    "answer_checks": rf"""WITH u AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1),
 t AS (SELECT job_id, {_trim('source_text')} AS s, {_trim('translated_text')} AS a FROM u WHERE status = 'COMPLETED')
SELECT job_id, count_if(s <> '' AND coalesce(a, '') = '') AS empty, count_if(length(s) > 40 AND length(a) < length(s) * 0.2) AS truncated FROM t GROUP BY job_id""",
}
