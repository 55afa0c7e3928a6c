"""Registered queries over legends, windows and replacements, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assembly, lines, store
from quire.session import table


def _legends(spark, folder):
    rows = lines.explode_lines(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    return assembly.legend_items(rows, ["doc_id"], "line_no", "line")


def _pairs(spark, folder):
    source = _legends(spark, folder)
    return assembly.paired_legends(source, source.withColumn("label", F.concat("label", F.lit("!"))), ["doc_id"])


def _units(spark, folder, *columns):
    return store.records(table(spark, folder, "chunks").select("id", "updated_at", *columns))


def _windows(spark, folder):
    units = _units(spark, folder, "parent_block_id", "source_text").where("parent_block_id is not null")
    batches = units.groupBy("parent_block_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "source_text"))), lambda u: u["source_text"]).alias("page_texts"), F.array(F.min_by("source_text", "id")).alias("unit_texts")
    )
    return assembly.context_windows(batches, "parent_block_id", 500)


def _enforced(spark, folder):
    words = table(spark, folder, "lexicon").select(F.col("en").alias("source"), F.col("tr").alias("target"), F.lit(1).alias("all"))
    units = _units(spark, folder, "source_text", "translated_text").withColumn("all", F.lit(1))
    return assembly.enforced(units, words, ["all"], "id", "source_text", "translated_text").select("id", F.size("missing").alias("missing"), F.sha2("text", 256).alias("hash"))


QUERIES = {
    "legend_items": _legends,
    "paired_legends": _pairs,
    "context_windows": _windows,
    "enforced_terms": _enforced,
    "figure_labels": lambda s, d: assembly.figure_labels(_legends(s, d), ["doc_id", "image_id"], "item_no", "label", 3),
}

_ITEMS = r"""WITH raw AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM raw),
m AS (SELECT doc_id, n, regexp_extract(line, '^<!--\s*legend:(\d+)(?:\s+more="\d+")?\s*-->[ \t]*$', 1) AS id, nullif(regexp_extract(line, '^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(.+?)[ \t]*$', 1), '') AS item FROM l),
b AS (SELECT *, max(CASE WHEN item IS NULL THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM m),
i AS (SELECT b.doc_id, CAST(h.id AS BIGINT) AS image_id, (b.n - b.stop)::INT AS item_no, b.item AS label FROM b JOIN m h ON h.doc_id = b.doc_id AND h.n = b.stop AND h.id <> '' WHERE b.item IS NOT NULL)
"""

SQL = {
    "context_windows": r"""WITH u AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1 AND parent_block_id IS NOT NULL),
 g AS (SELECT parent_block_id, coalesce(string_agg(nullif(source_text, ''), chr(10) ORDER BY id), '') AS page, arg_min(source_text, id) AS part FROM u GROUP BY parent_block_id),
 p AS (SELECT *, length(page) AS n, strpos(page, nullif(part, '')) - 1 AS a FROM g),
 s AS (SELECT *, greatest(0, least(CASE WHEN a >= 0 THEN (2 * a + length(part)) // 2 ELSE 250 END - 250, n - 500)) AS start FROM p),
 f AS (SELECT *, start + 500 AS stop, CASE WHEN start > 0 AND contains(substr(page, start + 1, 80), ' ') THEN start + strpos(substr(page, start + 1, 80), ' ') ELSE start END AS first FROM s),
 l AS (SELECT *, strpos(reverse(substr(page, stop - 79, 80)), ' ') AS back FROM f)
 SELECT parent_block_id, CASE WHEN n <= 500 THEN page ELSE regexp_replace(substr(page, first + 1, CASE WHEN stop < n AND back > 0 AND stop - back > first THEN stop - back ELSE stop END - first), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS context FROM l""",
    "legend_items": _ITEMS + "SELECT * FROM i",
    "paired_legends": _ITEMS + r", t AS (SELECT doc_id, image_id, item_no, label, label || '!' AS rendering FROM i) SELECT *, '- ' || regexp_replace(label, '^(\d+)([.)])', '\1\\\2') || ' → ' || rendering AS line FROM t",
    "figure_labels": _ITEMS + r""", c AS (SELECT doc_id, image_id, trim(regexp_replace(label, '[\s\p{Z}]+', ' ', 'g')) AS t, min(item_no) AS o FROM i GROUP BY ALL),
 k AS (SELECT * FROM c WHERE length(t) > 1 AND NOT regexp_matches(t, '^[-+]?[\d.,]+\s*%?$'))
 SELECT doc_id, image_id, list_slice(list(t ORDER BY o, t), 1, 3) AS labels, greatest(count(*) - 3, 0)::INT AS more FROM k GROUP BY ALL""",
}
