"""Registered queries over Markdown, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import lines, store
from quire.operators import markdown as M
from quire.session import spread, table


def _docs(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def _chunks(spark, folder):
    return M.chunk_rows(_docs(spark, folder), "doc_id", "text", 500, 800)


def _round_trip(spark, folder):
    """Texts whose protected form, restored, isn't the text without control characters."""
    docs = _docs(spark, folder)
    back = M.restored(M.protected(docs, "doc_id", "text"), "doc_id").select("doc_id", F.col("text").alias("_b"), "warnings")
    clean = F.regexp_replace("text", r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return docs.where("text is not null").join(back, "doc_id", "left").where(~F.col("_b").eqNullSafe(clean) | (F.size("warnings") > 0)).select("doc_id")


def _whole(parts, text, order):
    """Characters and hash of the parts of each document, put together in order: those of the text itself."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "").alias("t"))
    return joined.where("t <> ''").select("doc_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("hash"))


def _blocks_whole(spark, folder):
    docs = _docs(spark, folder)
    rows = M.block_rows(docs, "doc_id", "text").join(docs, "doc_id")
    return _whole(rows, F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start")), "block_id")


def _segments_whole(spark, folder):
    segments = M.segment_rows(_docs(spark, folder), "doc_id", "text")
    return _whole(segments, F.concat_ws("", "prefix", "text", "suffix"), "segment_no")


def _protected_whole(spark, folder):
    back = M.restored(M.protected(_docs(spark, folder), "doc_id", "text"), "doc_id")
    return back.where("text <> ''").select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("hash"), F.size("warnings").alias("warnings"))


QUERIES = {
    "md_blocks": lambda s, d: M.block_rows(_docs(s, d), "doc_id", "text"),
    "md_chunks": lambda s, d: _chunks(s, d).drop("source_text"),
    "md_chunks_lossy": lambda s, d: M.lossless(_docs(s, d), "doc_id", "text", _chunks(s, d), "chunk_id", "source_text"),
    "md_segments": lambda s, d: M.segment_rows(_docs(s, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars")),
    "md_segments_lossy": lambda s, d: _docs(s, d).where("text is not null").join(
        M.reassembled(M.segment_rows(_docs(s, d), "doc_id", "text"), "doc_id").withColumnRenamed("text", "_b"), "doc_id", "left").where("not (text <=> _b)").select("doc_id"),
    "md_blocks_whole": _blocks_whole,
    "md_chunks_whole": lambda s, d: _whole(_chunks(s, d), F.col("source_text"), "chunk_id"),
    "md_segments_whole": _segments_whole,
    "md_protected_whole": _protected_whole,
    "md_protected_lossy": _round_trip,
    "md_structures": lambda s, d: M.structures(_docs(s, d), "doc_id", "text"),
    "md_structure_mismatches": lambda s, d: M.structure_mismatches(store.records(table(s, d, "chunks").select("id", "source_text", "translated_text", "updated_at")), "id", "source_text", "translated_text"),
    "md_outlines": lambda s, d: M.outlines(_docs(s, d), "doc_id", "text"),
    "md_chapters": lambda s, d: M.chapters(M.block_rows(_docs(s, d), "doc_id", "text"), "doc_id"),
    "md_footnotes": lambda s, d: M.footnotes(lines.explode_lines(table(s, d, "documents"), ["doc_id"]), "doc_id"),
    "md_normalized": lambda s, d: M.normalized(_docs(s, d), "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("chars")),
}

_WHOLE = "SELECT doc_id, length(text) AS chars, sha256(text) AS hash FROM documents WHERE text <> ''"
_NONE = "SELECT doc_id FROM documents WHERE false"
SQL = {
    # What is taken apart must come together again: no text may be lost.
    "md_chunks_lossy": _NONE,
    "md_blocks_whole": _WHOLE,
    "md_chunks_whole": _WHOLE,
    "md_segments_whole": _WHOLE,
    "md_protected_whole": r"""SELECT doc_id, length(t) AS chars, sha256(t) AS hash, 0 AS warnings FROM (SELECT doc_id, regexp_replace(text, '[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL) WHERE t <> ''""",
    "md_segments_lossy": _NONE,
    "md_protected_lossy": _NONE,
    "md_footnotes": r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '^\[\^[^\]\s]+\]:', ''), '\[\^([^\]\s]+)\](?:[^:]|$)', 1)) AS label, 1 AS r, 0 AS d FROM l),
 m AS (SELECT doc_id, regexp_extract(line, '^\[\^([^\]\s]+)\]:[ \t]', 1) AS label, 0 AS r, 1 AS d FROM l)
 SELECT doc_id, label, CAST(sum(r) AS BIGINT) AS refs, CAST(sum(d) AS BIGINT) AS definitions FROM (SELECT * FROM r UNION ALL SELECT * FROM m WHERE label <> '') GROUP BY ALL""",
}
