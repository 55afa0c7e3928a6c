"""Registered queries over the state tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import is_truncated_answer
from quire.operators import lines, store
from quire.session import table

#: The moment the queue is looked at. Fixed, so that results can be compared.
NOW = "2025-06-01 00:00:00"
#: The reasons a unit may be reported for. Fixed values.
REVIEW_REASONS = (
    "shrunk_below_threshold", "could_not_fit", "fragment", "kept_original", "glyph_missing",
    "provider_empty", "residual_glyphs", "over_image", "collateral_redaction", "page_shared_scale",
)


def _now():
    return F.lit(NOW).cast("timestamp")


def _units(spark, folder, *columns):
    """Chunk records with only the columns a query needs, so that texts aren't read or shuffled for counts."""
    rows = table(spark, folder, "chunks")
    return store.records(rows.select("id", "updated_at", *columns) if columns else rows)


def _paged(spark, folder, texts=False):
    """Chunks with a page of ten each."""
    columns = ("job_id", "status", "next_attempt_at", "translatable", "char_count", "source_text")
    return _units(spark, folder, *columns[: 6 if texts else 5]).withColumn("page", F.floor(F.col("id") / 10).cast("long"))


def _pages(units):
    return units.groupBy("job_id", "page").agg(F.count("*").alias("block_count"), F.count_if("translatable").alias("translatable_count"))


def _progress(spark, folder):
    units = _paged(spark, folder)
    return store.page_progress(_pages(units), units)


def _texts(spark, folder):
    units = _paged(spark, folder, True)
    got = store.page_texts(units.select("job_id", "page"), units)
    return got.select("job_id", "page", F.size("texts").alias("units"), F.sha2(F.array_join("texts", "\n"), 256).alias("hash"))


def _ordered(spark, folder):
    """Every unit with its place in the order of its job, and the page of it that keyset paging would read it with."""
    return store.ordered(_units(spark, folder, "job_id")).select("job_id", "id", "page", "position")


def _shares(spark, folder):
    units = _units(spark, folder, "last_run_id", "char_count").where("last_run_id is not null").withColumn("billed", F.lit(10_007).cast("long"))
    return store.apportion(units, ["last_run_id"], "id", "billed", "char_count").select("id", "share")


def _assembled(spark, folder):
    groups = store.assemble(_units(spark, folder, "job_id", "parent_block_id", "translatable", "status", "source_text", "translated_text"))
    return groups.select(
        "job_id", "group_id", "parent_block_id", "chunk_ids", F.size("translated").alias("translated"), "parity_check",
        F.sha2(F.concat_ws("", "source"), 256).alias("source_hash"),
    )


def _dense(spark, folder):
    units = _units(spark, folder, "parent_block_id", "sub_index").where("parent_block_id is not null")
    return store.dense_violations(units.withColumn("position", F.col("sub_index") + 1), "parent_block_id", "position")


def _planted_states(spark, folder):
    """Broken rules of units of which some are broken on purpose, by a rule of their ids."""
    u = _units(spark, folder)
    broken = {
        "status": F.when(u.id % 7 == 0, "ODD").otherwise(u.status), "char_count": u.char_count + (u.id % 5 == 0).cast("int"),
        "content_hash": F.when(u.id % 11 != 0, u.content_hash), "sub_index": F.when(u.id % 13 == 0, F.lit(9)).otherwise(u.sub_index),
    }
    return store.state_violations(u.withColumns(broken))


def _planted_positions(spark, folder):
    """Blocks whose pieces aren't dense, some of them on purpose."""
    units = _units(spark, folder, "parent_block_id", "sub_index").where("parent_block_id is not null")
    return store.dense_violations(units.withColumn("position", F.col("sub_index") + 1 + (F.col("id") % 5 == 0).cast("int")), "parent_block_id", "position")


def _kinds(spark, folder):
    """Runs of chunks of one kind within a job."""
    rows = lines.islands(_units(spark, folder, "job_id", "kind"), ["job_id"], ["id"], ["kind"], hot=True)
    return rows.groupBy("job_id", "island", "kind").agg(F.count("*").alias("chunks"), F.min("id").alias("first_id"))


def _review(spark, folder):
    """What happened to units by reason, with a row for every known reason and for every other one that occurs."""
    rows = store.records(table(spark, folder, "overlay_review").select("entry_id", "reason", "loaded_at"), "entry_id", "loaded_at")
    known = spark.createDataFrame([(r,) for r in REVIEW_REASONS], "reason string")
    counts = rows.groupBy("reason").agg(F.count("*").alias("entries"))
    return known.join(counts, "reason", "full").select("reason", F.coalesce("entries", F.lit(0)).alias("entries"))


QUERIES = {
    "unit_records": lambda s, d: _units(s, d, "job_id", "kind", "status", "char_count").select("id", "job_id", "kind", "status", "char_count", "updated_at"),
    "state_counts": lambda s, d: store.state_counts(_units(s, d, "job_id", "status", "next_attempt_at"), _now()),
    "unit_totals": lambda s, d: store.totals(_units(s, d, "job_id", "status", "chars_sent", "chars_billed", "char_count", "translatable")),
    "provider_counts": lambda s, d: store.provider_counts(_units(s, d, "job_id", "status", "provider")),
    "next_attempts": lambda s, d: store.next_attempts(_units(s, d, "job_id", "status", "next_attempt_at")),
    "failed_ids": lambda s, d: store.ids_where(_units(s, d, "job_id", "status"), F.col("status") == "FAILED"),
    "review_ids": lambda s, d: store.ids_where(_units(s, d, "job_id", "review_flag"), F.col("review_flag")),
    "other_glossary": lambda s, d: store.other_glossary(_units(s, d, "job_id", "status", "translatable", "glossary_hash"), table(s, d, "jobs")),
    "run_results": lambda s, d: store.run_results(_units(s, d, "last_run_id", "status")),
    "last_runs": lambda s, d: store.last_runs(table(s, d, "runs")),
    "claim": lambda s, d: store.claim(_units(s, d, "job_id", "status", "next_attempt_at"), _now(), 4),
    "claim_batch": lambda s, d: store.claim_batch(_paged(s, d), _now(), 50, 2000),
    "page_progress": _progress,
    "page_texts": _texts,
    "ordered_page": lambda s, d: _units(s, d, "job_id").where("id > 100").orderBy("id").limit(200).select("id", "job_id"),
    "ordered_units": _ordered,
    "state_violations": lambda s, d: store.state_violations(_units(s, d)),
    "dense_violations": _dense,
    "planted_states": _planted_states,
    "planted_positions": _planted_positions,
    "assembled_groups": _assembled,
    "billed_shares": _shares,
    "to_send": lambda s, d: store.to_send(_units(s, d, "job_id", "status", "next_attempt_at", "translatable", "char_count"), _now()),
    "kind_runs": _kinds,
    "review_tally": _review,
    "suspect_lengths": lambda s, d: _units(s, d, "source_text", "translated_text").where(is_truncated_answer(F.col("source_text"), F.col("translated_text"))).select("id"),
}

_U = "WITH u AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1)"
_READY = f"status = 'PENDING' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMPTZ '{NOW}+00')"
_P = _U + ", p AS (SELECT *, CAST(floor(id / 10) AS BIGINT) AS page FROM u)"
_TRIMMED = r"regexp_replace({}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"

_RULES = """ SELECT id, unnest(list_filter([
 CASE WHEN (status = 'COMPLETED') <> (translated_text IS NOT NULL) THEN 'completed_has_text' END,
 CASE WHEN next_attempt_at IS NOT NULL AND status <> 'PENDING' THEN 'attempt_only_pending' END,
 CASE WHEN NOT coalesce(status IN ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'), false) THEN 'known_status' END,
 CASE WHEN (parent_block_id IS NULL) <> (sub_index IS NULL) OR (sub_index IS NULL) <> (sub_count IS NULL) THEN 'split_columns' END,
 CASE WHEN sub_index >= sub_count THEN 'split_order' END,
 CASE WHEN char_count IS DISTINCT FROM length(source_text) THEN 'char_count' END,
 CASE WHEN content_hash IS DISTINCT FROM sha256(source_text) THEN 'content_hash' END], lambda x: x IS NOT NULL)) AS rule """

SQL = {
    "unit_records": _U + " SELECT id, job_id, kind, status, char_count, updated_at FROM u",
    "state_counts": _U + f""" SELECT job_id, count_if(status = 'PENDING') AS pending, count_if(status = 'PROCESSING') AS processing, count_if(status = 'COMPLETED') AS completed,
 count_if(status = 'FAILED') AS failed, count(*) AS total, count_if(status = 'PENDING' AND next_attempt_at > TIMESTAMPTZ '{NOW}+00') AS waiting FROM u GROUP BY job_id""",
    "unit_totals": _U + """ SELECT job_id, count(*) AS units, CAST(coalesce(sum(chars_sent), 0) AS BIGINT) AS chars_sent, CAST(coalesce(sum(chars_billed), 0) AS BIGINT) AS chars_billed,
 CAST(coalesce(sum(char_count) FILTER (status = 'COMPLETED'), 0) AS BIGINT) AS chars_done, count_if(translatable) AS translatable, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS chars FROM u GROUP BY job_id""",
    "provider_counts": _U + " SELECT job_id, provider, count(*) AS n FROM u WHERE status = 'COMPLETED' AND provider <> '' GROUP BY ALL",
    "next_attempts": _U + " SELECT job_id, min(next_attempt_at) FILTER (status = 'PENDING') AS next_attempt_at FROM u GROUP BY job_id",
    "failed_ids": _U + " SELECT job_id, id FROM u WHERE status = 'FAILED'",
    "review_ids": _U + " SELECT job_id, id FROM u WHERE review_flag",
    "other_glossary": _U + """ SELECT u.job_id, count(*) AS n FROM u LEFT JOIN jobs ON u.job_id = jobs.id
 WHERE u.status = 'COMPLETED' AND translatable AND (u.glossary_hash IS NULL OR u.glossary_hash IS DISTINCT FROM jobs.glossary_hash) GROUP BY u.job_id""",
    "run_results": _U + " SELECT last_run_id AS run_id, count_if(status = 'COMPLETED') AS completed, count_if(status = 'FAILED') AS failed FROM u WHERE last_run_id IS NOT NULL GROUP BY ALL",
    "last_runs": "SELECT job_id, id AS run_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC NULLS LAST, id DESC) AS k FROM runs) WHERE k = 1",
    "claim": _U + f", c AS (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY id)::INT AS position FROM u WHERE {_READY}) SELECT * FROM c WHERE position <= 4",
    "claim_batch": _P + f""", r AS (SELECT job_id, id, page, CASE WHEN translatable THEN char_count ELSE 0 END AS c, row_number() OVER w::INT AS position, lag(page) OVER w AS before FROM p WHERE {_READY} WINDOW w AS (PARTITION BY job_id ORDER BY id)),
 s AS (SELECT *, before <> page AND coalesce(sum(c) OVER (PARTITION BY job_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2000 AS stop FROM r WHERE position <= 50),
 f AS (SELECT job_id, min(position) AS first FROM s WHERE stop GROUP BY job_id)
 SELECT s.job_id, id, position FROM s LEFT JOIN f ON s.job_id = f.job_id WHERE position < coalesce(first, 1000)""",
    "page_progress": _P + """, pages AS (SELECT job_id, page, count(*) AS blocks, count_if(translatable) AS t FROM p GROUP BY ALL)
 SELECT job_id, count_if(blocks = (SELECT count(*) FROM p WHERE p.job_id = pages.job_id AND p.page = pages.page AND status = 'COMPLETED')) AS pages_done, count(*) AS pages_with_text FROM pages WHERE t > 0 GROUP BY job_id""",
    "page_texts": _P + """ SELECT job_id, page, count_if(translatable)::INT AS units, sha256(coalesce(string_agg(source_text, chr(10) ORDER BY id) FILTER (translatable), '')) AS hash FROM p GROUP BY ALL""",
    "ordered_page": _U + " SELECT id, job_id FROM u WHERE id > 100 ORDER BY id LIMIT 200",
    "ordered_units": _U + ", o AS (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY id) AS position FROM u) SELECT job_id, id, (position - 1) // 200 AS page, position FROM o",
    "state_violations": _U + _RULES + "FROM u",
    "planted_states": _U + """, v AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'ODD' ELSE status END AS status, char_count + (id % 5 = 0)::INT AS char_count,
 CASE WHEN id % 11 <> 0 THEN content_hash END AS content_hash, CASE WHEN id % 13 = 0 THEN 9 ELSE sub_index END AS sub_index) FROM u)""" + _RULES + "FROM v",
    "planted_positions": _U + """, p AS (SELECT parent_block_id, sub_index + 1 + (id % 5 = 0)::INT AS p FROM u WHERE parent_block_id IS NOT NULL)
 SELECT parent_block_id, count(*) AS n, max(p) AS highest FROM p GROUP BY 1 HAVING min(p) <> 1 OR max(p) <> count(*) OR count(DISTINCT p) <> count(*)""",
    "dense_violations": _U + """ SELECT parent_block_id, count(*) AS n, max(sub_index) + 1 AS highest FROM u WHERE parent_block_id IS NOT NULL GROUP BY 1
 HAVING min(sub_index) <> 0 OR max(sub_index) + 1 <> count(*) OR count(DISTINCT sub_index) <> count(*)""",
    "assembled_groups": _U + """ SELECT job_id, min(id) AS group_id, parent_block_id, list(id ORDER BY id) AS chunk_ids, count(CASE WHEN translatable THEN translated_text ELSE source_text END)::INT AS translated,
 NOT bool_or(status = 'FAILED') AS parity_check, sha256(string_agg(source_text, '' ORDER BY id)) AS source_hash FROM u GROUP BY job_id, parent_block_id, CASE WHEN parent_block_id IS NULL THEN id END""",
    "billed_shares": _U + """, w AS (SELECT id, last_run_id, char_count AS c, sum(char_count) OVER (PARTITION BY last_run_id) AS t, max(id) FILTER (char_count > 0) OVER (PARTITION BY last_run_id) AS final FROM u WHERE last_run_id IS NOT NULL),
 f AS (SELECT *, CASE WHEN t > 0 THEN 10007 * c // t ELSE 0 END AS floor FROM w)
 SELECT id, CAST(floor + CASE WHEN id = final AND t > 0 THEN 10007 - sum(floor) OVER (PARTITION BY last_run_id) ELSE 0 END AS BIGINT) AS share FROM f""",
    "to_send": _U + f" SELECT job_id, count(*) AS units, CAST(sum(char_count) AS BIGINT) AS chars FROM u WHERE translatable AND {_READY} GROUP BY job_id",
    "kind_runs": _U + """, m AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY job_id ORDER BY id)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY id) AS island FROM m) SELECT job_id, CAST(island AS BIGINT) AS island, kind, count(*) AS chunks, min(id) AS first_id FROM i GROUP BY ALL""",
    "review_tally": f"""WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM overlay_review WHERE entry_id IS NOT NULL) WHERE k = 1),
 known(reason) AS (VALUES {", ".join(f"('{r}')" for r in REVIEW_REASONS)}), c AS (SELECT reason, count(*) AS entries FROM e GROUP BY reason)
 SELECT coalesce(known.reason, c.reason) AS reason, coalesce(entries, 0) AS entries FROM known FULL OUTER JOIN c ON known.reason = c.reason""",
    "suspect_lengths": _U + f" SELECT id FROM u WHERE length({_TRIMMED.replace('{}', 'source_text', 1)}) > 40 AND length({_TRIMMED.replace('{}', 'translated_text', 1)}) < 0.2 * length({_TRIMMED.replace('{}', 'source_text', 1)})",
}
