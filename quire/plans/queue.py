"""Registered queries over event logs and configuration values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import queue, store
from quire.sources import tables
from quire.streaming import queue as stream
from quire.session import table

_NAMES = ("claim", "complete", "reschedule", "fail", "release", "requeue", "reset")


def _log(spark, folder):
    """The event table as a log of queue events: what happened follows from the id."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    e = table(spark, folder, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.element_at(names, (F.col("event_id") * 13 % 7 + 1).cast("int")).alias("event"))


def _pools(spark, folder):
    e = table(spark, folder, "events")
    return e.select((F.col("event_id") % 11).alias("pool"), "event_id", F.col("event_id").cast("double").alias("at"), (F.col("event_id") * 7 % 97 == 0).alias("limited"))


def _delays(spark, folder):
    r = table(spark, folder, "runs")
    return r.select("id", queue.delay_ceiling(F.col("rate_limited_count")).alias("ceiling"), queue.routed(F.col("exit_code") * 100 + F.col("rate_limited_count"), F.col("outcome")).code.alias("code"))


def _fallback(spark, folder):
    r = table(spark, folder, "runs").withColumn("quota", F.coalesce(F.col("rate_limited_count") >= 4, F.lit(False)))
    return queue.with_fallback(r.select("job_id", "id", "quota"), "job_id", ["id"], "quota", "first", "second").select("id", "provider")


def _ranges(spark, folder):
    j = table(spark, folder, "jobs").select("id", F.concat_ws(",", F.col("singleton"), F.concat_ws("-", "chunk_min_chars", "chunk_max_chars")).alias("text"))
    return j.select("id", F.size(tables.page_ranges(F.col("text"))).alias("pages"))


def _unit_translation(spark, folder):
    """The texts of all units through a provider, batch by batch."""
    units = store.records(table(spark, folder, "chunks").select("id", "source_text", "updated_at"))
    got = tables.translate(units, "id", "source_text")
    return got.select("id", F.length("translated_text").alias("chars"), F.sha2("translated_text", 256).alias("hash"))


QUERIES = {
    "replayed_units": lambda s, d: queue.replay(_log(s, d), "user_id", ["ts", "event_id"], "event"),
    "limiter_permits": lambda s, d: queue.permits(_pools(s, d), "pool", ["event_id"], 8),
    "delay_ceilings": _delays,
    "provider_fallback": _fallback,
    "worst_outcomes": lambda s, d: queue.worst_outcome(table(s, d, "runs").where("outcome is not null"), "job_id", "outcome", ["ERROR", "FAILED", "PAUSED", "PARTIAL", "SUCCESS"]),
    "event_windows": lambda s, d: stream.window_counts(_log(s, d), "ts", "event_type"),
    "event_sessions": lambda s, d: stream.session_counts(_log(s, d), "ts", "user_id"),
    "page_range_sizes": _ranges,
    "fake_translation": lambda s, d: tables.translate(table(s, d, "lexicon"), "word_id", "en"),
    "fake_unit_translation": _unit_translation,
}

SQL = {
    "delay_ceilings": """SELECT id, least(60.0, 2.0 * pow(2.0, greatest(rate_limited_count, 0))) AS ceiling,
 CASE WHEN s = 429 THEN 'rate_limited' WHEN s IN (401, 403) THEN 'auth' WHEN s = 456 OR outcome = 'quota' THEN 'quota' WHEN s = 413 THEN 'too_large' WHEN s = 408 OR outcome = 'timeout' THEN 'timeout'
 WHEN s >= 500 THEN 'server' WHEN s >= 400 THEN 'request' ELSE 'unknown' END AS code FROM (SELECT *, exit_code * 100 + rate_limited_count AS s FROM runs)""",
    "provider_fallback": "SELECT id, CASE WHEN bool_or(coalesce(rate_limited_count >= 4, false)) OVER (PARTITION BY job_id ORDER BY id) THEN 'second' ELSE 'first' END AS provider FROM runs",
    "worst_outcomes": """SELECT job_id, arg_min(outcome, (coalesce(list_position(['ERROR', 'FAILED', 'PAUSED', 'PARTIAL', 'SUCCESS'], outcome), 6), outcome)) AS outcome FROM runs WHERE outcome IS NOT NULL GROUP BY job_id""",
    "event_windows": "SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts)::TIMESTAMPTZ AS session_start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMPTZ AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "page_range_sizes": "SELECT id, CASE WHEN chunk_min_chars IS NULL THEN NULL ELSE 1 + chunk_max_chars - chunk_min_chars + 1 END::INT AS pages FROM jobs",
    "fake_translation": "SELECT word_id, upper(en) AS translated_text FROM lexicon",
    "fake_unit_translation": """WITH u AS (SELECT id, source_text, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL)
 SELECT id, length(upper(source_text))::INT AS chars, sha256(upper(source_text)) AS hash FROM u WHERE k = 1""",
}
