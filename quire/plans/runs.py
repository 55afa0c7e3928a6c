"""Registered queries over logs of runs and jobs, outcomes, page contents and headings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout, lines, runs, store
from quire.operators import markdown as M
from quire.plans.layout import _B, PAGE, _boxes
from quire.plans.store import NOW, _now
from quire.session import spread, table


def _units(spark, folder, *columns):
    return store.records(table(spark, folder, "chunks").select("id", "updated_at", *columns))


def _events(spark, folder):
    """What units and runs tell of runs."""
    units = _units(spark, folder, "last_run_id", "status", "chars_sent").where("last_run_id is not null and status in ('COMPLETED', 'FAILED')")
    done = units.select(F.col("last_run_id").alias("id"), F.col("updated_at").alias("at"), F.when(F.col("status") == "COMPLETED", "complete").otherwise("fail").alias("kind"), F.col("chars_sent").alias("chars"), F.lit(None).cast("int").alias("exit_code"))
    ends = table(spark, folder, "runs").where("finished_at is not null").select("id", F.col("finished_at").alias("at"), F.lit("finish").alias("kind"), F.lit(None).cast("int").alias("chars"), "exit_code")
    return done.unionByName(ends)


def _run_log(spark, folder):
    return runs.run_log(table(spark, folder, "runs").select("id", "job_id"), _events(spark, folder), "id")


def _upserted(spark, folder):
    jobs = table(spark, folder, "jobs").select("id", "status", "provider", "updated_at")
    ends = table(spark, folder, "runs").where("finished_at is not null and job_id is not null")
    # Of a job's runs that end at once the one with the greatest outcome counts, so that the result is one.
    ends = ends.groupBy("job_id", "finished_at").agg(F.max("outcome").alias("status"))
    changes = ends.select(F.col("job_id").alias("id"), "status", F.lit(None).cast("string").alias("provider"), F.col("finished_at").alias("updated_at"))
    return runs.upserted(jobs, changes, "id", "updated_at")


def _leases(spark, folder):
    r = table(spark, folder, "runs").select("job_id", F.col("id").alias("holder"), "started_at", "finished_at")
    asks = r.select("job_id", "holder", F.lit("acquire").alias("kind"), F.col("started_at").cast("timestamp").alias("at"))
    ends = r.where("finished_at is not null").select("job_id", "holder", F.lit("release").alias("kind"), F.col("finished_at").cast("timestamp").alias("at"))
    return runs.leases(asks.unionByName(ends), "job_id", ["at", "holder", "kind"], "at", 3600.0)


def _claimed(spark, folder):
    units = _units(spark, folder, "job_id", "status", "next_attempt_at", "claimed_at", "last_run_id")
    after = runs.claimed(units, store.claim(units, _now(), 4), _now(), "run")
    return after.groupBy("job_id").agg(F.count_if(F.col("status") == "PROCESSING").alias("processing"), F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("last_run_id") == "run").alias("claimed"))


def _verdicts(spark, folder):
    units = _units(spark, folder, "parent_block_id", "source_text", "translated_text").where("parent_block_id is not null")
    return runs.answer_verdicts(units, "parent_block_id", ["id"], "source_text", "translated_text").select("id", "verdict", "occurrence")


def _capabilities(spark, folder):
    """Each provider with the one after it by name, features by a rule of their limits."""
    c = F.col("capacity_tokens")
    rows = table(spark, folder, "provider_limits").select(
        "provider", (c % 2 == 0).alias("supports_glossary"), (c > 500).alias("supports_batch"), (c > 1000).alias("supports_context"), (F.col("overlap_chars") > 50).alias("supports_tags"),
        c.alias("max_chars"), F.col("overlap_chars").alias("max_texts"),
    )
    names = rows.groupBy().agg(F.array_sort(F.collect_list("provider")).alias("p")).select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))).alias("z")).select("z.a", "z.b")
    first = rows.join(names, rows.provider == names.a).drop("a", "b")
    second = rows.join(names, rows.provider == names.b).drop("provider", "b").withColumnRenamed("a", "provider")
    return runs.merged_capabilities(first, second, ["provider"])


def _kept(spark, folder):
    b = _boxes(spark, folder)
    units = b.select(
        "unit", "page", "job_id", "x0", "y0", "x1", "y1", (F.col("unit") % 11 != 0).alias("translate"), F.when(F.col("unit") % 22 == 0, "no_letters").alias("keep_reason"),
        F.element_at(F.array(*map(F.lit, ("body", "header", "page_number", "caption"))), (F.col("unit") % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("unit") % 7 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.when(F.col("unit") % 5 == 0, " ").otherwise("x").alias("translated_text"),
    )
    widgets = b.where(F.col("unit") % 13 == 0).select(*PAGE, "x0", "y0", "x1", "y1")
    return runs.kept_original(runs.over_widgets(units, widgets, PAGE, "unit")).select("unit", "review_reason", "review_note")


def _page_text(spark, folder):
    b = _boxes(spark, folder)
    figures = b.where("unit % 5 = 0").select(*PAGE, "x0", "y0", (F.col("x1") + 100).alias("x1"), (F.col("y1") + 50).alias("y1"))
    return layout.page_text(b, figures, b.where("unit % 3 = 0"), PAGE, "unit")


def _levels(spark, folder):
    b = _boxes(spark, folder)
    u = F.col("unit")
    rows = b.select(
        "job_id", "page", u, F.when(u % 3 == 0, "heading").when(u % 3 == 1, "paragraph").otherwise("note").alias("kind"), F.when(u % 5 == 0, F.lit("1.2 Old Parts")).when(u % 5 == 1, F.lit("Old Parts")).otherwise(F.lit("old parts")).alias("text"),
        "size", (u % 2 == 0).alias("size_based"), (u % 4 < 2).alias("first_on_page"), "y0", (F.col("y1") - F.col("y0")).alias("line_height"),
    )
    return layout.heading_levels(rows, "job_id", "page", "unit").select("unit", "level")


def _pitches(spark, folder):
    b = _boxes(spark, folder).groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"), F.max("size").alias("size"))
    return b.select(*PAGE, G.line_pitch(F.col("boxes"), F.col("size")).alias("pitch"))


def _decorations(spark, folder):
    b = _boxes(spark, folder)
    drawings = b.select(*PAGE, "unit", "x0", "y0", "x1", F.when(F.col("unit") % 5 == 0, F.col("y0") + 1).otherwise(F.col("y1")).alias("y1"), (F.col("unit") % 5 == 0).alias("thin"), (F.col("unit") % 5 == 1).alias("small"))
    pages = b.select(*PAGE).distinct().withColumn("width", F.lit(595.0)).withColumn("height", F.lit(842.0))
    tables = b.where("unit % 17 = 0").select(*PAGE, (F.col("x0") - 30).alias("x0"), (F.col("y0") - 30).alias("y0"), (F.col("x1") + 30).alias("x1"), (F.col("y1") + 30).alias("y1"))
    links = b.where("unit % 19 = 0").select(*PAGE, (F.col("x0") - 20).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 20).alias("y1"))
    return drawings, layout.decorations(drawings, pages, tables, links, PAGE, "unit")


def _figures(spark, folder):
    drawings, found = _decorations(spark, folder)
    return layout.figures(drawings, found, PAGE, "unit", 12.0, 40.0)


def _notes(spark, folder):
    u = F.col("unit")
    spans = _boxes(spark, folder).select(*PAGE, "unit", (u % 7).cast("string").alias("text"), (u % 4 == 0).alias("superscript"), (u % 9 == 1).alias("is_definition"), F.when(u % 9 == 1, (u % 7).cast("string")).alias("marker"))
    return lines.footnote_refs(spans, PAGE, ["unit"]).where("ident is not null").select("unit", "ident")


def _paragraphs(spark, folder):
    return layout.paragraphs(_boxes(spark, folder), PAGE, "unit").groupBy(*PAGE).agg(F.max("paragraph").alias("paragraphs"), F.count("*").alias("lines"))


def _docs(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    "run_log": _run_log,
    "run_outcomes": lambda s, d: table(s, d, "runs").select("id", runs.outcome_name(F.col("exit_code")).alias("named"), runs.exit_code(F.when(F.col("rate_limited_count") > 2, "provider_quota").when(F.col("exit_code") > 0, F.lower("outcome"))).alias("code")),
    "worst_exits": lambda s, d: runs.worst_exit(table(s, d, "runs"), "job_id", "exit_code"),
    "job_upserts": _upserted,
    "lease_grants": _leases,
    "claimed_units": _claimed,
    "answer_verdicts": _verdicts,
    "shared_capabilities": _capabilities,
    "kept_originals": _kept,
    "page_text_split": _page_text,
    "heading_levels": _levels,
    "line_pitches": _pitches,
    "decorations": lambda s, d: _decorations(s, d)[1].select("unit", "reason"),
    "page_figures": _figures,
    "footnote_refs": _notes,
    "paragraph_counts": _paragraphs,
    "md_legends": lambda s, d: M.legends(_docs(s, d), "doc_id", "text"),
    "md_without_legends": lambda s, d: M.without_legends(_docs(s, d), "doc_id", "text").select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("hash")),
    "md_contents": lambda s, d: M.contents(M.outlines(_docs(s, d), "doc_id", "text"), "doc_id"),
}

_U = "u AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL) WHERE k = 1)"
_NAMED = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 0 THEN 'SUCCESS' WHEN {0} = 2 THEN 'PARTIAL' WHEN {0} = 3 THEN 'PAUSED' WHEN {0} = 130 THEN 'INTERRUPTED' ELSE 'FAILED' END"
_TRIM = r"regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '', 'g')"

SQL = {
    "run_log": f"""WITH {_U}, e AS (SELECT last_run_id AS id, count_if(status = 'COMPLETED') AS completed, count_if(status = 'FAILED') AS failed, CAST(coalesce(sum(chars_sent), 0) AS BIGINT) AS chars_sent
 FROM u WHERE last_run_id IS NOT NULL AND status IN ('COMPLETED', 'FAILED') GROUP BY 1)
 SELECT r.id, r.job_id, r.finished_at, CASE WHEN finished_at IS NOT NULL THEN exit_code END AS exit_code, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(e.chars_sent, 0) AS chars_sent,
 CASE WHEN finished_at IS NOT NULL THEN {_NAMED.format('exit_code')} END AS outcome FROM runs r LEFT JOIN e ON r.id = e.id""",
    "run_outcomes": f"""SELECT id, {_NAMED.format('exit_code')} AS named, CASE WHEN rate_limited_count > 2 THEN 3 WHEN exit_code > 0 THEN CASE WHEN outcome IS NULL THEN 0 WHEN lower(outcome) = 'interrupted' THEN 130 ELSE 1 END ELSE 0 END AS code FROM runs""",
    "worst_exits": "SELECT job_id, [1, 3, 4, 5, 130, 2, 0][coalesce(min(CASE WHEN exit_code IS NULL THEN NULL ELSE coalesce(list_position([1, 3, 4, 5, 130, 2, 0], exit_code), 1) END), 7)] AS exit_code FROM runs GROUP BY job_id",
    "job_upserts": """WITH c AS (SELECT job_id AS id, max(outcome) AS status, finished_at AS t FROM runs WHERE finished_at IS NOT NULL AND job_id IS NOT NULL GROUP BY job_id, finished_at),
 a AS (SELECT id, status, updated_at AS t FROM jobs UNION ALL SELECT id, status, t FROM c), m AS (SELECT id, arg_max(status, t) FILTER (status IS NOT NULL) AS status, max(t) AS updated_at FROM a WHERE id IS NOT NULL GROUP BY id)
 SELECT m.id, m.status, jobs.provider, m.updated_at FROM m LEFT JOIN jobs ON m.id = jobs.id""",
    "claimed_units": f"""WITH {_U}, p AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k FROM u WHERE status = 'PENDING' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMPTZ '{NOW}+00')) WHERE k <= 4)
 SELECT job_id, count_if(status = 'PROCESSING' OR p.id IS NOT NULL) AS processing, count_if(status = 'PENDING' AND p.id IS NULL) AS pending, count_if(p.id IS NOT NULL) AS claimed FROM u LEFT JOIN p ON u.id = p.id GROUP BY job_id""",
    "answer_verdicts": f"""WITH {_U}, t AS (SELECT id, parent_block_id, {_TRIM.format('source_text')} AS s, {_TRIM.format('translated_text')} AS a FROM u WHERE parent_block_id IS NOT NULL),
 b AS (SELECT *, coalesce((s <> '' AND coalesce(a, '') = '') OR coalesce(length(s) > 40 AND length(a) < length(s) * 0.2, false), false) AS bad FROM t),
 c AS (SELECT *, CAST(sum(bad::INT) OVER (PARTITION BY parent_block_id ORDER BY id) AS BIGINT) AS occurrence FROM b)
 SELECT id, CASE WHEN NOT bad THEN 'accept' WHEN occurrence < 2 THEN 'retry' ELSE 'lenient' END AS verdict, occurrence FROM c""",
    "shared_capabilities": """WITH a AS (SELECT provider, capacity_tokens AS c, overlap_chars AS o, lead(capacity_tokens) OVER w AS d, lead(overlap_chars) OVER w AS p FROM provider_limits WINDOW w AS (ORDER BY provider))
 SELECT provider, c % 2 = 0 AS supports_glossary, c > 500 AND d > 500 AS supports_batch, c > 1000 AND d > 1000 AS supports_context, o > 50 AND p > 50 AS supports_tags, least(c, d) AS max_chars, least(o, p) AS max_texts FROM a WHERE d IS NOT NULL""",
    "kept_originals": _B + """, w AS (SELECT * FROM b WHERE unit % 13 = 0),
 k AS (SELECT unit, CASE WHEN unit % 11 = 0 THEN CASE WHEN unit % 22 = 0 THEN 'no_letters' ELSE 'not_translatable' END WHEN unit % 4 = 2 THEN 'page_number' WHEN unit % 4 = 1 THEN 'header_footer' WHEN unit % 7 = 0 THEN 'partial'
 WHEN unit % 5 = 0 THEN 'empty translation' WHEN EXISTS (SELECT 1 FROM w WHERE w.job_id = b.job_id AND w.page = b.page AND least(w.x1, b.x1) > greatest(w.x0, b.x0) AND least(w.y1, b.y1) > greatest(w.y0, b.y0)) THEN 'widget_overlap' END AS review_note FROM b)
 SELECT unit, CASE WHEN review_note = 'empty translation' THEN 'provider_empty' WHEN review_note IS NOT NULL THEN 'kept_original' END AS review_reason, review_note FROM k""",
    "page_text_split": _B + f""", s AS (SELECT job_id, page, CAST(coalesce(sum(length(text)) FILTER (unit % 3 = 0), 0) AS BIGINT) AS absorbed_chars, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS page_chars,
 CAST(coalesce(sum(length(text)) FILTER (unit % 3 = 0 AND length({_TRIM.format('text')}) > 40), 0) AS BIGINT) AS absorbed_prose_chars, coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (unit % 3 = 0), 0) AS t,
 sum((x1 + 100 - x0) * (y1 + 50 - y0)) FILTER (unit % 5 = 0) AS area FROM b GROUP BY job_id, page),
 f AS (SELECT *, page_chars - absorbed_chars AS flow_chars, CASE WHEN area > 0 THEN least(1.0, t / area) ELSE 0.0 END AS fill FROM s)
 SELECT job_id, page, absorbed_chars, page_chars, absorbed_prose_chars, flow_chars, fill, absorbed_chars >= 400 AND ((absorbed_prose_chars >= 400 AND absorbed_prose_chars > 0.4 * (absorbed_prose_chars + flow_chars)) OR fill >= 0.5) AS text_heavy FROM f""",
    "heading_levels": _B + """, el AS (SELECT *, unit % 3 = 0 AS h, unit % 2 = 0 AS sb, lead(y0) OVER (PARTITION BY job_id, page ORDER BY unit) - y1 AS gap FROM b WHERE unit % 3 < 2),
 t AS (SELECT job_id, size, least(row_number() OVER (PARTITION BY job_id ORDER BY size DESC), 3) AS tier FROM (SELECT DISTINCT job_id, size FROM el WHERE h AND sb)), n AS (SELECT job_id, least(3, count(*) + 1) AS bold FROM t GROUP BY job_id)
 SELECT unit, CAST(CASE WHEN unit % 5 = 0 THEN 2 WHEN unit % 4 < 2 AND sb AND unit % 5 = 1 AND gap >= 3 * greatest(y1 - y0, 1) THEN 1 ELSE coalesce(CASE WHEN sb THEN tier END, bold, 1) END AS INT) AS level
 FROM el LEFT JOIN t ON el.job_id = t.job_id AND el.size = t.size LEFT JOIN n ON el.job_id = n.job_id WHERE h""",
    "line_pitches": _B + """, d AS (SELECT job_id, page, size, y0 - lag(y0) OVER (PARTITION BY job_id, page ORDER BY y0) AS d FROM b)
 SELECT job_id, page, CASE WHEN count(*) >= 2 AND count_if(d > 0) > 0 THEN least(1.40, greatest(1.15, round(median(d) FILTER (d > 0) / max(size), 3))) ELSE 1.15 END AS pitch FROM d GROUP BY job_id, page""",
    "decorations": _B + """, d AS (SELECT *, unit % 5 = 0 AS thin, unit % 5 = 1 AS small, CASE WHEN unit % 5 = 0 THEN y0 + 1 ELSE y1 END AS yy FROM b),
 r AS (SELECT unit, CASE WHEN EXISTS (SELECT 1 FROM b t WHERE t.unit % 17 = 0 AND t.job_id = d.job_id AND t.page = d.page AND d.x0 >= t.x0 - 32 AND d.y0 >= t.y0 - 32 AND d.x1 <= t.x1 + 32 AND d.yy <= t.y1 + 32) THEN 'table_border'
 WHEN EXISTS (SELECT 1 FROM b t WHERE t.unit % 19 = 0 AND t.job_id = d.job_id AND t.page = d.page AND d.x0 >= t.x0 - 22 AND d.y0 >= t.y0 - 22 AND d.x1 <= t.x1 + 22 AND d.yy <= t.y1 + 22) THEN 'link_box'
 WHEN thin AND (yy <= 842 * 0.12 OR y0 >= 842 - 842 * 0.12) THEN 'band_rule'
 WHEN (thin OR small) AND NOT EXISTS (SELECT 1 FROM d o WHERE NOT o.thin AND NOT o.small AND o.job_id = d.job_id AND o.page = d.page AND greatest(0, greatest(d.x0, o.x0) - least(d.x1, o.x1), greatest(d.y0, o.y0) - least(d.yy, o.yy)) <= 12)
 THEN CASE WHEN thin THEN 'rule' ELSE 'bullet' END END AS reason FROM d) SELECT unit, reason FROM r WHERE reason IS NOT NULL""",
    "footnote_refs": _B + """, g AS (SELECT DISTINCT job_id, page, unit % 7 AS m FROM b WHERE unit % 9 = 1), r AS (SELECT b.*, unit % 7 AS m FROM b SEMI JOIN g ON b.job_id = g.job_id AND b.page = g.page AND unit % 7 = g.m WHERE unit % 4 = 0 AND unit % 9 <> 1),
 f AS (SELECT job_id, page, m, row_number() OVER (PARTITION BY job_id ORDER BY page, min(unit)) AS ident FROM r GROUP BY job_id, page, m) SELECT r.unit, f.ident FROM r JOIN f ON r.job_id = f.job_id AND r.page = f.page AND r.m = f.m""",
}
