"""Log of jobs and runs, leases, outcomes, and what a unit's answers and a page's units come to.

Spark swaps no single row, so a log is appended to and read as its latest row a key, a lease is what a log
of requests leads to, and a claim gives the new table that a guarded write then puts in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from quire.functions import geometry as G
from quire.functions import text as T
from quire.session import latest, lookup_join

#: Exit codes of error codes, all others being 1, the outcome a code is named, and codes from the gravest. Fixed values.
EXIT_CODES = {
    "state_locked": 4, "state_hash_mismatch": 5, "state_provider_mismatch": 5, "state_schema_incompatible": 5, "interrupted": 130,
    "export_refused_partial": 2, "exporter_unavailable": 2, "provider_quota": 3, "provider_auth": 3, "glossary_bind_failed": 3,
}
OUTCOMES = {0: "SUCCESS", 2: "PARTIAL", 3: "PAUSED", 130: "INTERRUPTED"}
GRAVEST = (1, 3, 4, 5, 130, 2, 0)
#: The bad answer from which a unit is taken as it is and marked for review. Fixed value.
LENIENT_AT = 2


def upserted(rows: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` with ``changes`` (the same columns) put in: of each key the row of the latest ``at``.

    A change with null in a column leaves that column as it was.
    """
    names = [c for c in rows.columns if c not in (key, at)]
    both = rows.select(key, at, *names).unionByName(changes.select(key, at, *names)).where(F.col(key).isNotNull())
    newest = [F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col(at)))[c].alias(c) for c in names]
    return both.groupBy(key).agg(F.max(at).alias(at), *newest).select(*rows.columns)


def run_log(starts: DataFrame, events: DataFrame, run: str) -> DataFrame:
    """``starts`` with finished_at, exit_code, outcome, completed, failed, chars_sent of their runs' events.

    Events: run, at, kind (complete, fail, finish), chars, exit_code. A run without finish has null ends.
    """
    kind = F.col("kind")
    sums = events.groupBy(run).agg(
        F.max(F.when(kind == "finish", F.col("at"))).alias("finished_at"), F.max_by("exit_code", F.when(kind == "finish", F.col("at"))).alias("exit_code"),
        F.count_if(kind == "complete").alias("completed"), F.count_if(kind == "fail").alias("failed"), F.coalesce(F.sum("chars"), lit(0)).alias("chars_sent"),
    )
    both = starts.join(sums, run, "left")
    return both.withColumn("outcome", outcome_name(F.col("exit_code"))).na.fill(0, ["completed", "failed", "chars_sent"])


def single(rows: DataFrame) -> DataFrame:
    """The one row of a table that must have at most one; more raise."""
    if len(rows.limit(2).collect()) > 1:
        raise ValueError("more than one row where one was expected")
    return rows.limit(1)


def exit_code(error: Column) -> Column:
    """The exit code of an error code; 0 for none."""
    known = reduce(lambda c, e: c.when(error == e[0], lit(e[1])), EXIT_CODES.items(), F.when(error.isNull(), lit(0)))
    return known.otherwise(1)


def outcome_name(code: Column) -> Column:
    """The outcome an exit code is named; null for null."""
    known = reduce(lambda c, e: c.when(code == e[0], lit(e[1])), OUTCOMES.items(), F.when(code.isNull(), lit(None).cast("string")))
    return known.otherwise("FAILED")


def worst_exit(rows: DataFrame, scope: str, code: str) -> DataFrame:
    """``scope``, exit_code: the gravest code; an unknown one counts as 1."""
    rank = reduce(lambda c, e: c.when(F.col(code) == e[1], lit(e[0])), enumerate(GRAVEST), F.when(F.col(code).isNull(), lit(None).cast("int"))).otherwise(0)
    worst = rows.groupBy(scope).agg(F.coalesce(F.min(rank), lit(len(GRAVEST) - 1)).alias("_r"))
    return worst.select(scope, F.element_at(F.array(*map(lit, GRAVEST)), F.col("_r") + 1).alias("exit_code"))


def leases(requests: DataFrame, job: str, order: list[str], at: str, stale_s: float) -> DataFrame:
    """``requests`` with granted: whether each, in order, got or kept the lease of its job.

    Requests: holder, kind (acquire, heartbeat, release). A lease is free, or its last sign of life is
    ``stale_s`` old, or it is the holder's own. A heartbeat or a release of one that isn't held is not
    granted. A job is asked for by few processes, so its requests are folded in one row.
    """
    names = [c for c in requests.columns if c != job]
    log = F.array_sort(F.collect_list(F.struct(*order, F.struct(*names).alias("_row"))))
    kept = f"array<struct<row:struct<{','.join(f'{c}:{t}' for c, t in requests.select(*names).dtypes)}>,granted:boolean>>"
    zero = F.struct(lit(None).cast(requests.schema["holder"].dataType).alias("holder"), lit(None).cast("double").alias("seen"), F.array().cast(kept).alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        row = x["_row"]
        now, own = row[at].cast("double"), F.coalesce(acc.holder == row["holder"], lit(False))
        taken = (row["kind"] == "acquire") & (acc.holder.isNull() | own | (acc.seen <= now - stale_s))
        granted = F.coalesce(taken | own & row["kind"].isin("heartbeat", "release"), lit(False))
        gone = granted & (row["kind"] == "release")
        return F.struct(
            F.when(gone, lit(None)).when(granted, row["holder"]).otherwise(acc.holder).alias("holder"),
            F.when(gone, lit(None)).when(granted, now).otherwise(acc.seen).alias("seen"),
            F.concat(acc.out, F.array(F.struct(row.alias("row"), granted.alias("granted")))).alias("out"),
        )

    done = requests.groupBy(job).agg(F.aggregate(log, zero, fold).out.alias("_o"))
    return done.select(job, F.explode("_o").alias("_e")).select(job, "_e.row.*", "_e.granted")


def claimed(units: DataFrame, picked: DataFrame, now: Column, run_id: str) -> DataFrame:
    """The table of ``units`` after the picked ones (job_id, id) were claimed: those still pending are in process.

    Nothing else is touched; what isn't pending any more isn't claimed.
    """
    marks = picked.select("id").distinct().withColumn("_picked", lit(True))
    rows = lookup_join(units, marks, "id")
    moves = F.coalesce(F.col("_picked"), lit(False)) & (F.col("status") == "PENDING")
    new = {"status": lit("PROCESSING"), "claimed_at": now, "last_run_id": lit(run_id), "updated_at": now}
    return rows.select(*[F.when(moves, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in units.columns])


def answer_verdicts(answers: DataFrame, unit: str, order: list[str], source: str, answer: str) -> DataFrame:
    """``answers`` with verdict (accept, retry, lenient) and occurrence, the number of bad answers of the unit so far.

    An empty or a truncated answer is bad. The first is tried again, from the second on it is taken as
    it is (an empty one as the source) and marked for review. A good one is accepted.
    """
    bad = F.coalesce(T.is_empty_answer(F.col(source), F.col(answer)) | F.coalesce(T.is_truncated_answer(F.col(source), F.col(answer)), lit(False)), lit(False))
    w = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = answers.withColumn("_bad", bad.cast("int")).withColumn("occurrence", F.sum("_bad").over(w))
    return rows.withColumn("verdict", F.when(F.col("_bad") == 0, "accept").when(F.col("occurrence") < LENIENT_AT, "retry").otherwise("lenient")).drop("_bad")


def merged_capabilities(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """``on`` with what may be sent to either of two providers: the lesser sizes, features only both have, the first's glossary.

    Both: supports_glossary, supports_batch, supports_context, supports_tags, max_chars, max_texts.
    """
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
    pair = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    features = [(x & y).alias(c) for c in ("supports_batch", "supports_context", "supports_tags") for x, y in [pair(c)]]
    return both.select(*[F.col(f"a.{c}").alias(c) for c in on], F.col("a.supports_glossary").alias("supports_glossary"), *features, *[F.least(*pair(c)).alias(c) for c in ("max_chars", "max_texts")])


def kept_original(units: DataFrame, translate_headers: bool = False) -> DataFrame:
    """``units`` with review_reason and review_note of those that keep their original; null where a unit is placed.

    Units: translate, keep_reason, kind, status, translated_text, over_widget (whether a form field lies on it).
    """
    header = F.col("kind").isin("header", "footer") & lit(not translate_headers)
    rules = (
        (~F.coalesce(F.col("translate"), lit(False)), "kept_original", F.coalesce(F.nullif("keep_reason", lit("")), lit("not_translatable"))),
        (F.col("kind") == "page_number", "kept_original", lit("page_number")), (header, "kept_original", lit("header_footer")),
        (~F.col("status").eqNullSafe(lit("COMPLETED")), "kept_original", lit("partial")),
        (T.trimmed(F.coalesce("translated_text", lit(""))) == "", "provider_empty", lit("empty translation")),
        (F.coalesce(F.col("over_widget"), lit(False)), "kept_original", lit("widget_overlap")),
    )
    pick = lambda i: reduce(lambda c, r: c.when(r[0], r[i] if i == 2 else lit(r[i])), rules, F.when(lit(False), lit(None).cast("string")))
    return units.withColumn("review_reason", pick(1)).withColumn("review_note", pick(2))


def over_widgets(units: DataFrame, widgets: DataFrame, page: list[str], key: str) -> DataFrame:
    """``units`` with over_widget: whether their box and that of a widget of their page overlap."""
    box = lambda t: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    a, b = units.select(*page, key, "x0", "y0", "x1", "y1").alias("a"), widgets.alias("b")
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page] + [G.overlap_area(box("a"), box("b")) > 0]
    hits = a.join(b, on, "left_semi").select(*page, key).distinct().withColumn("over_widget", lit(True))
    return units.join(hits, [*page, key], "left").na.fill(False, ["over_widget"])


def job_of(jobs: DataFrame, job_id: str, loaded: str = "updated_at") -> DataFrame:
    """The latest row of one job; none where there is none."""
    return latest(jobs.where(F.col("id") == job_id), "id", [F.col(loaded)])
