"""Queries over the state tables (chunks, units, pages, jobs, runs) as DataFrame operators.

All of them work for every job at once; a job is a filter on the result. Rows of one id are one
record (``records``). A job may hold a third of all rows, so counts are aggregates that combine
map-side, and ranked queries limit each partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import content_hash
from quire.session import cut, latest, lookup_join

#: States of a unit of work. Fixed values.
STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")


def records(rows: DataFrame, key: str = "id", loaded: str = "updated_at") -> DataFrame:
    """One row a key, the one updated last; null keys are dropped."""
    return latest(rows, key, [F.col(loaded)])


def state_counts(units: DataFrame, now: Column) -> DataFrame:
    """job_id, pending, processing, completed, failed, total, waiting (pending, but not before ``now``)."""
    state = F.col("status")
    waiting = (state == "PENDING") & (F.col("next_attempt_at") > now)
    return units.groupBy("job_id").agg(
        *[F.count_if(state == s).alias(s.lower()) for s in STATES], F.count("*").alias("total"), F.count_if(waiting).alias("waiting")
    )


def totals(units: DataFrame) -> DataFrame:
    """job_id with units, characters sent and billed, characters done, translatable units, characters."""
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return units.groupBy("job_id").agg(
        F.count("*").alias("units"), summed("chars_sent").alias("chars_sent"), summed("chars_billed").alias("chars_billed"),
        summed(F.when(F.col("status") == "COMPLETED", F.col("char_count"))).alias("chars_done"),
        F.count_if("translatable").alias("translatable"), summed("char_count").alias("chars"),
    )


def provider_counts(units: DataFrame) -> DataFrame:
    """job_id, provider, n of the completed units; units without provider don't count."""
    done = units.where("status = 'COMPLETED' and provider <> ''")
    return done.groupBy("job_id", "provider").agg(F.count("*").alias("n"))


def next_attempts(units: DataFrame) -> DataFrame:
    """job_id, next_attempt_at: the earliest of the pending units, null where none has one."""
    at = F.when(F.col("status") == "PENDING", F.col("next_attempt_at"))
    return units.groupBy("job_id").agg(F.min(at).alias("next_attempt_at"))


def ids_where(units: DataFrame, condition: Column) -> DataFrame:
    """job_id, id of the units that meet a condition."""
    return units.where(condition).select("job_id", "id")


def other_glossary(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, n: completed translatable units done with another glossary than their job's, or with none."""
    done = units.where("status = 'COMPLETED' and translatable").groupBy("job_id", "glossary_hash").agg(F.count("*").alias("n"))
    now = jobs.select(F.col("id").alias("job_id"), F.col("glossary_hash").alias("_now"))
    return lookup_join(done, now, "job_id").where(~F.col("glossary_hash").eqNullSafe(F.col("_now")) | F.col("glossary_hash").isNull()).groupBy("job_id").agg(F.sum("n").alias("n"))


def run_results(units: DataFrame) -> DataFrame:
    """run_id, completed, failed of the runs that last touched a unit."""
    return units.where("last_run_id is not null").groupBy(F.col("last_run_id").alias("run_id")).agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """job_id, run_id, outcome of the run started last; the greater id of a tie."""
    best = F.max_by(F.struct("id", "outcome"), F.struct("started_at", "id")).alias("r")
    return runs.groupBy("job_id").agg(best).select("job_id", F.col("r.id").alias("run_id"), F.col("r.outcome").alias("outcome"))


def ready(units: DataFrame, now: Column) -> DataFrame:
    """The pending units that may be tried now."""
    return units.where((F.col("status") == "PENDING") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def claim(units: DataFrame, now: Column, limit: int) -> DataFrame:
    """job_id, id, position of the first ``limit`` ready units of each job by id."""
    w = Window.partitionBy("job_id").orderBy("id")
    return ready(units, now).select("job_id", "id", F.row_number().over(w).alias("position")).where(F.col("position") <= limit)


def claim_batch(units: DataFrame, now: Column, max_units: int, min_chars: int) -> DataFrame:
    """job_id, id, position of the next batch of each job.

    At most ``max_units`` ready units (job_id, id, page, char_count, translatable) by id; the batch
    ends at the first change of page that finds ``min_chars`` translatable characters before it.
    """
    w = Window.partitionBy("job_id").orderBy("id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = ready(units, now).withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_units)
    chars = F.coalesce(F.sum(F.when(F.col("translatable"), F.col("char_count")).otherwise(0)).over(before), F.lit(0))
    stop = (F.lag("page").over(w) != F.col("page")) & (chars >= min_chars)
    rows = rows.withColumn("_stop", F.coalesce(stop, F.lit(False)).cast("int"))
    return rows.withColumn("_past", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_past = 0").select("job_id", "id", "position")


def page_progress(pages: DataFrame, units: DataFrame) -> DataFrame:
    """job_id, pages_done, pages_with_text. A page is done when as many units are completed as it has.

    Pages: job_id, page, block_count, translatable_count. Pages without translatable units don't count.
    """
    done = units.where("status = 'COMPLETED'").groupBy("job_id", "page").agg(F.count("*").alias("_done"))
    rows = pages.where("translatable_count > 0").join(done, ["job_id", "page"], "left")
    return rows.groupBy("job_id").agg(
        F.count_if(F.col("block_count") == F.coalesce("_done", F.lit(0))).alias("pages_done"), F.count("*").alias("pages_with_text")
    )


def page_texts(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """job_id, page, texts (in order of ids) of the wanted pages; an empty list where a page has none."""
    rows = units.where("translatable").select("job_id", "page", "id", "source_text")
    got = wanted.select("job_id", "page").distinct().join(rows, ["job_id", "page"], "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "source_text"))))
    return got.groupBy("job_id", "page").agg(F.transform(listed, lambda s: s["source_text"]).alias("texts"))


def page_of(units: DataFrame, job_id: str, after: int, size: int = 200) -> DataFrame:
    """The next ``size`` units of a job by id after a given id (keyset paging)."""
    return units.where((F.col("job_id") == job_id) & (F.col("id") > after)).orderBy("id").limit(size)


def ordered(units: DataFrame, size: int = 200) -> DataFrame:
    """``units`` (job_id, id, ...) with ``position`` (from 1) by id within the job and ``page`` (from 0) of ``size`` units each.

    All units are sorted by range over job and id, so a job of any size is as many tasks as it needs;
    a task ranks its own units, and one row a job and task says how many stand before them.
    """
    placed = cut(units.repartitionByRange("job_id", "id").withColumn("_part", F.spark_partition_id()))
    placed = placed.withColumn("_k", F.struct("job_id", "_part"))  # so that a null job joins itself
    earlier = Window.partitionBy("_k.job_id").orderBy("_k._part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_k").agg(F.count("*").alias("_n")).select("_k", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_k").orderBy("id"))).join(before, "_k")
    rows = rows.withColumn("position", F.col("_before") + F.col("_own"))
    return rows.withColumn("page", F.floor((F.col("position") - 1) / size)).drop("_k", "_part", "_own", "_before")


def state_violations(units: DataFrame) -> DataFrame:
    """id, rule for every broken invariant of the state columns."""
    rules = {
        "completed_has_text": (F.col("status") == "COMPLETED") != F.col("translated_text").isNotNull(),
        "attempt_only_pending": F.col("next_attempt_at").isNotNull() & (F.col("status") != "PENDING"),
        "known_status": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)),
        "split_columns": (F.col("parent_block_id").isNull() != F.col("sub_index").isNull()) | (F.col("sub_index").isNull() != F.col("sub_count").isNull()),
        "split_order": F.coalesce(F.col("sub_index") >= F.col("sub_count"), F.lit(False)),
        "char_count": ~F.col("char_count").eqNullSafe(F.length("source_text")),
        "content_hash": ~F.col("content_hash").eqNullSafe(content_hash(F.col("source_text"))),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return units.select("id", F.explode(broken).alias("rule"))


def dense_violations(rows: DataFrame, scope: str, position: str) -> DataFrame:
    """scope, n, highest of the scopes whose positions aren't 1 to n, each once."""
    sums = rows.groupBy(scope).agg(F.count("*").alias("n"), F.countDistinct(position).alias("_d"), F.min(position).alias("_a"), F.max(position).alias("highest"))
    return sums.where((F.col("_a") != 1) | (F.col("highest") != F.col("n")) | (F.col("_d") != F.col("n"))).select(scope, "n", "highest")


def assemble(units: DataFrame) -> DataFrame:
    """job_id, group_id, parent_block_id, chunk_ids, source, translated, parity_check of the pieces of each block.

    Pieces of one block are joined in order of ids; a unit never cut is a group of its own. Units not
    translated give no text, failed ones clear the check. Grouped by block, so no group is larger than
    one block however large a job is.
    """
    own = F.when(F.col("parent_block_id").isNull(), F.col("id"))
    text = F.when(F.col("translatable"), F.col("translated_text")).otherwise(F.col("source_text"))
    rows = units.select("job_id", "parent_block_id", own.alias("_own"), F.struct("id", "source_text", text.alias("_t")).alias("_u"), (F.col("status") == "FAILED").alias("_f"))
    got = rows.groupBy("job_id", "parent_block_id", "_own").agg(F.array_sort(F.collect_list("_u")).alias("_l"), F.bool_or("_f").alias("_f"))
    return got.select(
        "job_id", F.col("_l")[0]["id"].alias("group_id"), "parent_block_id",
        F.transform("_l", lambda u: u["id"]).alias("chunk_ids"), F.transform("_l", lambda u: u["source_text"]).alias("source"),
        F.array_compact(F.transform("_l", lambda u: u["_t"])).alias("translated"), (~F.col("_f")).alias("parity_check"),
    )


def apportion(rows: DataFrame, scope: list[str], order: str, total: str, weight: str, name: str = "share") -> DataFrame:
    """``rows`` with an integer share of the scope's ``total`` by weight; the rest goes to the last positive weight."""
    everything = Window.partitionBy(*scope)
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long")
    rows = rows.withColumn("_w", w).withColumn("_sum", F.sum("_w").over(everything))
    floor = F.when((F.col("_sum") > 0) & (F.col(total) > 0), F.floor(F.col(total) * F.col("_w") / F.col("_sum"))).otherwise(0)
    rows = rows.withColumn("_floor", floor.cast("long")).withColumn("_rest", F.col(total) - F.sum("_floor").over(everything))
    last = F.max(F.when(F.col("_w") > 0, F.col(order))).over(everything)
    extra = F.when((F.col(order) == last) & (F.col("_sum") > 0) & (F.col(total) > 0), F.col("_rest")).otherwise(0)
    return rows.withColumn(name, (F.col("_floor") + extra).cast("long")).drop("_w", "_sum", "_floor", "_rest")


def to_send(units: DataFrame, now: Column) -> DataFrame:
    """job_id, units, chars that would be sent now."""
    rows = ready(units, now).where("translatable")
    return rows.groupBy("job_id").agg(F.count("*").alias("units"), F.sum("char_count").alias("chars"))
