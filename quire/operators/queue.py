"""The stateful side of the work queue as folds over event logs: transitions, limits, fallback, delays, routing.

Spark decides no races, so nothing here claims atomically; what a log of events leads to is computed.
A fold needs the events of one unit in order, and a unit has few events; none is grouped by job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

#: From which states an event moves a unit, and where to. Fixed values.
TRANSITIONS = {
    "claim": (("PENDING",), "PROCESSING"), "complete": (("PROCESSING",), "COMPLETED"), "reschedule": (("PROCESSING",), "PENDING"),
    "fail": (("PROCESSING",), "FAILED"), "release": (("PROCESSING",), "PENDING"), "requeue": (("PROCESSING",), "PENDING"), "reset": (("FAILED",), "PENDING"),
}
#: HTTP-like conditions by (code, scope), the first that fits. Fixed values.
ROUTES = (
    (lambda s, r: s == 429, "rate_limited", "retry"), (lambda s, r: s.isin(401, 403), "auth", "job"), (lambda s, r: (s == 456) | (r == "quota"), "quota", "job"),
    (lambda s, r: s == 413, "too_large", "unit"), (lambda s, r: (s == 408) | (r == "timeout"), "timeout", "retry"), (lambda s, r: s >= 500, "server", "retry"), (lambda s, r: s >= 400, "request", "unit"),
)


def delay_ceiling(attempt: Column, base: float = 2.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Longest delay before a retry: ``min(cap, base * factor ** attempt)``; attempts below 0 count as 0."""
    return F.least(lit(cap), lit(base) * F.pow(lit(factor), F.greatest(attempt, lit(0))))


def delay(attempt: Column, key: Column, retry_after: Column, base: float = 2.0, factor: float = 2.0, cap: float = 60.0, floor: float = 0.0) -> Column:
    """A delay drawn between 0 and the ceiling, not below ``floor`` (capped) or what the provider asks for.

    The draw is a hash of ``key`` and the attempt, so a query run again gives the same delays.
    """
    share = F.pmod(F.xxhash64(key, attempt), lit(1_000_003)) / 1_000_003.0
    least = F.greatest(lit(min(max(floor, 0.0), cap)), F.coalesce(retry_after, lit(0.0)))
    return F.greatest(share * delay_ceiling(attempt, base, factor, cap), least)


def routed(status: Column, reason: Column) -> Column:
    """struct(code, scope) of an error by status and reason."""
    r = F.coalesce(reason, lit(""))
    out = None
    for test, code, scope in ROUTES:
        value = F.struct(lit(code).alias("code"), lit(scope).alias("scope"))
        hit = F.coalesce(test(status, r), lit(False))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(lit("unknown").alias("code"), lit("retry").alias("scope")))


def step(state: Column, event: Column) -> Column:
    """The state after an event; an event that doesn't apply changes nothing."""
    out = None
    for name, (sources, target) in TRANSITIONS.items():
        hit = (event == name) & state.isin(*sources)
        out = F.when(hit, lit(target)) if out is None else out.when(hit, lit(target))
    return out.otherwise(state)


def replay(events: DataFrame, unit: str, order: list[str], event: str) -> DataFrame:
    """unit, status, applied, ignored, retries: where a log of events leaves each unit.

    Units begin as PENDING. Events of a unit are folded in order inside an aggregate.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_e"))))
    zero = F.struct(lit("PENDING").alias("s"), lit(0).alias("a"), lit(0).alias("i"), lit(0).alias("r"))

    def fold(acc: Column, x: Column) -> Column:
        new = step(acc.s, x["_e"])
        moved = new != acc.s
        return F.struct(
            new.alias("s"), (acc.a + moved.cast("int")).alias("a"), (acc.i + (~moved).cast("int")).alias("i"),
            (acc.r + (moved & (x["_e"] == "reschedule")).cast("int")).alias("r"),
        )

    got = events.groupBy(unit).agg(F.aggregate(log, zero, fold).alias("f"))
    return got.select(unit, F.col("f.s").alias("status"), F.col("f.a").alias("applied"), F.col("f.i").alias("ignored"), F.col("f.r").alias("retries"))


def permits(events: DataFrame, pool: str, order: list[str], most: int, grow_after: int = 20, cooldown_s: float = 30.0) -> DataFrame:
    """pool, permits, changes after a log of (at seconds, limited): halved by a limit, one more after a clean run.

    Successes within the cooldown after a limit don't count. The log of one pool (one provider and
    run) is folded in order.
    """
    log = F.array_sort(F.collect_list(F.struct(*order, "at", "limited")))
    zero = F.struct(lit(most).alias("p"), lit(0).alias("ok"), lit(-1e18).alias("until"), lit(0).alias("n"))

    def fold(acc: Column, x: Column) -> Column:
        half = F.greatest(lit(1), F.floor(acc.p / 2).cast("int"))
        ok = F.when(x["at"] < acc.until, 0).otherwise(acc.ok + 1)
        grown = F.when(ok >= grow_after, F.least(lit(most), acc.p + 1)).otherwise(acc.p)
        p = F.when(x["limited"], half).otherwise(grown)
        return F.struct(
            p.alias("p"), F.when(x["limited"] | (ok >= grow_after), 0).otherwise(ok).alias("ok"),
            F.when(x["limited"], x["at"] + cooldown_s).otherwise(acc.until).alias("until"), (acc.n + (p != acc.p).cast("int")).alias("n"),
        )

    got = events.groupBy(pool).agg(F.aggregate(log, zero, fold).alias("f"))
    return got.select(pool, F.col("f.p").alias("permits"), F.col("f.n").alias("changes"))


def with_fallback(calls: DataFrame, run: str, order: list[str], quota: str, first: str, second: str) -> DataFrame:
    """``calls`` with the provider that takes each: the second from the first quota error of a run on."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("provider", F.when(F.max(F.col(quota).cast("int")).over(w) == 1, second).otherwise(first))


def worst_outcome(rows: DataFrame, scope: str, outcome: str, order: list[str]) -> DataFrame:
    """``scope``, outcome: the gravest outcome by a fixed order; unknown ones come last."""
    rank = F.coalesce(*[F.when(F.col(outcome) == o, lit(i)) for i, o in enumerate(order)], lit(len(order)))
    return rows.groupBy(scope).agg(F.min_by(outcome, F.struct(rank, F.col(outcome))).alias("outcome"))
