from collections import defaultdict
from datetime import datetime

import pytest

from quire.llm import terms as T

SCHEMA = "entry_id long, job_id string, source string, count int, loaded_at timestamp"
AT = datetime(2025, 1, 1)


@pytest.mark.parametrize("source, term", [
    (None, None), ("", None), (" \t ", None), ("​", None), ("Dréval  Line", "dréval line"), ("Dréval LINE﻿", "dréval line"),
    ("Caldwyn’​s Seal", "caldwyn's seal"), ("North‑Gate", "north-gate"), ("M­erchant", "merchant"), ("İZ", "i̇z"), ("A\u0000B", "a\u0000b"),
])
def test_normal_form(source, term):
    assert T.normal_term(source) == term


def brute(rows, rare=3, common=0.2):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[4] or datetime.min) > (last[r[0]][4] or datetime.min)):
            last[r[0]] = r
    files, n, where = {r[1] for r in last.values()} - {None}, defaultdict(int), defaultdict(set)
    for _, job, source, count, _ in last.values():
        if (term := T.normal_term(source)) is not None:
            n[term] += count or 0
            where[term] |= {job} - {None}
    return {(t, n[t], len(where[t]), n[t] < rare, len(where[t]) > common * len(files)) for t in n}


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, f"j{i % 9}", ["Alpha", "ALPHA ", "Be ta", "be  ta", "Gam'ma", "Gam’ma", None, " ", f"rare{i}"][i * 7 % 9], [None, 0, 1, 5][i % 4], AT) for i in range(300)]
    rows += rows[:40] + [(1, "j1", "changed", 9, datetime(2026, 1, 1)), (2, "j2", "older", 9, datetime(2020, 1, 1)), (None, "j1", "lost", 9, AT), (900, None, "homeless", 1, AT), (901, "other", None, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as term_id", "3 as files")
    got = {tuple(r) for r in T.term_frequencies(df).collect()}
    assert got == brute(rows)
    marks = {tuple(r) for r in T.useless_terms(T.term_frequencies(df)).collect()}
    assert marks == {(t, "rare") for t, *_, r, _ in brute(rows) if r} | {(t, "common") for t, *_, c in brute(rows) if c}


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE", 8)
    df = spark.createDataFrame([(i, f"j{i % 3}", f"term {i % 100:03d}", 1, AT) for i in range(1000)], SCHEMA)
    got = T.term_frequencies(df).collect()
    assert len(got) == 100 and all(r.occurrences == 10 for r in got)


def test_ids_are_dense_and_ordered(spark):
    terms = spark.createDataFrame([(f"t{i:04d}",) for i in range(500)], "term string")
    assert [tuple(r) for r in T.dictionary(terms).orderBy("term").collect()] == [(f"t{i:04d}", i) for i in range(500)]


def test_empty(spark):
    assert T.term_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.useless_terms(T.term_frequencies(spark.createDataFrame([(1, "j", None, 1, AT)], SCHEMA))).count() == 0
