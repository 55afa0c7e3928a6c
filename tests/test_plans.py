"""Registered queries do the whole job: on small tables written here, and against DuckDB on the test tables."""

from datetime import datetime

import duckdb

from quire.operators.store import ordered, page_of
from quire.plans import glossary, queue, store, text

AT = datetime(2025, 1, 1)
SMALL = "/root/testdata/sf0.001"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def duck(sql):
    """The rows of a statement over the small tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("chunks", "documents", "overlay_review"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con.execute(sql).fetchall()


def test_review_tally_counts_every_reason(spark, tmp_path):
    rows = [(1, "provider_empty", AT), (1, "page_shared_scale", datetime(2026, 1, 1)), (2, "new_reason", AT), (3, None, AT), (4, "fragment", AT), (5, "fragment", AT)]
    write(spark, tmp_path, "overlay_review", rows, "entry_id long, reason string, loaded_at timestamp")
    got = {r.reason: r.entries for r in store._review(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and {k: n for k, n in got.items() if n} == {"page_shared_scale": 1, "new_reason": 1, None: 1, "fragment": 2}
    whole = sum(r.entries for r in store._review(spark, SMALL).collect())
    assert [(whole,)] == duck("SELECT count(DISTINCT entry_id) FROM overlay_review")


def test_terms_are_discovered_whatever_the_language_column_says(spark, tmp_path):
    langs = ["en", "EN", None, "tr", "English", ""]
    rows = [("j", i, "We saw Velbek there.", lang) for i, lang in enumerate(langs)] + [("k", 9, "We saw Narlo there. We saw Narlo here. We saw Narlo.", None)]
    write(spark, tmp_path, "documents", rows, "job_id string, doc_id long, text string, lang string")
    got = {(r.job_id, r.source, r["count"]) for r in glossary._discovered(spark, str(tmp_path)).collect()}
    assert got == {("j", "Velbek", 6), ("k", "Narlo", 3)}


def test_ordered_units_are_all_units(spark):
    rows = [("j" if i % 3 else None, i) for i in range(50, 0, -1)] + [("k", 99)]
    df = spark.createDataFrame(rows, "job_id string, id long")
    got = {(r.job_id, r.id): (r.page, r.position) for r in ordered(df, 10).collect()}
    for job in ("j", None, "k"):
        ids = sorted(i for j, i in rows if j == job)
        assert [got.pop((job, i)) for i in ids] == [(k // 10, k + 1) for k in range(len(ids))]
    assert not got and ordered(df.limit(0)).count() == 0
    first = [r.id for r in ordered(df, 10).where("job_id = 'j' and page = 1").orderBy("position").collect()]
    assert first == [r.id for r in page_of(df, "j", 14, 10).collect()]
    assert sorted(tuple(r) for r in store.QUERIES["ordered_units"](spark, SMALL).collect()) == sorted(duck(store.SQL["ordered_units"]))


def test_the_whole_text_is_escaped(spark, tmp_path):
    long = "x" * 300 + "a < b & c > d"
    write(spark, tmp_path, "documents", [(1, long, "t", 1, 1, AT)], "doc_id long, text string, title string, n_chars int, section_no int, created_at timestamp")
    assert text._scalars(spark, str(tmp_path)).first().escaped == "x" * 300 + "a &lt; b &amp; c &gt; d"
    whole = text.SQL["text_scalars"]
    names = ("doc_id", "content_hash", "escaped")
    want = duck(f"SELECT {', '.join(names)} FROM ({whole})")
    assert sorted(map(tuple, text._scalars(spark, SMALL).select(*names).collect())) == sorted(want)


def test_the_texts_of_all_units_are_translated(spark, tmp_path):
    rows = [(i, "word " * 400, AT) for i in range(120)] + [(200, "y" * 12_000, AT), (201, None, AT), (202, "", AT), (202, "late", datetime(2026, 1, 1))]
    write(spark, tmp_path, "chunks", rows, "id long, source_text string, updated_at timestamp")
    got = {r.id: r.chars for r in queue.QUERIES["fake_unit_translation"](spark, str(tmp_path)).collect()}
    assert got == {i: 2000 for i in range(120)} | {200: 12_000, 201: None, 202: 4}
    assert sorted(map(tuple, queue.QUERIES["fake_unit_translation"](spark, SMALL).collect())) == sorted(duck(queue.SQL["fake_unit_translation"]))
