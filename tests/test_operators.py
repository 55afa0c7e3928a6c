"""Operators on small frames: nulls, ties, repeats, empty tables."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.operators import glossary, language, layout, lines, queue, store
from quire.sources import tables

AT = datetime(2025, 1, 1)


def test_language(spark):
    df = spark.createDataFrame([(1, "The cat and the dog"), (2, "Der Hund und die Katze"), (3, ""), (4, None), (5, "xyz"), (6, "le la les")], "k int, t string")
    got = {r.k: (r.language, r.is_english) for r in language.detect_language(df, "k", "t").collect()}
    assert got == {1: ("en", True), 2: ("de", False), 3: (None, False), 4: (None, False), 5: (None, False), 6: ("fr", False)}
    assert language.detect_language(df.limit(0), "k", "t").count() == 0


def test_running_lines(spark):
    rows = [("b", p, t) for p in range(10) for t in ([f"Page {p}", "The Book", f"own {'x' * p}"] + ["Twice"] * (p < 2) + ["Twice"])[:4 if p < 2 else 3]]
    df = spark.createDataFrame(rows, "book string, page int, line string")
    got = {(r.pattern, r.pages) for r in lines.running_patterns(df, "book", "page", "line").collect()}
    assert got == {("the book", 10)}
    left = lines.drop_lines(df, lines.running_patterns(df, "book", "page", "line"), "book", "line")
    assert not left.where("line in ('The Book', 'Page 3')").count() and left.count() == 12
    assert {tuple(r) for r in lines.compounds(spark.createDataFrame([("a well-known fact",), ("ends in well-",), ("a half-open",)], "l string"), "l").collect()} == {("well-known", 1)}


def test_paragraphs_and_runs(spark):
    df = spark.createDataFrame([("d", 1, 1, "goes on"), ("d", 2, 1, "to here."), ("d", 2, 2, "New"), ("d", 4, 1, "then"), ("d", 5, 1, "more")], "d string, p int, o int, t string")
    got = sorted((r.first_page, r.last_page, list(r.parts)) for r in lines.merge_across_pages(df, "d", "p", "o", "t").collect())
    assert got == [(1, 2, ["goes on", "to here."]), (2, 5, ["New", "then", "more"])]
    text = spark.createDataFrame([(["An exam-", "ple of", "a well-", "known"],)], "l array<string>").select(lines.joined_paragraph(F.col("l"), F.array(F.lit("well-known"))).text.alias("x"))
    assert text.first()["x"] == "An example of a well-known"
    spans = spark.createDataFrame([(1, 1, "ab", 10.1, False, False, "Arial", "#0"), (1, 2, "cd", 9.9, False, False, "Arial", "#0"), (1, 3, "efghi", 12.0, True, False, "Arial-Italic", "#1")], "b int, o int, text string, size double, bold boolean, italic boolean, font string, color string")
    assert lines.dominant_style(spans, ["b"]).first()["font_size"] == 12.0
    assert [r.text for r in lines.style_runs(spans, ["b"], ["o"]).orderBy("island").collect()] == ["abcd", "efghi"]


def test_store(spark):
    rows = [("j", i, s, n, c, t, p) for i, s, n, c, t, p in [(1, "PENDING", None, 10, True, 1), (2, "PENDING", datetime(2030, 1, 1), 10, True, 1), (3, "PENDING", datetime(2020, 1, 1), 10, True, 1), (4, "PENDING", None, 10, True, 2), (5, "PENDING", None, 10, True, 2), (6, "FAILED", None, 10, True, 3)]]
    df = spark.createDataFrame(rows, "job_id string, id long, status string, next_attempt_at timestamp, char_count int, translatable boolean, page int")
    now = F.lit(AT)
    assert [r.id for r in store.claim(df, now, 4).orderBy("id").collect()] == [1, 3, 4, 5]
    assert [r.id for r in store.claim_batch(df, now, 50, 15).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in store.claim_batch(df, now, 50, 100).orderBy("id").collect()] == [1, 3, 4, 5]
    got = store.state_counts(df, now).first()
    assert (got.pending, got.failed, got.total, got.waiting) == (5, 1, 6, 1)
    assert [r.id for r in store.page_of(df, "j", 2, 3).collect()] == [3, 4, 5]
    shares = store.apportion(spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 10, 2), ("a", 3, 10, 0), ("b", 4, 7, 0)], "s string, o int, total int, w int"), ["s"], "o", "total", "w")
    assert {r.o: r.share for r in shares.collect()} == {1: 3, 2: 7, 3: 0, 4: 0}
    assert store.state_counts(df.limit(0), now).count() == 0


def test_records_take_the_latest_and_break_ties(spark):
    rows = [(1, AT, "a"), (1, datetime(2026, 1, 1), "b"), (2, None, "c"), (2, AT, "d"), (None, AT, "e"), (3, AT, "x"), (3, AT, "y")]
    got = {r.id: r.v for r in store.records(spark.createDataFrame(rows, "id long, updated_at timestamp, v string")).collect()}
    assert got == {1: "b", 2: "d", 3: "y"}


@pytest.mark.parametrize("bound", [100, 1])
def test_lookup_join_is_the_same_with_and_without_broadcast(spark, bound):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "i int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    got = session.lookup_join(facts, lookup, "k", "left", max_rows=bound)
    assert got.count() == 91 and Counter(r.v for r in got.collect()) == {1: 60, 2: 1, None: 30}
    assert session.lookup_join(facts, lookup, "k", "inner", max_rows=bound).count() == 61


def slow_terms(places, counts):
    """Absorption by the direct loop, for one text."""
    kept, covered = [], []
    for size in (4, 3, 2, 1):
        level = []
        for term in sorted(t for t in counts if t.count(" ") + 1 == size):
            own = [p for p in places if p[3] == term]
            inside = sum(any(c[0] == p[0] and c[1] <= p[1] and p[2] <= c[2] for c in covered) for p in own)
            if inside < 0.8 * counts[term]:
                level.append(term)
        kept += level
        covered += [p for p in places if p[3] in level and p[2] > p[1]]
    return set(kept)


def test_discovery_against_a_direct_loop(spark):
    rng = random.Random(3)
    vocabulary = ["Long", "Harbour", "Gate", "Vex", "Rotor", "walks", "of", "the", "old", "XTV", "Mr"]
    docs = [(i, "\n".join("The " + " ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(30))) for i in range(6)]
    df = spark.createDataFrame(docs, "k int, t string")
    got = {(r.s, r.source, r["count"]) for r in glossary.discover_terms(df.withColumn("s", F.col("k")), "s", "k", "t").collect()}
    want = set()
    for k, text in docs:
        places, _ = glossary.occurrences(text)
        counts = Counter(p[3] for p in places)
        mid = Counter(p[3] for p in places if not p[4])
        good = {t: n for t, n in counts.items() if n >= 3 and mid[t]}
        want |= {(k, t, good[t]) for t in slow_terms([p for p in places if p[3] in good], good)}
    assert got == want and want


def test_glossaries(spark):
    texts = spark.createDataFrame([("j", 1, "The Vex Rotor turns.", "Vex rotor döner."), ("j", 2, "Vexed by Vex", "kızgın"), ("j", 3, None, None)], "j string, k int, s string, t string")
    terms = spark.createDataFrame([("j", "Vex", "Vex"), ("j", "Vex Rotor", "Vex rotoru"), ("j", "++", "x"), ("j", "turn", "y"), ("x", "The", "z")], "j string, source string, target string")
    assert {(r.k, r.source) for r in glossary.terms_in_texts(texts, terms, ["j"], "k", "s").collect()} == {(1, "Vex"), (1, "Vex Rotor"), (2, "Vex")}
    assert {(r.k, r.source) for r in glossary.glossary_misses(texts, terms, ["j"], "k", "s", "t").collect()} == {(2, "Vex")}
    old = spark.createDataFrame([("a", "A", 1, "approved", "user", "n"), ("b", "B", 2, "approved", "user", "n")], "source string, target string, count int, status string, origin string, note string")
    new = spark.createDataFrame([("a", "", 5, "proposed", "discovered", ""), ("c", "", 6, "proposed", "discovered", "")], old.schema)
    got = {r.source: (r.target, r["count"], r.status) for r in glossary.merge_existing(new, old, ["source"]).collect()}
    assert got == {"a": ("A", 5, "approved"), "b": ("B", 2, "approved"), "c": ("", 6, "proposed")}
    assert {r.source: r.target for r in glossary.merge_with_precedence([old, new], ["source"]).collect()} == {"a": "", "b": "B", "c": ""}


def test_clusters_equal_the_pairwise_scan(spark):
    rng = random.Random(9)
    boxes = [("d", p, i, x := rng.uniform(0, 400), y := rng.uniform(0, 400), x + rng.uniform(1, 40), y + rng.uniform(1, 40)) for p in range(3) for i in range(70)]
    df = spark.createDataFrame(boxes, "d string, p int, i int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.p, r.i): r.cluster for r in layout.clusters(df, ["d", "p"], "i", 9.0).collect()}
    for p in range(3):
        own = [b for b in boxes if b[1] == p]
        label = {b[2]: b[2] for b in own}
        changed = True
        while changed:
            changed = False
            for a in own:
                for b in own:
                    if max(0, max(a[3], b[3]) - min(a[5], b[5]), max(a[4], b[4]) - min(a[6], b[6])) <= 9 and label[a[2]] != label[b[2]]:
                        label[a[2]] = label[b[2]] = min(label[a[2]], label[b[2]])
                        changed = True
        assert {i: got[p, i] for i in label} == label


def test_layout(spark):
    rows = [("d", 1, 1, 0.0, 0.0, 100.0, 10.0, 10.0, 0), ("d", 1, 2, 0.0, 12.0, 90.0, 22.0, 10.0, 0), ("d", 1, 3, 300.0, 1.0, 400.0, 11.0, 10.0, 0), ("d", 1, 4, 0.0, 60.0, 90.0, 70.0, 10.0, 0)]
    df = spark.createDataFrame(rows, "d string, p int, i int, x0 double, y0 double, x1 double, y1 double, size double, dir int")
    assert {r.i: r.grp for r in layout.group_lines(df, ["d", "p"], "i").collect()} == {1: 1, 2: 1, 3: 2, 4: 3}
    assert {r.i: (r.row, r.place) for r in layout.text_rows(df, ["d", "p"], "i").collect()} == {1: (1, 1), 3: (1, 2), 2: (2, 1), 4: (3, 1)}
    crossing = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 100.0, 20.0, True), ("d", 1, 2, 0.0, 10.0, 100.0, 40.0, True), ("d", 1, 3, 98.0, 0.0, 200.0, 15.0, False)], "d string, p int, i int, x0 double, y0 double, x1 double, y1 double, painted boolean")
    got = {r.i: (r.x1, r.y0, r.y1, r.dropped) for r in layout.separate(crossing, ["d", "p"], "i", "painted").collect()}
    assert got == {1: (98.0, 0.0, 15.0, False), 2: (100.0, 15.0, 40.0, False), 3: (200.0, 0.0, 15.0, False)}
    assert layout.clusters(df.limit(0), ["d", "p"], "i", 1.0).count() == 0


def test_queue(spark):
    log = spark.createDataFrame([(1, 1, "claim"), (1, 2, "reschedule"), (1, 3, "claim"), (1, 4, "complete"), (1, 5, "fail"), (2, 1, "complete"), (3, 1, "claim"), (3, 2, "fail"), (3, 3, "reset")], "u int, o int, e string")
    got = {r.u: (r.status, r.applied, r.ignored, r.retries) for r in queue.replay(log, "u", ["o"], "e").collect()}
    assert got == {1: ("COMPLETED", 4, 1, 1), 2: ("PENDING", 0, 1, 0), 3: ("PENDING", 3, 0, 0)}
    calls = spark.createDataFrame([(1, i, float(i), i in (2, 3)) for i in range(60)], "pool int, o int, at double, limited boolean")
    assert queue.permits(calls, "pool", ["o"], 8, grow_after=10, cooldown_s=5.0).first()["permits"] == 7
    delays = spark.range(50).select(queue.delay(F.lit(10), F.col("id"), F.lit(None).cast("double"), floor=5.0).alias("d")).collect()
    assert all(5 <= r.d <= 60 for r in delays) and len({r.d for r in delays}) > 10


def test_provider_batches(spark):
    assert tables.greedy_batches([3, 3, 9, 1, 1, 1], 2, 6) == [(0, 2), (2, 3), (3, 5), (5, 6)] and tables.greedy_batches([], 2, 6) == []
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.translated_text for r in tables.translate(df, "k", "t").collect()} == {1: "A", 2: None, 3: ""}
    with pytest.raises(Exception, match="came back"):
        tables.translate(df, "k", "t", provider=lambda ts: ts[:0]).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 1, "entries": [{"source": "A", "target": null, "count": 2}]}')
    (tmp_path / "b.json").write_text('{"schema_version": 7, "entries": []}')
    (tmp_path / "c.json").write_text("{broken")
    files = tables.read_json(spark, str(tmp_path / "*.json"), tables.GLOSSARY).cache()
    assert [(r.source, r.target, r.status) for r in tables.glossary_entries(files).collect()] == [("A", "", "proposed")]
    assert {(r.path[-6:], r.rule) for r in tables.file_violations(files).collect()} == {("b.json", "version"), ("c.json", "unreadable")}
    (tmp_path / "x.pdf").write_bytes(b"junk%PDF-1.4 /Encrypt")
    (tmp_path / "y.pdf").write_bytes(b"no")
    assert {r.path[-5:]: (r.valid, r.encrypted) for r in tables.pdf_files(spark, str(tmp_path)).where("path like '%.pdf'").collect()} == {"x.pdf": (True, True), "y.pdf": (False, False)}
    tables.write_markdown(spark.createDataFrame([("j", '<!-- image:1 src="a.png" -->\ntext\n<!-- legend:1 -->\n- x')], "j string, text string"), str(tmp_path / "md"), "j")
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["![Figure 1](a.png)", "text", "- x"]
    rows = spark.createDataFrame([(1, "PENDING")], "id int, status string")
    tables.replace_all(rows, str(tmp_path / "state"), rows.limit(0))
    with pytest.raises(ValueError, match="lost"):
        tables.replace_all(rows, str(tmp_path / "state2"), rows.limit(0), rows.withColumn("status", F.lit("COMPLETED")))
