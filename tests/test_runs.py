"""Logs, leases, outcomes, paragraphs, headings, figures, legends, contents, runs of hot scopes, JSON files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import markdown as P
from quire.operators import layout, lines, runs
from quire.operators import markdown as M
from quire.sources import tables


def test_leases_against_a_direct_loop(spark):
    rng = random.Random(1)
    rows = [(j, n, rng.choice("ab"), rng.choice(["acquire", "heartbeat", "release"]), float(n * rng.choice([5, 40]))) for j in "xy" for n in range(40)]
    got = {(r.job, r.n): r.granted for r in runs.leases(spark.createDataFrame(rows, "job string, n int, holder string, kind string, at double"), "job", ["n"], "at", 60.0).collect()}
    held = {}
    for job, n, holder, kind, at in rows:
        owner, seen = held.get(job, (None, 0.0))
        ok = kind == "acquire" and (owner in (None, holder) or seen <= at - 60) or kind != "acquire" and owner == holder
        if ok:
            held[job] = (None, 0.0) if kind == "release" else (holder, at)
        assert got[job, n] is ok
    assert runs.leases(spark.createDataFrame([], "job string, n int, holder string, kind string, at double"), "job", ["n"], "at", 1.0).count() == 0


def test_logs(spark):
    jobs = spark.createDataFrame([("a", "NEW", "p", 1), ("b", "NEW", None, 1), (None, "x", "x", 9)], "id string, status string, provider string, t int")
    changes = spark.createDataFrame([("a", "DONE", None, 2), ("c", "NEW", "q", 3), ("a", "OLD", "r", 0)], jobs.schema)
    assert {tuple(r) for r in runs.upserted(jobs, changes, "id", "t").collect()} == {("a", "DONE", "p", 2), ("b", "NEW", None, 1), ("c", "NEW", "q", 3)}
    assert runs.single(jobs.where("id = 'a'")).count() == 1 and runs.single(jobs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than one"):
        runs.single(jobs)
    assert runs.job_of(jobs, "a", "t").first().status == "NEW" and runs.job_of(jobs, "z", "t").count() == 0
    codes = spark.createDataFrame([("state_locked",), ("provider_quota",), ("odd",), (None,)], "e string")
    assert [r[0] for r in codes.select(runs.exit_code(F.col("e"))).collect()] == [4, 3, 1, 0]


def test_paragraphs(spark):
    texts = [("A first line that is full", 10, 200), ("ends short.", 10, 100), ("Another one begins and", 10, 200), ("goes on to the full width", 10, 200), ("for a while.", 10, 90), ("Set in and full.", 20, 200), ("- item one", 10, 199), ("hanging under it", 20, 199), ("- item two", 10, 200)]
    rows = [("g", k, float(a), 12.0 * k, float(b), 12.0 * k + 10, 10.0, t) for k, (t, a, b) in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, i int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    got = {r.i: r.paragraph for r in layout.paragraphs(df, ["g"], "i").collect()}
    assert [got[k] for k in range(6)] == [1, 1, 2, 2, 2, 3] and got[8] == got[7] + 1
    assert layout.paragraphs(df.limit(0), ["g"], "i").count() == 0


def test_figures_are_clusters_of_what_is_no_decoration(spark):
    rows = [(1, 1, 100.0, 100.0, 200.0, 200.0, False, False), (1, 2, 205.0, 120.0, 260.0, 180.0, False, False), (1, 3, 400.0, 400.0, 500.0, 401.0, True, False), (1, 4, 201.0, 150.0, 204.0, 151.0, True, True), (1, 5, 0.0, 0.0, 595.0, 842.0, False, False), (1, 6, 50.0, 700.0, 53.0, 703.0, False, True)]
    drawings = spark.createDataFrame(rows, "p int, i int, x0 double, y0 double, x1 double, y1 double, thin boolean, small boolean")
    pages = spark.createDataFrame([(1, 595.0, 842.0)], "p int, width double, height double")
    none = drawings.select("p", "x0", "y0", "x1", "y1").limit(0)
    found = layout.decorations(drawings, pages, none, none, ["p"], "i")
    assert {r.i: r.reason for r in found.collect()} == {3: "rule", 5: "background", 6: "bullet"}
    got = layout.figures(drawings, found, ["p"], "i", 12.0, 20.0).collect()
    assert [(r.members, r.x0, r.x1) for r in got] == [(3, 100.0, 260.0)]


def test_line_pitch(spark):
    boxes = [[(0.0, float(y), 50.0, y + 10.0) for y in ys] for ys in ((0, 12, 24, 60), (0,), (), (5, 5), (0, 100))]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(boxes)], "k int, b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [r.p for r in df.orderBy("k").select(G.line_pitch(F.col("b"), F.lit(10.0)).alias("p")).collect()] == [1.2, 1.15, 1.15, 1.15, 1.4]


def test_legends():
    text = "para\n\n<!-- legend:3 -->\n- a\n- b\n\n*… ve 2 etiket daha*\n\nnext\n```\n<!-- legend:4 -->\n- in code\n```\n<!-- legend:5 -->\n- c"
    assert [b[2] for b in P.legend_blocks(text)] == [3, 5]
    assert P.strip_legends(text, {3}) == "para\n\nnext\n```\n<!-- legend:4 -->\n- in code\n```\n<!-- legend:5 -->\n- c\n"
    assert P.strip_legends("no legend") == "no legend" and "- c" not in P.strip_legends(text) and "- in code" in P.strip_legends(text)
    images = 'x\n<!-- image:1 src="a.png" -->\n```\n<!-- image:1 src="a.png" -->\n```\n<!-- image:2 -->'
    assert P.rewrite_images(images, {1: "b.png", 2: "c.png"}) == images.replace("a.png", "b.png", 1)
    assert P.escape_ordinals("1. a\nb 2. c\n> 3) d") == ("1\\. a\nb 2. c\n> 3\\) d", 2)


def test_contents_against_a_direct_loop(spark):
    rng = random.Random(4)
    levels = [rng.randint(1, 6) for _ in range(60)]
    df = spark.createDataFrame([("d", k, n, f"t{k}") for k, n in enumerate(levels, 1)], "d string, heading_no int, level int, title string")
    got = {r.heading_no: (r.number, r.parent) for r in M.contents(df, "d").collect()}
    count, above = [0] * 7, {}
    for k, n in enumerate(levels, 1):
        count[n] += 1
        count[n + 1 :] = [0] * (6 - n)
        higher = [j for j in range(1, k) if levels[j - 1] < n]
        assert got[k] == (".".join(map(str, count[1 : n + 1])), max(higher, default=None)), (k, above)
    text = spark.createDataFrame([(1, "a[^x]"), (2, None)], "d int, text string")
    assert M.without_legends(text, "d", "text").count() == 1
    places = M.footnote_places(spark.createDataFrame([(1, 0, 0, 50), (1, 1, 50, 90)], "d int, chapter int, start int, stop int"), spark.createDataFrame([(1, "x", 60), (1, "x", 10), (1, "y", 80)], "d int, label string, at int"), "d")
    assert {r.label: r.chapter for r in places.collect()} == {"x": 0, "y": 1}


def test_runs_of_a_scope_that_spans_partitions(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), k, rng.choice("xy")) for k in range(3000)] + [(None, 1, "x"), (None, 2, None)]
    df = spark.createDataFrame(rows, "s string, o int, kind string").repartition(7)
    number = lambda hot: {(r.s, r.o): r.island for r in lines.islands(df, ["s"], ["o"], ["kind"], hot=hot).collect()}
    assert number(True) == number(False)


def test_files_that_are_written_can_be_read(spark, tmp_path):
    entries = spark.createDataFrame([("j", "b", "x", 1, "approved", "user", ""), ("j", "a", None, 2, "proposed", "discovered", "n")], "job string, source string, target string, count int, status string, origin string, note string")
    tables.save_glossary(entries, str(tmp_path / "g"), "job")
    got = json.loads(next((tmp_path / "g" / "job=j").glob("*.txt")).read_text())
    assert [e["source"] for e in got["entries"]] == ["a", "b"] and got["schema_version"] == 1 and got["entries"][0]["target"] is None
    figures = spark.createDataFrame([("j", 2, "vector", ["l"], [[0.0, 0.0, 1.0, 1.0]], 5, 5, "p"), ("j", 1, "odd", ["l"], [[0.0]], 0, 5, "p")], "job string, image_id long, kind string, labels array<string>, label_boxes array<array<double>>, width int, height int, path string")
    tables.save_figures(figures, str(tmp_path / "f"), "job")
    assert [f["image_id"] for f in json.loads(next((tmp_path / "f" / "job=j").glob("*.txt")).read_text())["figures"]] == [1, 2]
    assert {(r.image_id, r.rule) for r in tables.figure_violations(figures).collect()} == {(1, "kind"), (1, "size"), (1, "boxes")}
    entries.write.parquet(str(tmp_path / "state"))
    tables.archive(spark, str(tmp_path / "state"), str(tmp_path / "old"), "t1")
    with pytest.raises(Exception, match="exists"):
        tables.archive(spark, str(tmp_path / "state"), str(tmp_path / "old"), "t1")
    log = tables.log_lines(spark.createDataFrame([("INFO", "key sesame here", 3), ("WARN", None, None)], "level string, message string, n int"), ["sesame"])
    assert [json.loads(r.value) for r in log.collect()][1] == {"level": "WARN"} and "sesame" not in log.first().value
    assert tables.registered(tables.PROVIDERS, " Upper ") is tables.upper_provider
    with pytest.raises(ValueError, match="unknown provider"):
        tables.registered(tables.PROVIDERS, "x")


def test_scales_are_shared_as_in_a_direct_loop(spark):
    def direct(values, threshold, drop):
        """Unit by unit, without counts."""
        out, pending = {}, list(enumerate(values))
        while len(pending) >= 2:
            ordered = sorted(v for _, v in pending)
            middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
            near = [(i, v) for i, v in pending if v >= max(threshold, middle - 0.10)]
            low = min((v for _, v in near), default=1.0)
            capped = [(i, v) for i, v in near if v <= low / (1 - drop)]
            scale = threshold if low * 0.99 < threshold <= low else low * 0.99
            final = [(i, v) for i, v in capped if scale >= v * (1 - drop)]
            gone = near if len(near) < 2 or low >= 1.0 else capped if len(capped) < 2 else final
            if len(near) >= 2 and low < 1.0 and len(capped) >= 2 and len(final) >= 2:
                out |= {i: scale for i, _ in final}
            if not gone:
                break
            pending = [p for p in pending if p not in gone]
        return [out.get(i, v) for i, v in enumerate(values)]

    rng = random.Random(3)
    styles = {k: [rng.choice([0.55, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 1.0]) for _ in range(rng.randint(1, 12))] for k in range(60)}
    rows = [(k, i, v) for k, vs in styles.items() for i, v in enumerate(vs)] + [(99, 0, None), (None, 0, 0.8), (None, 1, 0.8)]
    got = {(r.s, r.u): r.scale for r in layout.shared_scales(spark.createDataFrame(rows, "s int, u int, natural double"), ["s"], "u", 0.6).collect()}
    for k, vs in styles.items():
        assert [got[k, i] for i in range(len(vs))] == pytest.approx(direct(vs, 0.6, 0.10))
    assert got[99, 0] is None and got[None, 0] == got[None, 1] == pytest.approx(0.792)
