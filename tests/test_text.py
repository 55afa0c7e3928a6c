"""Scalar functions against hand-made values."""

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.orderBy("i").select(fn(F.col("t")).alias("x")).collect()]


def test_patterns_and_numbers(spark):
    assert values(spark, T.line_pattern, ["Page 12 — The END!", "  a  b ", None, ""]) == ["page # the end", "a b", None, ""]
    assert values(spark, T.is_page_number, ["47", " page 47 ", "xii", "3 / 120", "3 of 120", "12345", "intro", None]) == [True] * 5 + [False, False, None]
    assert values(spark, T.numbered_level, ["Chapter 3", "3 Title", "3.2 Title", "3.2.1.4 Deep", "Title 3", "part iv end"]) == [1, 1, 2, 3, None, 1]
    assert values(spark, lambda c: T.round_half(c.cast("double")), ["1.25", "1.75", "1.3"]) == [1.0, 2.0, 1.5]


def test_marks(spark):
    got = values(spark, T.list_marker, ["• item", "- item ", "12. item", "3) x", "a) y", "1234. no", "text", None])
    assert [tuple(r) if r else None for r in got] == [("-", "item"), ("-", "item"), ("12.", "item"), ("3.", "x"), ("-", "y"), None, None, None]
    got = values(spark, T.footnote_definition, ["1 Some note.", "*) starred", "no note", "1234 x"])
    assert [tuple(r) if r else None for r in got] == [("1", "Some note."), ("*", "starred"), None, None]
    got = values(spark, T.image_line, ['<!-- image:12 src="a/b.png" -->', "<!-- image:3 -->", "<!-- image:x -->"])
    assert [tuple(r) if r else None for r in got] == [(12, "a/b.png"), (3, None), None]
    got = values(spark, T.legend_marker, ['<!-- legend:4 more="2" -->', "<!-- legend:5 -->", "x"])
    assert [tuple(r) if r else None for r in got] == [(4, 2), (5, 0), None]
    assert one(spark, T.format_image_line(F.lit(3), F.lit("a.png"))) == '<!-- image:3 src="a.png" -->'
    assert one(spark, T.format_legend_marker(F.lit(3), F.lit(0))) == "<!-- legend:3 -->"


def test_predicates(spark):
    assert values(spark, T.ends_with_terminal, ["End.", "End.⁹ ", "go on", "“Quote”", "", None]) == [True, True, False, True, False, None]
    assert values(spark, T.looks_like_caption, ["figure 3", "Figures", "Tablet", "TABLE"]) == [True, False, False, True]
    assert values(spark, T.matches_caption, ["Figure 3", "figure 3", "Fig. A", "Table of"]) == [True, False, True, False]
    assert values(spark, T.is_title_case, ["The Great Work", "The great work", "a of to"]) == [True, False, False]
    assert values(spark, T.font_family, ["DejaVu Sans Mono", "Arial", "Times", None]) == ["mono", "sans", "serif", None]
    assert values(spark, T.is_footnote_marker, ["12", "*†", "a", ""]) == [True, True, False, False]


def test_small_functions(spark):
    assert values(spark, T.turkish_fold, ["IİŞ", None]) == ["ıiş", None]
    assert values(spark, T.target_stem, ["vana", "manivela", "at"]) == ["vana", "manive", "at"]
    assert one(spark, T.color_hex(F.lit(255))) == "#0000ff" and one(spark, T.color_hex(F.lit(-4))) == "#000000"
    assert values(spark, lambda c: T.truncated(c, 5), ["abcdef", "abcde"]) == ["abcd…", "abcde"]
    assert tuple(values(spark, T.marker_counts, ["**b** *i* `c` [^1]"])[0]) == (2, 2, 2, 1)
    assert values(spark, lambda c: T.redacted(c, ["key", "key-long"]), ["a key-long key"]) == ["a *** ***"]
    assert values(spark, T.strip_markup, ["<b>x</b><!-- c --><script>y</script> < z"]) == ["x < z"]
    assert values(spark, T.strip_control, ["a\x14b\t"]) == ["ab\t"]
    assert values(spark, T.words, ["İki 3 şey_x", None]) == [["i̇ki", "şey", "x"], None]


def test_joining_lines(spark):
    words = F.array(F.lit("well-known"))
    join = lambda a, b: tuple(one(spark, T.union_lines(F.lit(a), F.lit(b), words)))
    assert join("a trans-", "lation") == ("a translation", None) and join("well-", "known fact") == ("well-known fact", None)
    assert join("the Anglo-", "Saxon") == ("the Anglo-Saxon", "Anglo-Saxon") and join("x-", "ray") == ("x-ray", "x-ray")
    assert join("plain", "line") == ("plain line", None) and join("", "b") == ("b", None) and join("1-", "2") == ("1- 2", None)
    goes = lambda a, b: one(spark, T.continues_on_next_page(F.lit(a), F.lit(b)))
    assert goes("the old", "tank") and not goes("the end.", "tank") and not goes("the old", "Tank") and goes("tan-", "Ker")


def test_configuration_values(spark):
    assert values(spark, tables.page_ranges, ["2,5-7", "3", "7-5", "x", "1-3,2", None]) == [[2, 5, 6, 7], [3], None, None, [1, 2, 3], None]
    assert values(spark, tables.page_margins, ["10pt", "10pt 20pt", "1 2 3", "25.4"]) == [[10.0] * 4, [10.0, 20.0, 10.0, 20.0], None, [72.0] * 4]


def test_boxes(spark):
    box = lambda *v: G.box(*map(F.lit, v))
    assert one(spark, G.overlap_area(box(0, 0, 10, 10), box(5, 5, 20, 20))) == 25 and one(spark, G.overlap_area(box(0, 0, 1, 1), box(1, 1, 2, 2))) == 0
    assert one(spark, G.gap(box(0, 0, 1, 1), box(4, 3, 5, 5))) == 3
    lines = lambda *bs: F.array(*[box(*b) for b in bs])
    none = F.lit(None).cast(G.BOX)
    align = lambda *bs: one(spark, G.alignment(lines(*bs), none))
    assert align((0, 0, 100, 9), (0, 10, 100, 19), (0, 20, 40, 29)) == "justify" and align((0, 0, 90, 9), (0, 10, 50, 19)) == "left"
    assert align((20, 0, 80, 9), (0, 10, 100, 19), (40, 20, 60, 29)) == "center" and align((40, 0, 100, 9), (0, 10, 100, 19)) == "right"
    assert one(spark, G.alignment(lines((40, 0, 60, 9)), box(0, 0, 100, 20))) == "center"
    assert one(spark, G.first_line_indent(lines((12, 0, 100, 10), (0, 10, 100, 20)))) == 12
    quarter = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (0.0, 1.0, -1.0, 0.0, 0.0, 0.0))])
    assert tuple(one(spark, G.transformed(box(1, 2, 3, 5), quarter))) == (-5, 1, -2, 3)
