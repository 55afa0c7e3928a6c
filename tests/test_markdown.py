"""Invariants of the Markdown parsers on random and hand-made texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import markdown as M
from quire.functions.sentences import split_sentences
from quire.operators import markdown as D

SHAPES = [
    "# Title\n\n", "## Part two\n", "A paragraph of words. It has two sentences!\n\n", "- one\n- two\n  - deep\n\n", "1. first\n2. second\n\n", "> quoted\n> more\n\n", "```\ncode - x\n```\n\n",
    "| a | b |\n|---|---|\n| c | d |\n\n", "<!-- image:3 -->\n\n", "<!-- legend:3 -->\n- cat\n- dog\n\n", "<!-- legend:9 -->\n\n", "---\n\n", "[^1]: A note. More.\n\n", "\n", "   \n", "x" * 90 + "\n\n", "text\r\nwith cr\r\n",
    "see [a](http://x.y/z) and `code` www.a.b, [^1]\n\n", "a < b & c &amp; <x id=\"1\"/>\n",
]
texts = st.lists(st.sampled_from(SHAPES), max_size=25).map("".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 120), st.integers(1, 160))
def test_everything_tiles(text, least, most):
    blocks = M.blocks(text)
    assert "".join(text[b.start : b.end] for b in blocks) == text
    chunks = M.chunks(text, least, most)
    assert "".join(text[c.start : c.end] for c in chunks) == text
    assert all(c.end - c.start <= most for c in chunks if c.block is not None)
    found, tail = M.segments(text)
    assert "".join(a + b + c for a, b, c in found) + tail == text
    assert all(b == b.strip() and b for _, b, _ in found)
    assert "".join(split_sentences(text)) == text
    masked, kept = M.protect(text)
    assert M.restore(masked, kept) == (text, [])
    assert M.normalize(M.normalize(text)) == M.normalize(text)


def test_blocks():
    kinds = [(b.kind, b.level, b.translatable) for b in M.blocks("".join(SHAPES[:11]))]
    assert kinds == [
        ("HEADING", 1, True), ("HEADING", 2, True), ("PARAGRAPH", 0, True), ("LIST", 1, True), ("LIST", 0, True), ("BLOCKQUOTE", 0, True), ("CODE", 0, False), ("TABLE", 0, True),
        ("IMAGE", 0, False), ("LIST", 0, True), ("PARAGRAPH", 0, False),
    ]
    assert M.blocks("") == [] and [b.kind for b in M.blocks("```\nnever closed\n\n# no")] == ["CODE"]


def test_chunks_keep_headings_with_what_follows():
    text = "# One\n\n" + "Words here. " * 9 + "\n\n# Two\n\n" + "More words. " * 9 + "\n"
    got = M.chunks(text, 80, 130)
    assert [c.path for c in got] == [("One",), ("Two",)] and all(text[c.start : c.end].startswith("#") for c in got)


def test_restore_reports_what_a_provider_broke():
    masked, kept = M.protect("use `a` and `b` now")
    assert M.restore(masked.replace('<x id="1"/>', "<x id='1'></x>"), kept) == ("use `a` and `b` now", [])
    assert M.restore(masked.replace(' and <x id="2"/>', ""), kept) == ("use `a` now `b`", ["missing:2"])
    assert M.restore(masked.replace('id="2"', 'id="1"'), kept)[1] == ["doubled:1", "missing:2"]
    assert M.unescape("&amp;lt;") == "&lt;"


def test_structure():
    s = M.structure("# A *b*\n\n- x\n- y\n\n1. one\ntext\n2. not counted\n\n3. counted\n\n```\n- no\n```\n")
    assert s["headings"] == [(1, "A b")] and s["bullets"] == 2 and s["fences"] == 1 and s["ordered"] == 2


def test_frames(spark):
    rows = [(1, "# A\n\ntext one. text two.\n"), (2, None), (3, ""), (4, "word " * 40_000), (1, "# A\n\ntext one. text two.\n")]
    df = spark.createDataFrame(rows, "k long, t string").selectExpr("*", "1 as kind", "2 as text", "3 as start")
    assert sorted(r.kind for r in D.block_rows(df, "k", "t").where("k = 1").collect()) == ["HEADING", "HEADING", "PARAGRAPH", "PARAGRAPH"]
    once = df.dropDuplicates(["k"])
    chunks = D.chunk_rows(once, "k", "t", 500, 800)
    assert D.lossless(once, "k", "t", chunks, "chunk_id", "source_text").count() == 0 and chunks.where("char_count > 800").count() == 0
    assert D.chunk_rows(df.limit(0), "k", "t").count() == 0
    assert [tuple(r) for r in D.structure_mismatches(df.where("k = 1").limit(1).selectExpr("k", "t", "'## A' as u"), "k", "t", "u").collect()] == [(1, "headings")]
    chapters = D.chapters(D.block_rows(spark.createDataFrame([(1, "intro\n\n# A\n\nx\n\n# B\n\ny\n")], "k long, t string"), "k", "t"), "k")
    assert sorted((r.chapter, r.first_block, r.last_block) for r in chapters.collect()) == [(0, 1, 1), (1, 2, 3), (2, 4, 5)]
