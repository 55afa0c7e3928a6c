"""Operators over ordered lines: repeated lines, hyphenation, sizes, headings, runs and cross-page paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import stored

#: Pages on which a pattern must stand at least, and the share of pages.
MIN_PAGES, PAGE_SHARE = 3, 0.30


def explode_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a line: ``keys``, line_no (from 0), line. CR before LF isn't part of a line; a null text has none."""
    lines = F.split(F.regexp_replace(df[text], "\r\n", "\n"), "\n")
    return df.select(*[df[k] for k in keys], F.posexplode(lines).alias("line_no", "line"))


def running_patterns(
    lines: DataFrame, scope: str, page: str, line: str, min_pages: int | None = None, share: float = PAGE_SHARE
) -> DataFrame:
    """``scope``, pattern, pages: patterns of lines that repeat on enough pages of a scope.

    A pattern counts once a page; page numbers and empty patterns don't count. Without ``min_pages``
    the bound is ``max(3, ceil(share * pages of the scope))``. Pages are made distinct before they are
    counted, both steps combined map-side, so neither a hot scope nor a hot line gathers in one task.
    """
    rows = lines.select(lines[scope].alias("_s"), lines[page].alias("_p"), T.line_pattern(lines[line]).alias("pattern"), T.is_page_number(lines[line]).alias("_n"))
    seen = rows.where(~F.col("_n") & ~F.col("pattern").isin("", "#")).select("_s", "_p", "pattern").distinct()
    counts = seen.groupBy("_s", "pattern").agg(F.count("*").alias("pages"))
    if min_pages is not None:
        kept = counts.where(F.col("pages") >= min_pages)
    else:
        sizes = rows.select("_s", "_p").distinct().groupBy("_s").agg(F.greatest(F.lit(MIN_PAGES), F.ceil(F.count("*") * share)).alias("_least"))
        kept = counts.where(F.col("pages") >= MIN_PAGES).join(sizes, "_s").where(F.col("pages") >= F.col("_least"))
    return kept.select(F.col("_s").alias(scope), "pattern", "pages")


def drop_lines(lines: DataFrame, patterns: DataFrame, scope: str, line: str) -> DataFrame:
    """The lines that are neither page numbers nor of a running pattern of their scope."""
    marked = lines.where(~F.coalesce(T.is_page_number(lines[line]), F.lit(False))).withColumn("_pattern", T.line_pattern(F.col(line)))
    found = patterns.select(F.col(scope).alias("_s"), F.col("pattern").alias("_q"))
    return marked.join(found, (F.col("_pattern") == F.col("_q")) & (F.col(scope) == F.col("_s")), "left_anti").drop("_pattern")


def compounds(lines: DataFrame, line: str) -> DataFrame:
    """compound, n: hyphenated words that stand inside a line, in lower case, with their number."""
    # The last word of a line may be broken there, so it doesn't count.
    found = F.regexp_extract_all(F.regexp_replace(lines[line], rf"[{T.S}]+$", ""), F.lit(rf"(?<![{T.W}-])([{T.L}]+-[{T.L}]+)(?![{T.W}-])(?=.)"), F.lit(1))
    return lines.select(F.explode(found).alias("w")).groupBy(F.lower("w").alias("compound")).agg(F.count("*").alias("n"))


def joined_paragraph(lines: Column, compound_words: Column) -> Column:
    """struct(text, doubtful): the lines of a paragraph as one, hyphens resolved line by line."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("doubtful"))

    def step(state: Column, line: Column) -> Column:
        both = T.union_lines(state.text, T.squeezed(line), compound_words)
        return F.struct(both.text.alias("text"), F.concat(state.doubtful, F.array_compact(F.array(both.doubtful))).alias("doubtful"))

    return F.aggregate(lines, start, step)


def dominant_size(spans: DataFrame, keys: list[str], size: str, chars: str) -> DataFrame:
    """``keys``, size: the size (to half a point) that most characters have; the larger one of a tie."""
    weights = spans.where(F.col(chars) > 0).groupBy(*keys, T.round_half(spans[size]).alias("_z")).agg(F.sum(chars).alias("_w"))
    return weights.groupBy(*keys).agg(F.max(F.struct("_w", "_z")).alias("_b")).select(*keys, F.col("_b._z").alias("size"))


def dominant_style(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, font_size, bold, italic, family, color of the style that most characters have.

    Spans: text, size, bold, italic, font, color. Ties go to the larger size, then to the plain weight.
    """
    styled = spans.select(
        *keys, F.length(T.trimmed(F.col("text"))).alias("_n"), T.round_half(F.col("size")).alias("font_size"), "bold",
        (F.col("italic") | T.is_italic(F.col("font"))).alias("italic"), T.font_family(F.col("font")).alias("family"), "color",
    ).where("_n > 0")
    weights = styled.groupBy(*keys, "font_size", "bold", "italic", "family", "color").agg(F.sum("_n").alias("_w"))
    best = F.max(F.struct("_w", "font_size", (~F.col("bold")).alias("plain"), "italic", "family", "color")).alias("_style")
    return weights.groupBy(*keys).agg(best).select(*keys, "_style.font_size", (~F.col("_style.plain")).alias("bold"), "_style.italic", "_style.family", "_style.color")


def heading_tiers(headings: DataFrame, scope: str, size: str) -> DataFrame:
    """``scope``, size, level: distinct sizes of a scope from the largest, all beyond the third at level 3."""
    sizes = headings.select(headings[scope], T.round_half(headings[size]).alias("size")).distinct()
    return sizes.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy(scope).orderBy(F.desc("size"))), F.lit(3)))


def islands(df: DataFrame, scope: list[str], order: list[str], same: list[str], name: str = "island", hot: bool = False) -> DataFrame:
    """``df`` with a number (from 1) of each run of rows that agree in ``same``, in order within a scope.

    A scope of the size of a document is one window. With ``hot`` scopes may be of any size: the rows are
    sorted over range partitions, runs are numbered within each, and from one partition to the next only its
    first and last row and the numbers of runs of its scopes are carried on.
    """
    if not hot:
        w = Window.partitionBy(*scope).orderBy(*order)
        return _numbered(df, w, same, F.row_number().over(w) == 1, lambda c: F.lag(c).over(w), name)
    ranged = stored(df.repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    here = Window.partitionBy("_part").orderBy("_at")
    held = F.struct(*scope, *same)
    # One row a partition and one a scope of a partition: what is carried on.
    last = ranged.groupBy("_part").agg(F.max_by(held, "_at").alias("_held"))
    last = last.withColumn("_before", F.lag("_held").over(Window.orderBy("_part"))).select("_part", "_before")
    rows = ranged.join(F.broadcast(last), "_part").withColumn("_prev", F.coalesce(F.lag(held).over(here), F.col("_before")))
    fresh = F.col("_prev").isNull()
    for c in (*scope, *same):
        fresh = fresh | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    rows = rows.withColumn("_new", fresh.cast("int"))
    inner = Window.partitionBy("_part", *scope).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy("_part", *scope).agg(F.sum("_new").alias("_n"))
    upto = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_past", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where("_past > 0").drop("_n")
    on = [F.col("r._part") == F.col("s._part"), *(F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in scope)]
    both = rows.withColumn("_own", F.sum("_new").over(inner)).alias("r").join(starts.alias("s"), on, "left")
    return both.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("r._own") + F.coalesce("s._past", F.lit(0))).alias(name))


def _numbered(df: DataFrame, w: Window, same: list[str], first: Column, before: Callable[[str], Column], name: str) -> DataFrame:
    changed = first
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(before(c))
    return df.withColumn("_new", changed.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def footnote_refs(spans: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """``spans`` with ident: superscript markers joined to the definition of their page, numbered in order of reading.

    Spans: text, superscript, is_definition, marker (of a definition). The first definition of a marker on a
    page counts; numbers run through a scope, which is all of ``page`` but its last column, in the order
    of first references. A marker without definition has none.
    """
    mark = T.trimmed(F.col("text"))
    given = spans.where(F.col("is_definition") & F.col("marker").isNotNull()).groupBy(*page, F.col("marker").alias("_m")).agg(F.min(F.struct(*order)).alias("_o")).select(*page, "_m")
    refs = spans.where(F.col("superscript") & ~F.col("is_definition")).withColumn("_m", mark).join(given, [*page, "_m"], "left_semi")
    firsts = refs.groupBy(*page, "_m").agg(F.min(F.struct(*order)).alias("_o"))
    # A scope's footnotes are as few as a document has.
    ident = F.row_number().over(Window.partitionBy(*page[:-1]).orderBy(page[-1], "_o"))
    idents = firsts.select(*page, "_m", ident.alias("ident"))
    marked = spans.withColumn("_m", F.when(F.col("superscript") & ~F.col("is_definition"), mark))
    return marked.join(idents, [*page, "_m"], "left").select(*spans.columns, "ident")


def style_runs(spans: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``scope``, island, text, bold, italic: neighbouring spans of one style as one."""
    rows = spans.where(F.col("text") != "").withColumn("italic", F.col("italic") | T.is_italic(F.col("font")))
    runs = islands(rows, scope, order, ["bold", "italic"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("_t")))), lambda s: s["_t"]), "")
    return runs.groupBy(*scope, "island", "bold", "italic").agg(text.alias("text"))


def merge_across_pages(paragraphs: DataFrame, scope: str, page: str, order: str, text: str) -> DataFrame:
    """``scope``, paragraph (from 1), first_page, last_page, parts: paragraphs that go on over a page break as one.

    Only the last paragraph of a page and the first of the next page with any are joined.
    """
    w = Window.partitionBy(scope).orderBy(page, order)
    goes_on = T.continues_on_next_page(F.lag(text).over(w), F.col(text)) & (F.lag(page).over(w) != F.col(page))
    marked = paragraphs.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(page, order, F.col(text).alias("_t")))), lambda s: s["_t"])
    return marked.groupBy(scope, "paragraph").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), parts.alias("parts"))


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """content_hash, first_key, copies of the texts that stand under several keys; null and empty texts are none."""
    rows = df.where(df[text].isNotNull() & (df[text] != "")).select(df[key].alias("_k"), T.content_hash(df[text]).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("_k").alias("first_key"), F.count("*").alias("copies")).where("copies > 1")


def source_profile(pages: DataFrame, scope: str) -> DataFrame:
    """``scope``, width, height (the most frequent size, the larger of a tie), median margins to hundredths.

    Pages: width, height, left, top, right, bottom (the margins around the text; null without text).
    """
    sizes = pages.groupBy(scope, F.bround("width", 2).alias("_w"), F.bround("height", 2).alias("_h")).agg(F.count("*").alias("_n"))
    mode = sizes.groupBy(scope).agg(F.max(F.struct("_n", "_w", "_h")).alias("_m"))
    margins = pages.groupBy(scope).agg(*[F.bround(F.median(c), 2).alias(c) for c in ("left", "top", "right", "bottom")])
    return mode.join(margins, scope).select(scope, F.col("_m._w").alias("width"), F.col("_m._h").alias("height"), "left", "top", "right", "bottom")
