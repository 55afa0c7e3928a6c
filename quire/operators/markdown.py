"""Markdown parsers over tables of texts: blocks, chunks, segments, protection, structure, chapters.

One text is one row, parsed in Arrow batches; texts are independent, so nothing is shuffled. A null
text gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions import text as T


def _per_text(df: DataFrame, key: str, inputs: list[str], columns: dict[str, str], parse: Callable) -> DataFrame:
    """Rows (key, *columns) of what ``parse`` yields for the inputs of a row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r[0], *row) for r in pdf.itertuples(index=False) for row in parse(*r[1:])]
            yield pd.DataFrame(rows, columns=[key, *columns])

    rows = df.where(F.col(inputs[0]).isNotNull()).select(key, *inputs)
    return rows.mapInPandas(run, ", ".join([f"`{key}` {kind}", *(f"{c} {t}" for c, t in columns.items())]))


def block_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block_id (from 1), kind, level, start, stop, translatable; the blocks tile the text."""
    return _per_text(
        df, key, [text], {"block_id": "int", "kind": "string", "level": "int", "start": "int", "stop": "int", "translatable": "boolean"},
        lambda x: [(k, b.kind, b.level, b.start, b.end, b.translatable) for k, b in enumerate(M.blocks(x), 1)],
    )


def chunk_rows(df: DataFrame, key: str, text: str, least: int = 1000, most: int = 1500) -> DataFrame:
    """key, chunk_id (from 1), kind, translatable, block_id, sub_index, sub_count, heading_path, reason, source_text.

    Joined in order, the chunks give the text (checked by ``lossless``).
    """
    columns = {
        "chunk_id": "int", "kind": "string", "translatable": "boolean", "block_id": "int", "sub_index": "int", "sub_count": "int",
        "heading_path": "array<string>", "reason": "string", "source_text": "string",
    }
    rows = _per_text(
        df, key, [text], columns,
        lambda x: [(k, c.kind, c.translatable, c.block, c.sub_index, c.sub_count, list(c.path), c.reason, x[c.start : c.end]) for k, c in enumerate(M.chunks(x, least, most), 1)],
    )
    return rows.withColumn("char_count", F.length("source_text")).withColumn("content_hash", T.content_hash(F.col("source_text")))


def lossless(df: DataFrame, key: str, text: str, parts: DataFrame, order: str, part: str) -> DataFrame:
    """key of the texts that their parts, joined in order, don't give back."""
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(part).alias("_p"))))
    joined = parts.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["_p"]), "").alias("_j"))
    both = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).join(joined, key, "left")
    return both.where(F.col("_t") != F.coalesce("_j", F.lit(""))).select(key)


def segment_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, segment_no (from 1), prefix, text, suffix; the last row has the tail as prefix and no text."""

    def parse(x: str) -> list:
        found, tail = M.segments(x)
        return [(k, *s) for k, s in enumerate(found, 1)] + [(len(found) + 1, tail, "", "")]

    return _per_text(df, key, [text], {"segment_no": "int", "prefix": "string", "text": "string", "suffix": "string"}, parse)


def reassembled(segments: DataFrame, key: str, translated: str = "text") -> DataFrame:
    """key, text: segments with (translated) texts put back between their marks."""
    listed = F.array_sort(F.collect_list(F.struct("segment_no", F.concat("prefix", translated, "suffix").alias("_p"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["_p"]), "").alias("text"))


def protected(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text with placeholders, kept: what they stand for."""
    return _per_text(df, key, [text], {"text": "string", "kept": "array<string>"}, lambda x: [M.protect(x)])


def restored(df: DataFrame, key: str, text: str = "text", kept: str = "kept") -> DataFrame:
    """key, text with the kept spans, warnings: placeholders missing (then put at the end) or doubled."""
    return _per_text(df, key, [text, kept], {"text": "string", "warnings": "array<string>"}, lambda x, k: [M.restore(x, list(k) if k is not None else [])])


def structures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, headings (levels), titles, bullets, ordered, fences."""

    def parse(x: str) -> list:
        s = M.structure(x)
        return [([a for a, _ in s["headings"]], [b for _, b in s["headings"]], s["bullets"], s["ordered"], s["fences"])]

    return _per_text(df, key, [text], {"headings": "array<int>", "titles": "array<string>", "bullets": "int", "ordered": "int", "fences": "int"}, parse)


def structure_mismatches(df: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, what (headings, list_items, fences): where source and target differ; nulls aren't compared."""

    def parse(a: str, b: str | None) -> list:
        if b is None:
            return []
        s, t = M.structure(a), M.structure(b)
        out = []
        if [x for x, _ in s["headings"]] != [x for x, _ in t["headings"]]:
            out.append(("headings",))
        if s["bullets"] != t["bullets"] or (s["ordered"] and s["ordered"] != t["ordered"]):
            out.append(("list_items",))
        return [*out, ("fences",)] if s["fences"] != t["fences"] else out

    return _per_text(df, key, [source, target], {"what": "string"}, parse)


def outlines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, heading_no (from 1), level, title."""
    return _per_text(df, key, [text], {"heading_no": "int", "level": "int", "title": "string"}, lambda x: [(k, *h) for k, h in enumerate(M.outline(x), 1)])


def normalized(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text in clean Markdown."""
    return _per_text(df, key, [text], {"text": "string"}, lambda x: [(M.normalize(x),)])


def chapters(blocks: DataFrame, key: str) -> DataFrame:
    """key, chapter (0 before the first), first_block, last_block: texts cut at their highest repeated heading level.

    The level is the least one with two headings or more; without one the text is one chapter.
    """
    levels = blocks.where("kind = 'HEADING'").groupBy(key, "level").agg(F.count("*").alias("n")).where("n >= 2")
    level = levels.groupBy(key).agg(F.min("level").alias("_level"))
    w = Window.partitionBy(key).orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (F.col("kind") == "HEADING") & (F.col("level") == F.col("_level"))
    marked = blocks.join(level, key, "left").withColumn("chapter", F.sum(F.coalesce(cuts, F.lit(False)).cast("int")).over(w))
    return marked.groupBy(key, "chapter").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))


def footnotes(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """key, label, refs, definitions: how often a footnote is referred to and defined in a text."""
    is_def = F.regexp_extract(line, r"^\[\^([^\]\s]+)\]:[ \t]", 1)
    refs = F.regexp_extract_all(F.regexp_replace(line, r"^\[\^[^\]\s]+\]:", ""), F.lit(r"\[\^([^\]\s]+)\](?!:)"), F.lit(1))
    used = lines.select(key, F.explode(refs).alias("label"), F.lit(1).alias("r"), F.lit(0).alias("d"))
    made = lines.select(key, is_def.alias("label"), F.lit(0).alias("r"), F.lit(1).alias("d")).where("label <> ''")
    return used.unionByName(made).groupBy(key, "label").agg(F.sum("r").alias("refs"), F.sum("d").alias("definitions"))


def legends(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, legend_no (from 1), image_id, first_line, lines: the legends of a text outside code."""
    return _per_text(df, key, [text], {"legend_no": "int", "image_id": "long", "first_line": "int", "lines": "int"}, lambda x: [
        (no, image, a, b - a) for no, (a, b, image) in enumerate(M.legend_blocks(x), 1)
    ])


def without_legends(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text without its legends."""
    return _per_text(df, key, [text], {"text": "string"}, lambda x: [(M.strip_legends(x),)])


def with_images(df: DataFrame, key: str, text: str, sources: str) -> DataFrame:
    """key, text whose image lines name the files of ``sources`` (array of struct(image_id, src))."""

    def parse(x: str, given: list | None) -> list:
        return [(M.rewrite_images(x, {int(e["image_id"]): e["src"] for e in (given if given is not None else [])}),)]

    return _per_text(df, key, [text, sources], {"text": "string"}, parse)


def footnote_places(blocks: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """key, label, chapter: where a footnote's definition goes, which is the chapter that first refers to it.

    Blocks: key, chapter, start, stop. Refs: key, label, at (a position in the text). Labels nothing refers to have none.
    """
    a, b = refs.alias("a"), blocks.alias("b")
    hits = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.at") >= F.col("b.start")) & (F.col("a.at") < F.col("b.stop")))
    return hits.groupBy(F.col(f"a.{key}").alias(key), F.col("a.label").alias("label")).agg(F.min_by("b.chapter", "a.at").alias("chapter"))


def contents(outline: DataFrame, key: str) -> DataFrame:
    """key, heading_no, level, title, number, parent: a table of contents with numbers like 1.2 and the heading above.

    Outline: key, heading_no, level, title. A level that is skipped counts as 0 in the number.
    """
    w = Window.partitionBy(key).orderBy("heading_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = outline
    for n in range(1, 7):
        # A heading starts the levels below it anew: the last heading of a higher level bounds what is counted.
        rows = rows.withColumn(f"_from{n}", F.coalesce(F.max(F.when(F.col("level") < n, F.col("heading_no"))).over(upto), F.lit(0)))
    for n in range(1, 7):
        own = Window.partitionBy(key, f"_from{n}").orderBy("heading_no").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_n{n}", F.count_if(F.col("level") == n).over(own))
    number = F.array_join(F.transform(F.slice(F.array(*[F.col(f"_n{n}") for n in range(1, 7)]), F.lit(1), F.col("level")), lambda x: x.cast("string")), ".")
    above = reduce(lambda c, n: c.when(F.col("level") == n, F.col(f"_up{n}")), range(2, 7), F.when(F.col("level") == 1, F.lit(None).cast("int")))
    for n in range(2, 7):
        rows = rows.withColumn(f"_up{n}", F.max(F.when(F.col("level") < n, F.col("heading_no"))).over(before))
    return rows.select(key, "heading_no", "level", "title", number.alias("number"), above.cast("int").alias("parent"))
