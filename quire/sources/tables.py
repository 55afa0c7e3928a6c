"""Sources and sinks: state tables with schemas, validated JSON files, PDF files, Markdown and JSON output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T

#: Version of the state tables this reads in full; older ones lack columns. Fixed value.
VERSION = 4
#: Columns that came with a version, with what they were before. Fixed values.
ADDED = {2: {"overlay_status": "NONE"}, 3: {"provider_switch_allowed": "false"}, 4: {"run_mode": "reflow"}}

GLOSSARY = "schema_version int, source_lang string, target_lang string, entries array<struct<source:string,target:string,count:long,status:string,origin:string,note:string>>, _corrupt string"
FIGURES = (
    "schema_version int, figures array<struct<image_id:long,page:int,index_on_page:int,kind:string,file:string,dpi:int,width:int,height:int,"
    "labels:array<string>,label_boxes:array<array<double>>>>, _corrupt string"
)
PROFILE = "schema_version int, page_width double, page_height double, margins array<double>, body_size double, family string, _corrupt string"


def read_state(spark: SparkSession, path: str, schema: str | StructType | None = None, version: int = VERSION) -> DataFrame:
    """A state table; columns that an older version lacks come with their former values."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path)
    for since, columns in ADDED.items():
        if version < since:
            for name, value in columns.items():
                if name not in rows.columns:
                    rows = rows.withColumn(name, F.lit(value))
    return rows


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file, with its path; never inferred. What can't be read is in ``_corrupt``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("path", F.input_file_name())


def glossary_entries(files: DataFrame, default_status: str = "proposed") -> DataFrame:
    """path, source, target, count, status, origin, note of every entry."""
    e = files.select("path", F.explode("entries").alias("e"))
    return e.select(
        "path", "e.source", F.coalesce("e.target", F.lit("")).alias("target"), F.coalesce("e.count", F.lit(0)).alias("count"),
        F.coalesce("e.status", F.lit(default_status)).alias("status"), F.coalesce("e.origin", F.lit("user")).alias("origin"), F.coalesce("e.note", F.lit("")).alias("note"),
    )


def file_violations(files: DataFrame, known: int = 1) -> DataFrame:
    """path, rule of files that can't be read or are of another version."""
    rules = F.array_compact(F.array(
        F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable")),
        F.when(F.col("_corrupt").isNull() & ~F.col("schema_version").eqNullSafe(F.lit(known)), F.lit("version")),
    ))
    return files.select("path", F.explode(rules).alias("rule"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, valid, encrypted of the files under a path: the head must hold %PDF within 1024 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    whole = F.decode("content", "ISO-8859-1")
    return files.select(
        "path", F.col("length").alias("bytes"), (F.lower("path").endswith(".pdf") & F.contains(head, F.lit("%PDF"))).alias("valid"), F.contains(whole, F.lit("/Encrypt")).alias("encrypted")
    )


def page_ranges(text: Column) -> Column:
    """Sorted distinct pages of ``2,5-7``; null for what isn't ascending ranges of at most 100000 pages."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")), F.regexp_extract(p, r"^(\d+)", 1)).cast("int").alias("b")))
    right = F.regexp_replace(text, r"\s", "").rlike(r"^\d{1,9}(-\d{1,9})?(,\d{1,9}(-\d{1,9})?)*$")
    sound = F.forall(parts, lambda p: (p.a >= 1) & (p.a <= p.b) & (p.b - p.a < 100_000))
    pages = F.flatten(F.transform(parts, lambda p: F.sequence(p.a, F.greatest(p.a, p.b))))
    return F.when(right, F.when(sound, F.array_sort(F.array_distinct(pages))))


def page_margins(text: Column) -> Column:
    """array(top, right, bottom, left) in points of one, two or four values in mm or pt; else null."""
    parts = F.split(T.trimmed(text), r"[\s,]+")
    points = F.transform(parts, lambda p: F.regexp_extract(p, r"^(\d+(?:\.\d+)?)", 1).cast("double") * F.when(p.endswith("pt"), 1.0).otherwise(72 / 25.4))
    right = F.forall(parts, lambda p: p.rlike(r"^\d+(\.\d+)?(mm|pt)?$"))
    p = lambda i: F.get(points, i)
    return F.when(right & (F.size(parts) == 1), F.array(p(0), p(0), p(0), p(0))).when(right & (F.size(parts) == 2), F.array(p(0), p(1), p(0), p(1))).when(right & (F.size(parts) == 4), points)


def write_markdown(groups: DataFrame, path: str, scope: str, text: str = "text") -> None:
    """One folder a scope of text files, image and legend lines as readers want them. The commit is atomic by task."""
    shown = F.regexp_replace(F.regexp_replace(text, r'(?m)^<!--\s*image:(\d+)\s+src="([^"]+)"\s*-->[ \t]*$', "![Figure $1]($2)"), r"(?m)^<!--\s*(?:image|legend):\d+[^>]*-->[ \t]*\n?", "")
    groups.select(scope, shown.alias("value")).write.mode("overwrite").partitionBy(scope).text(path)


def write_json(rows: DataFrame, path: str, scope: str) -> None:
    """Review entries as JSON lines, one folder a scope."""
    rows.write.mode("overwrite").partitionBy(scope).json(path)


def replace_all(rows: DataFrame, path: str, violations: DataFrame, existing: DataFrame | None = None) -> None:
    """Write a state table anew; refused if the rows break a rule or completed work would be lost."""
    broken = violations.limit(5).collect()
    if broken:
        raise ValueError(f"rows break rules: {broken}")
    if existing is not None and existing.where("status = 'COMPLETED'").limit(1).count():
        raise ValueError("completed units would be lost")
    rows.write.mode("overwrite").parquet(path)


Provider = Callable[[list[str]], list[str]]


def upper_provider(texts: list[str]) -> list[str]:
    """A provider for tests: the same texts in capitals."""
    return [t.upper() for t in texts]


def greedy_batches(sizes: list[int], most_texts: int, most_chars: int) -> list[tuple[int, int]]:
    """(start, stop) of batches in order, each within both limits; a larger text is a batch of its own."""
    out, start, chars = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most_texts or chars + n > most_chars):
            out.append((start, i))
            start, chars = i, 0
        chars += n
    return [*out, (start, len(sizes))] if sizes else []


def translate(rows: DataFrame, key: str, text: str, provider: Provider = upper_provider, most_texts: int = 50, most_chars: int = 5000) -> DataFrame:
    """key, translated_text by a provider called with batches of texts; null stays null.

    A provider gives as many texts as it gets, in order; else the task fails.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given = pdf[pdf["t"].notna()]
            texts: list[str] = given["t"].tolist()
            out: list[str] = []
            for a, b in greedy_batches([len(x) for x in texts], most_texts, most_chars):
                got = provider(texts[a:b])
                if len(got) != b - a:
                    raise ValueError(f"{b - a} texts sent, {len(got)} came back")
                out += got
            pdf = pdf.assign(translated_text=pd.Series(out, index=given.index, dtype=object))
            yield pdf[["k", "translated_text"]].rename(columns={"k": key})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, translated_text string")


def registered(registry: dict[str, Callable], name: str, what: str = "provider") -> Callable:
    """The entry of a registry by name without regard to case; an unknown name raises with those there are."""
    found = {k.lower(): v for k, v in registry.items()}.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown {what} {name!r}; there are {', '.join(sorted(registry))}")
    return found


PROVIDERS: dict[str, Provider] = {"upper": upper_provider, "same": list}


def log_lines(events: DataFrame, secrets: list[str], level: str = "level", message: str = "message") -> DataFrame:
    """``value``: one JSON object a row of a log, nulls left out, the given secrets and keys in messages masked."""
    rest = [c for c in events.columns if c not in (level, message)]
    return events.select(F.to_json(F.struct(F.col(level).alias("level"), T.redacted(F.col(message), secrets).alias("message"), *rest)).alias("value"))


def save_glossary(entries: DataFrame, path: str, scope: str) -> None:
    """One JSON document a scope: schema_version, and entries by source."""
    fields = ("source", "target", "count", "status", "origin", "note")
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias("entries")
    files = entries.groupBy(scope).agg(listed).select(scope, F.to_json(F.struct(F.lit(1).alias("schema_version"), "entries"), {"ignoreNullFields": "false"}).alias("value"))
    files.write.mode("overwrite").partitionBy(scope).text(path)


def save_figures(figures: DataFrame, path: str, scope: str) -> None:
    """One JSON document a scope: schema_version, and figures by image_id."""
    rest = [c for c in figures.columns if c not in (scope, "image_id")]
    listed = F.array_sort(F.collect_list(F.struct("image_id", *rest))).alias("figures")
    files = figures.groupBy(scope).agg(listed).select(scope, F.to_json(F.struct(F.lit(1).alias("schema_version"), "figures")).alias("value"))
    files.write.mode("overwrite").partitionBy(scope).text(path)


def archive(spark: SparkSession, path: str, folder: str, stamp: str) -> str:
    """Copy a state table to ``folder``/``stamp``; refused where that is there already."""
    target = f"{folder}/{stamp}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(target)
    return target


def figure_violations(figures: DataFrame) -> DataFrame:
    """path, image_id, rule of figure entries that break one: kind, sizes, as many boxes as labels, boxes of four values."""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("kind").isin("vector", "raster"), F.lit(False)), F.lit("kind")),
        F.when((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0), F.lit("size")),
        F.when(F.coalesce(F.size("labels"), F.lit(0)) != F.coalesce(F.size("label_boxes"), F.lit(0)), F.lit("labels")),
        F.when(F.exists(F.coalesce("label_boxes", F.array().cast("array<array<double>>")), lambda b: F.size(b) != 4), F.lit("boxes")),
    ))
    return figures.select("path", "image_id", F.explode(rules).alias("rule"))
