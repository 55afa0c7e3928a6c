"""The registered queries of the subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import align, packing, pairs, pieces, repetition, terms, tokens
from quire.llm.sql import SQL
from quire.session import spread, table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, files and marks of every distinct term."""
    return terms.term_frequencies(table(spark, folder, "glossary_entries"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be of use."""
    return terms.useless_terms(p1_terms(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose rendering can't be used, with the defect."""
    return pairs.broken_pairs(table(spark, folder, "overlay_review"), table(spark, folder, "lexicon"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of either side of a group that render each other."""
    groups = spread(table(spark, folder, "chunk_groups"))
    return align.align_groups(groups, align.train(align.texts_of(groups), table(spark, folder, "lexicon")))


def _pieces(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    return pieces.split_groups(
        table(spark, folder, "chunk_groups"), table(spark, folder, "jobs"), table(spark, folder, "provider_limits"), with_text
    )


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every group that is too long for its job."""
    return _pieces(spark, folder, True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The groups that had to be cut, and whether a cut was forced."""
    return pieces.split_kinds(_pieces(spark, folder, False))


def p4_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Of every group that was cut: length and hash of its pieces put together without their overlaps, and whether all keep the limit."""
    cut = p4_pieces(spark, folder).withColumn("core", F.substr("piece", F.col("core_start") - F.col("start") + 1))
    listed = F.array_sort(F.collect_list(F.struct("piece_no", "core")))
    whole = cut.groupBy("group_id").agg(F.array_join(F.transform(listed, lambda x: x["core"]), "").alias("t"), F.max(F.length("piece")).alias("longest"))
    limits = table(spark, folder, "jobs").groupBy(F.col("id").alias("job_id")).agg(F.max("chunk_max_chars").alias("most"))
    groups = table(spark, folder, "chunk_groups").select("group_id", "job_id")
    return whole.join(groups, "group_id").join(limits, "job_id").select("group_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("hash"), (F.col("longest") <= F.col("most")).alias("fits"))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a text in containers of its provider's capacity."""
    return packing.pack_corpus(spread(table(spark, folder, "documents").select("doc_id", "provider", "text")), table(spark, folder, "provider_limits"))


def p6_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document in containers: whether each of its tokens is in one once, and all of these keep their capacity."""
    boxes = p6_containers(spark, folder)
    size = F.col("token_to") - F.col("token_from")
    loads = boxes.groupBy("provider", "container").agg(F.sum(size).alias("load")).join(table(spark, folder, "provider_limits").select("provider", "capacity_tokens"), "provider")
    fits = loads.select("provider", "container", (F.col("load") <= F.col("capacity_tokens")).alias("fit"))
    docs = boxes.join(fits, ["provider", "container"]).groupBy("doc_id").agg(F.min("token_from").alias("a"), F.max("token_to").alias("b"), F.sum(size).alias("n"), F.countDistinct("token_from").alias("k"), F.count("*").alias("m"), F.bool_and("fit").alias("fits"))
    return docs.select("doc_id", ((F.col("a") == 0) & (F.col("n") == F.col("b")) & (F.col("k") == F.col("m"))).alias("whole"), "fits")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated words of every document."""
    return repetition.repeated_share(spread(table(spark, folder, "documents").select("doc_id", "text"))).drop("probability")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which at least 30 % repeats what they said before."""
    documents = table(spark, folder, "documents")
    return repetition.repeated_share(spread(documents.select("doc_id", "text")), model=repetition.train(documents), found=True).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_terms, p1_found, p2_found, p3_found, p4_pieces, p4_found, p4_tiling, p5_ids, p6_containers, p6_placed, p7_shares, p7_found)
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
