"""Frequency of every distinct term, and marks for the rare and the common (problem 1).

Entries are normalised and cut down to one row for each term and file. The distinct terms get dense
integer ids in range-partitioned order (the global dictionary); entries are encoded to ids where they
are, by a lookup that is sent if it is small and salted if not. Each task sorts its encoded rows by id
and accumulates one block after the other, a block being a range of identifiers: count arrays for
occurrences and for files, held sparsely. The arrays of a range are then summed. A term or a file that
holds a third of all rows is combined map-side before every shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.session import latest, lookup_join, stored

#: Fewer occurrences than this are rare; a larger share of the files than this is common.
RARE, COMMON = 3, 0.20
#: Identifiers in a range.
RANGE = 4096

#: Characters written for an apostrophe and for a hyphen. Fixed values.
APOSTROPHES = "'’‘‛ʼʹ′＇`´"
HYPHENS = "-‐‑‒–—―−﹣－⁃"
_forms = str.maketrans(dict.fromkeys(APOSTROPHES, "'") | dict.fromkeys(HYPHENS, "-"))
#: Format characters that aren't of category Cf. Fixed values.
_unseen = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")
_blank = re.compile(r"\s+")


def normal_term(source: str | None) -> str | None:
    """The NFC, lower-case form with single spaces, ``'`` and ``-``; None for null and blank."""
    if source is None:
        return None
    text = source
    if not text.isascii():
        text = "".join(c for c in _unseen.sub("", text) if unicodedata.category(c) != "Cf").translate(_forms)
    elif "`" in text:
        text = text.translate(_forms)
    text = _blank.sub(" ", text).strip()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()) or None


@F.pandas_udf(StringType())
def term_form(source: pd.Series) -> pd.Series:
    """``normal_term`` of a column."""
    return source.map(normal_term, na_action="ignore").where(source.notna(), None)


def dictionary(terms: DataFrame) -> DataFrame:
    """``term`` and ``term_id`` (long, dense from 0, in the order of terms) of a table of distinct terms.

    Terms are range-partitioned and sorted; only the sizes of the partitions are gathered, to make
    offsets. The sorted table is checkpointed first, so a lost executor can't change the ids.
    """
    numbered = stored(terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id()))
    # The number holds the partition in its upper bits and the place in it in the lower 33.
    placed = numbered.select("term", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row a partition, so this window is over a few rows.
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(offsets.select("part", "offset")), "part").select("term", (F.col("offset") + F.col("place")).alias("term_id"))


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of a task's (term_id, n, files), which come sorted by id, as rows of (range, offsets, n, files)."""
    lot, sums = None, None

    def out() -> pd.DataFrame:
        at = np.flatnonzero(sums[2])
        return pd.DataFrame({"lot": [lot], "offsets": [at.astype(np.int32)], "n": [sums[0][at]], "files": [sums[1][at]]})

    for rows in batches:
        ids = rows["term_id"].to_numpy()
        lots, starts = np.unique(ids // RANGE, return_index=True)
        for mine, a, b in zip(lots.tolist(), starts, [*starts[1:], len(ids)]):
            if mine != lot:
                if lot is not None:
                    yield out()
                lot, sums = mine, np.zeros((3, RANGE), np.int64)
            at = ids[a:b] - mine * RANGE
            np.add.at(sums[0], at, rows["n"].to_numpy()[a:b])
            np.add.at(sums[1], at, rows["files"].to_numpy()[a:b])
            sums[2][at] = 1
    if lot is not None:
        yield out()


def _sum_range(arrays: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dense sums of the arrays of the ranges in a partition, which come sorted by range."""
    lot, total, seen = None, None, None

    def out() -> pd.DataFrame:
        at = np.flatnonzero(seen)
        return pd.DataFrame({"term_id": lot * RANGE + at, "occurrences": total[0][at], "files": total[1][at]})

    for block in arrays:
        for row in block.itertuples(index=False):
            if row.lot != lot:
                if lot is not None:
                    yield out()
                lot, total, seen = row.lot, np.zeros((2, RANGE), np.int64), np.zeros(RANGE, bool)
            at = np.asarray(row.offsets)
            seen[at] = True
            total[0][at] += np.asarray(row.n)
            total[1][at] += np.asarray(row.files)
    if lot is not None:
        yield out()


def term_frequencies(entries: DataFrame, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """``term``, ``occurrences``, ``files``, ``is_rare``, ``is_common`` of every distinct term.

    Input: entry_id, job_id, source, count, loaded_at. Rows of one entry_id are one record, the one
    loaded last; a row without entry_id is no record. A null count is 0, a null or blank source no
    term; an entry without job_id counts its occurrences but no file. All files of the table are
    the base of the common share, also those that list no term.
    """
    rows = latest(entries.select("entry_id", "job_id", "source", "count", "loaded_at"), "entry_id", [F.col("loaded_at")])
    formed = rows.select(term_form("source").alias("term"), "job_id", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
    listed = stored(formed.groupBy("term", "job_id").agg(F.sum("n").alias("n")))
    n_files = listed.where("job_id is not null").select("job_id").distinct().count()
    ids = dictionary(listed.where("term is not null").select("term").distinct())
    terms = listed.where("term is not null").select("term", "n", F.col("job_id").isNotNull().cast("long").alias("files"))
    encoded = lookup_join(terms, ids, "term", "inner").select("term_id", "n", "files").sortWithinPartitions("term_id")
    arrays = encoded.mapInPandas(_accumulate, "lot long, offsets array<int>, n array<long>, files array<long>")
    sums = arrays.repartition("lot").sortWithinPartitions("lot").mapInPandas(_sum_range, "term_id long, occurrences long, files long")
    return ids.join(sums, "term_id").select(
        "term", "occurrences", "files",
        (F.col("occurrences") < rare).alias("is_rare"),
        (F.col("files") > common * n_files).alias("is_common"),
    )


def useless_terms(frequencies: DataFrame) -> DataFrame:
    """``term`` and ``mark`` (rare, common); a term with both marks has two rows."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return frequencies.select("term", F.explode(marks).alias("mark"))
