"""Splitting oversized items at natural boundaries (problem 4).

A text is cut into atoms: sentences, and where a sentence is too large its clauses, words and, for an
unbroken run beyond the limit, slices of it. Neighbouring atoms are merged agglomeratively: adjacent
pairs lie in a heap by the strength of the boundary between them, the weakest is merged first while
both together, with the overlap, fit the limit. A piece that stays below the minimum is merged with a
neighbour beyond the limit, and both are cut again at the strongest boundary, down to words, that
leaves neither short. Where two pieces can't give that although the sizes would allow it, the cuts
around it are placed anew over the words by dynamic programming.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import lookup_join

#: Strength of a boundary: blank line, line, sentence, clause, word, inside a run.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, FORCED = 6, 5, 4, 3, 2, 0
#: Pieces on either side of a short one whose cuts are placed anew together.
REACH = 3
_sentence = re.compile(r"(?:\n|[.!?…]+[\"'”’»)\]]*\s)\s*")
_clause = re.compile(r"[,;:]\s+")
_word = re.compile(r"\s+")
_finer = {SENTENCE: CLAUSE, CLAUSE: WORD, WORD: FORCED}


def boundaries(text: str, level: int = WORD, start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """(position, strength) of the boundaries of one level inside a part of ``text``; white space stays left.

    The level of sentences also finds lines and paragraphs.
    """
    stop = len(text) if stop is None else stop
    found = {SENTENCE: _sentence, CLAUSE: _clause, WORD: _word}[level].finditer(text, start, stop)
    if level < SENTENCE:
        return [(m.end(), level) for m in found if start < m.end() < stop]
    out = []
    for m in found:
        if start < m.end() < stop:
            lines = m.group().count("\n")
            out.append((m.end(), PARAGRAPH if lines > 1 else LINE if lines else SENTENCE))
    return out


def _atoms(text: str, limit: int, room: int, begin: int = 0, end: int | None = None) -> tuple[list[int], list[int]]:
    """Ends of the atoms of a part of ``text`` and the strength of the boundary after each.

    A part larger than ``room`` is cut at the next weaker boundaries; a word is kept whole up to the
    limit itself (it can do without overlap) and sliced beyond.
    """
    ends: list[int] = []
    power: list[int] = []

    def part(a: int, b: int, after: int, level: int) -> None:
        if b - a <= room or level == FORCED:
            if b - a > limit:
                inside = range(a + limit, b, limit)  # no word begins in a run, so these have no overlap
                ends.extend(inside)
                power.extend([FORCED] * len(inside))
            ends.append(b)
            power.append(after)
            return
        start = a
        for at, force in boundaries(text, level, a, b):
            part(start, at, force, _finer[level])
            start = at
        part(start, b, after, _finer[level])

    start, end = begin, len(text) if end is None else end
    for at, force in boundaries(text, SENTENCE, begin, end):
        part(start, at, force, CLAUSE)
        start = at
    part(start, end, PARAGRAPH, CLAUSE)
    return ends, power


def _merged(ends: list[int], power: list[int], limit: int, room: int) -> list[int]:
    """Ends after merging neighbours over the weakest boundaries first, as far as they fit."""
    n = len(ends)
    low, high, power = [0, *ends[:-1]], ends[:], power[:]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(power[i], high[i + 1] - low[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and high[j] - low[i] == size) or size > (limit if low[i] == 0 else room):
            continue
        alive[j] = False
        high[i], right[i], power[i] = high[j], right[j], power[j]
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (power[i], high[right[i]] - low[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (power[left[i]], high[i] - low[left[i]], left[i], i))
    return [high[i] for i in range(n) if alive[i]]


class _Words:
    """Where the words of a text begin, and all its boundaries with their strength, found once and only if asked for."""

    def __init__(self, text: str, limit: int) -> None:
        self.text, self.limit = text, limit

    @cached_property
    def begins(self) -> list[int]:
        return [0, *(m.end() for m in _word.finditer(self.text))]

    @cached_property
    def cuts(self) -> tuple[list[int], list[int]]:
        return _atoms(self.text, self.limit, 1)

    def overlap(self, core: int, overlap: int, first: int) -> int:
        """The word beginning nearest to ``overlap`` characters before ``core``, not before ``first``; ``core`` if there is none."""
        wanted = core - overlap
        if wanted <= first and (first == 0 or self.text[first - 1].isspace()):
            return first
        k = bisect_left(self.begins, max(wanted, first))
        near = [m for m in self.begins[max(0, k - 1) : k + 1] if first <= m < core]
        return min(near, key=lambda m: (abs(m - wanted), m), default=core)


def _placed(words: _Words, begin: int, end: int, least: int, overlap: int, ends: list[int], force: list[int]) -> list[int]:
    """Cuts of a part of the text over some of its boundaries, the last being ``end``.

    The fewest pieces below ``least``, then the fewest, the strongest, the most even ones. Costs are one
    integer: 12 bits of short pieces, 12 of pieces, 13 of weakness, 25 of unevenness.
    """
    limit = words.limit
    at = np.array([begin, *ends], np.int64)
    starts = np.array([words.overlap(x, overlap, 0) if overlap and 0 < x < len(words.text) else x for x in at.tolist()], np.int64)
    weak = (np.int64(1) << 38) + ((PARAGRAPH - np.array(force, np.int64)) << 25)
    low = np.searchsorted(at, at - limit)
    best, back = np.full(len(at), _NEVER), np.zeros(len(at), np.int64)
    best[0] = 0
    for j in range(1, len(at)):
        i = min(low[j], j - 1)
        size = at[j] - starts[i:j]
        cost = best[i:j] + ((size < least).astype(np.int64) << 50) + weak[j - 1] + (size * 64 // limit) ** 2
        # A word larger than what is left beside an overlap goes without one.
        cost[:-1][size[:-1] > limit] = _NEVER
        back[j] = i + int(cost.argmin())
        best[j] = min(cost[back[j] - i], _NEVER)
    out, j = [], len(at) - 1
    while j > 0:
        out.append(int(at[j]))
        j = back[j]
    return out[::-1]


_NEVER = np.int64(1) << 61


def _recut(words: _Words, a: int, b: int, least: int, overlap: int, late: bool = False) -> int | None:
    """Where to cut a..b in two pieces of which neither is short nor too long.

    The strongest boundary, then the one nearest the middle, then the first or, if ``late``, the last.
    """
    limit = words.limit
    first = words.overlap(a, overlap, 0) if a and overlap else a
    low, high = max(a + 1, first + least, b - limit), min(b - 1, first + limit, b - max(0, least - 2 * overlap))
    ends, force = words.cuts
    x, y = bisect_left(ends, low), bisect_right(ends, high)
    near = [(-f, abs(2 * at - a - b), -at if late else at, at) for at, f in zip(ends[x:y], force[x:y]) if f != FORCED]
    for *_, at in sorted(near):
        start = words.overlap(at, overlap, max(a, b - limit)) if overlap else at
        if b - start >= least:
            return at
    return None


def _can_be(size: int, limit: int, least: int, overlap: int) -> bool:
    """Whether pieces between ``least`` and ``limit`` can make up ``size`` characters, as far as sizes tell."""
    few = -(-(size - overlap) // max(1, limit - overlap))
    return few * least <= size + (few - 1) * overlap


def _starts(words: _Words, cuts: list[int], low: int, high: int, overlap: int) -> list[int]:
    """Where the pieces low..high-1 begin, with their overlap."""
    out = []
    before = 0
    for k in range(max(0, low - 1), high):
        core = cuts[k - 1] if k else 0
        before = words.overlap(core, overlap, max(before, cuts[k] - words.limit)) if core and overlap else core
        if k >= low:
            out.append(before)
    return out


def _repaired(words: _Words, cuts: list[int], ends: list[int], power: list[int], least: int, overlap: int) -> list[int]:
    """The cuts after short pieces were merged with a neighbour and both cut again, as far as that helps.

    ``ends`` and ``power``: the atoms that were merged, over which cuts are placed anew before words are used.
    """

    def short(cuts: list[int], low: int, high: int) -> int:
        return sum(stop - start < least for start, stop in zip(_starts(words, cuts, low, high, overlap), cuts[low:high]))

    def ways(k: int) -> Iterator[tuple[int, int, list[int]]]:
        """First piece and end of a few pieces, and other cuts for them."""
        for first in (k - 1, k):
            if first < 0 or first + 1 >= len(cuts):
                continue
            # Of two cuts alike the short piece gets more; then the pieces beside are evened out.
            at = _recut(words, cuts[first - 1] if first else 0, cuts[first + 1], least, overlap, first == k)
            if at is None:
                continue
            low, high = max(0, first - 1), min(len(cuts), first + 3)
            new = [*cuts[low:first], at, *cuts[first + 1 : high]]
            begin = cuts[low - 1] if low else 0
            for beside in (first - 1 - low, first + 1 - low):
                if 0 <= beside < len(new) - 1:
                    even = _recut(words, new[beside - 1] if beside else begin, new[beside + 1], least, overlap)
                    new[beside] = new[beside] if even is None else even
            yield low, high, new
        low, high = max(0, k - REACH), min(len(cuts), k + REACH + 1)
        begin, end = cuts[low - 1] if low else 0, cuts[high - 1]
        # As sizes go, so few pieces must be short.
        fewest = 0 if _can_be(end - begin, words.limit, least, overlap) else 1
        for at, force in ((ends, power), words.cuts):
            if short(cuts, low, high) <= fewest:
                return
            x, y = bisect_right(at, begin), bisect_left(at, end)
            yield low, high, _placed(words, begin, end, least, overlap, [*at[x:y], end], [*force[x:y], PARAGRAPH])

    k = 0
    while k < len(cuts):
        if short(cuts, k, k + 1):
            for low, high, new in ways(k):
                # The piece after may begin elsewhere now.
                after = min(1, len(cuts) - high)
                other = [*cuts[:low], *new, *cuts[high:]]
                if short(other, low, low + len(new) + after) < short(cuts, low, high + after):
                    cuts, k = other, max(0, low - 1)
                    break
        k += 1
    return cuts


def split(text: str, limit: int, least: int = 0, overlap: int = 0) -> list[tuple[int, int, int]]:
    """Pieces as (start, core start, end): the text from start to core start repeats the piece before.

    No piece is longer than ``limit``; the cores tile the text. The overlap begins at the word
    nearest to the wanted length that fits; there is none where no word begins. One of the limit or
    more leaves room for one new character only.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    ends, power = _atoms(text, limit, limit - overlap)
    words = _Words(text, limit)
    cuts = _merged(ends, power, limit, limit - overlap)
    if least > 0:
        cuts = _repaired(words, cuts, ends, power, least, overlap)
    return list(zip(_starts(words, cuts, 0, len(cuts), overlap), [0, *cuts], cuts))


def has_long_run(text: str, limit: int) -> bool:
    """Whether an unbroken run without white space is longer than ``limit``."""
    return any(len(run) > limit for run in text.split())


_SCHEMA = "{id}, piece_no int, start int, core_start int, stop int, forced boolean, piece string"


def split_groups(groups: DataFrame, jobs: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every group whose joined source is longer than its job's ``chunk_max_chars``.

    Rows: group_id, piece_no, start, core_start, stop (code points in the joined source), forced (an
    unbroken run of the source is longer than the limit), piece. Null members of ``source`` are left
    out; a null, zero or negative limit splits nothing; a null minimum or overlap is 0. Repeated
    groups give repeated pieces. Settings are broadcast only as far as they are few (lookup_join).
    """
    caps = limits.groupBy("provider").agg(F.max(F.coalesce("overlap_chars", F.lit(0))).cast("int").alias("_over"))
    rules = jobs.where("chunk_max_chars > 0 and id is not null").select(
        F.col("id").alias("job_id"), "provider", F.col("chunk_max_chars").cast("int").alias("_max"),
        F.coalesce("chunk_min_chars", F.lit(0)).cast("int").alias("_min"), "updated_at",
    )
    rules = rules.groupBy("job_id").agg(F.max_by(F.struct("provider", "_max", "_min"), F.struct("updated_at", "_max")).alias("r"))
    rules = rules.select("job_id", "r.*").join(F.broadcast(caps) if caps.limit(10_001).count() <= 10_000 else caps, "provider", "left")
    rules = rules.select("job_id", "_max", "_min", F.coalesce("_over", F.lit(0)).alias("_over"))
    joined = groups.select("group_id", "job_id", F.concat_ws("", "source").alias("_text"))
    # Nothing shorter than the least limit can be split, so such texts don't reach the join.
    shortest = rules.agg(F.min("_max")).first()[0]
    if shortest is None:
        shortest = 2**31 - 1
    large = lookup_join(joined.where(F.length("_text") > shortest), rules, "job_id", "inner").where(F.length("_text") > F.col("_max"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, most, least, over in pdf.itertuples(index=False):
                forced = has_long_run(text, most)
                for no, (start, core, stop) in enumerate(split(text, most, least, over)):
                    rows.append((key, no, start, core, stop, forced, text[start:stop] if with_text else None))
            yield pd.DataFrame(rows, columns=["group_id", "piece_no", "start", "core_start", "stop", "forced", "piece"])

    kind = groups.schema["group_id"].dataType.simpleString()
    return large.select("group_id", "_text", "_max", "_min", "_over").mapInPandas(run, _SCHEMA.format(id=f"group_id {kind}"))


def split_kinds(pieces: DataFrame) -> DataFrame:
    """``group_id`` and ``cut`` (forced, natural), one row a group, from its pieces."""
    return pieces.groupBy("group_id").agg(F.when(F.bool_or("forced"), "forced").otherwise("natural").alias("cut"))
