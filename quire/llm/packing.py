"""Filling fixed-capacity containers with items by bin completion (problem 6).

Every provider's texts are spread over shards of a bounded number of items by a hash of the key, so
that no task grows with the data however unevenly providers are used; one shard wastes at most part
of its last container. Inside a shard the largest open item is completed by the undominated fillings
of the room it leaves, fullest first, as a depth-first branch and bound: a branch ends when its waste
exceeds what the best solution so far allows. The first incumbent is best-fit decreasing; where that
meets the lower bound it is optimal and nothing is searched.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZERS, count_tokens
from quire.session import lookup_join, stored

#: Items a shard holds on average.
SHARD_ITEMS = 5000
#: Fillings looked at in the search of one shard for each container of the first incumbent, and kept for one
#: container (of four times as many that are found, in forty times as many steps). None searches all of them.
SEARCH_NODES, FILLINGS = 20, 8


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that are needed at least: by volume, and by items that can't share one (L2)."""
    ordered = sorted(sizes)
    sums = list(accumulate(ordered, initial=0))
    best = -(-sums[-1] // capacity)
    half = bisect_right(ordered, capacity // 2)
    for limit in sorted({s for s in ordered[:half]} | {0}):
        low = bisect_left(ordered, limit)
        big = bisect_right(ordered, capacity - limit)  # from here on, no item of ``limit`` fits beside it
        room = (big - half) * capacity - (sums[big] - sums[half])
        rest = sums[half] - sums[low] - room
        best = max(best, len(ordered) - half + max(0, -(-rest // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by container. Ties keep the order of the items."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open containers by room left
    rooms = 0  # bit r is set where free[r] isn't empty
    out: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, box = capacity, len(out)
            out.append([])
        out[box].append(item)
        free[room - size].append(box)
        rooms |= 1 << (room - size)
    return out


def _fillings(room: int, count: dict[int, int], limit: int | None) -> list[tuple[int, ...]]:
    """Undominated multisets of sizes that fit into ``room``, fullest first.

    A filling is dominated if some unused size could take the place of a part of it that isn't
    larger without the room running out; then the smaller parts are better kept for later.
    """
    values = sorted(count, reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def grow(at: int, left: int, taken: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        if limit is not None and steps > 40 * limit:
            return
        fits = False
        for k in range(at, len(values)):
            v = values[k]
            if v <= left and taken.count(v) < count[v]:
                fits = True
                grow(k, left - v, (*taken, v))
                if limit is not None and len(found) >= 4 * limit or (found and found[-1][0] == 0):
                    return
        if not fits and not any(v <= left and taken.count(v) < count[v] for v in values):
            found.append((left, taken))

    grow(0, room, ())

    def dominated(left: int, taken: tuple[int, ...]) -> bool:
        sums = set(taken) | {a + b for i, a in enumerate(taken) for b in taken[i + 1 :]}
        unused = [v for v in values if taken.count(v) < count[v]]
        return any(s <= v <= s + left and v not in taken for s in sums for v in unused)

    kept = [(left, taken) for left, taken in sorted(set(found)) if left == 0 or not dominated(left, taken)]
    return [taken for _, taken in (kept or sorted(found))[:limit]]


def pack(sizes: list[int], capacity: int, nodes: int | None = SEARCH_NODES, fillings: int | None = FILLINGS) -> list[list[int]]:
    """Containers as lists of item numbers; every size must be between 1 and ``capacity``.

    ``nodes`` and ``fillings`` bound the search; with None for both it ends only with the fewest containers.
    """
    best = best_fit(sizes, capacity)
    if not sizes or len(best) == -(-sum(sizes) // capacity):
        return best
    least = lower_bound(sizes, capacity)
    if len(best) <= least:
        return best
    total = sum(sizes)
    count: dict[int, int] = {}
    for s in sizes:
        count[s] = count.get(s, 0) + 1
    goal = len(best)
    left = float("inf") if nodes is None else nodes * goal
    answer: list[tuple[int, ...]] | None = None
    # A stack instead of recursion, as a shard has thousands of containers: for each open container
    # the fillings still to be tried, and the one that is taken now.
    stack: list[list] = []
    waste = 0

    def opened() -> list:
        top = max(count)
        _take(count, (top,), -1)
        fills = [(top, *f) for f in _fillings(capacity - top, count, fillings)]
        _take(count, (top,), 1)
        return [iter(fills), None]

    stack.append(opened())
    while stack and left > 0:
        left -= 1
        frame = stack[-1]
        if frame[1] is not None:
            _take(count, frame[1], 1)
            waste -= capacity - sum(frame[1])
        frame[1] = next(frame[0], None)
        if frame[1] is None:
            stack.pop()
            continue
        _take(count, frame[1], -1)
        waste += capacity - sum(frame[1])
        if not count:
            goal, answer = len(stack), [f[1] for f in stack]
            if goal <= least:
                break
        elif waste <= (goal - 1) * capacity - total and len(stack) < goal - 1:
            stack.append(opened())
    if answer is None:
        return best
    by_size: dict[int, list[int]] = {}
    for item in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[item], []).append(item)
    return [[by_size[s].pop() for s in fill] for fill in answer]


def _take(count: dict[int, int], sizes: tuple[int, ...], sign: int) -> None:
    for s in sizes:
        count[s] = count.get(s, 0) + sign
        if not count[s]:
            del count[s]


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """An item as token ranges: itself, or full containers and a rest if it is larger than one."""
    return [(a, min(a + capacity, size)) for a in range(0, size, capacity)]


def pack_sized(items: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign ``items`` (provider, doc_id, n_tokens) to containers of ``limits`` (provider, capacity_tokens).

    Rows: provider, container, doc_id, piece, token_from, token_to. Items without tokens, of a null
    provider, or of one without a positive capacity aren't placed. Repeated rows are items of their own.
    """
    items = items.where("n_tokens > 0 and provider is not null")
    caps = limits.where("capacity_tokens > 0").groupBy("provider").agg(F.max("capacity_tokens").cast("int").alias("_cap"))
    counts = items.groupBy("provider").agg(F.count("*").alias("_n"))
    lots = counts.join(caps, "provider").select("provider", "_cap", F.ceil(F.col("_n") / shard_items).cast("int").alias("_shards"))
    return _fill(lookup_join(items, lots, "provider", "inner"))


def _fill(placed: DataFrame) -> DataFrame:
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.col("_shards")).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        capacity = int(pdf["_cap"].iloc[0])
        parts = [(d, k, a, b) for d, n in zip(pdf["doc_id"], pdf["n_tokens"]) for k, (a, b) in enumerate(pieces(int(n), capacity))]
        boxes = pack([b - a for _, _, a, b in parts], capacity)
        rows = [(key[0], f"{key[0]}-{key[1]}-{box}", *parts[i]) for box, items in enumerate(boxes) for i in items]
        return pd.DataFrame(rows, columns=["provider", "container", "doc_id", "piece", "token_from", "token_to"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.select("provider", "_shard", "_cap", "doc_id", "n_tokens").groupBy("provider", "_shard").applyInPandas(
        run, f"provider string, container string, doc_id {kind}, piece int, token_from int, token_to int"
    )


def pack_corpus(
    documents: DataFrame,
    limits: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Every document with a text in containers of its provider's ``capacity_tokens``.

    The texts are read once: what is counted, sharded and packed are their sizes, stored in the shared
    folder. See ``pack_sized`` for nulls and repeated rows; null and empty texts aren't placed.
    """
    texts = documents.where("text is not null and text <> '' and provider is not null")
    sized = count_tokens(texts, ["provider", "doc_id"], "text", tokenizer, folder)
    return pack_sized(stored(sized), limits, shard_items)
