"""Sentence alignment in bilingual documents (problem 3).

Shared numbers, names and cognates that stand once on either side are anchors; the longest chain of
anchors that runs forward on both sides (longest increasing subsequence) is kept. Between neighbouring
anchors a local dynamic program takes the strongest forward path over pairs of sentences, in which a
sentence may stand in several pairs (joined, divided) or in none (omitted). The pairs of chain and
program are confirmed by the words they explain, each word explaining one pair. What they leave out is
chained again, apart from them, until nothing is found: those are the moved sentences.

How strong a pair is comes from a table of translations. It is counted over all groups: the sentences
that the chain of anchors pairs, and those that stand alone between two of them or alone in a group,
give counts of words that occur together, combined in each task and summed by word; none is left out. The lexicon counts
as a few sightings of its renderings, so with little data it carries the table and with much it doesn't.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.sentences import sentences
from quire.session import cut, lookup_join

#: Sightings a rendering of the lexicon counts as, and what one of the corpus must have: sightings, share and lift.
SEEN, LEAST_COUNT, LEAST_SHARE, LEAST_LIFT = 3.0, 3, 0.12, 4.0
#: A word weighs 1 if one in e to the power of this sentences holds it (in smaller corpora one in all).
RARE_LOG = 10.0
#: What a pair must explain: words (by weight), and share of the lighter sentence; less where the program agrees. On the
#: chain of anchors, and alone in a gap between them, the share is enough.
FREE, AGREED = (0.8, 0.35), (0.6, 0.3)
#: A pair that explains this much needs a smaller share, as either sentence may hold more clauses.
PLENTY, PLENTY_SHARE = 1.0, 0.25
#: What a pair on the chain of anchors gains, and what it costs if a sentence stands in one more pair.
ON_CHAIN, AGAIN = 1.0, 0.25
#: Groups handled at once.
BLOCK = 1500
#: Translations up to which the table is sent to the tasks; beyond it, words are joined with it.
TABLE_ROWS = 500_000
#: Pairs of words a task holds before it hands them on, and those of one pair of sentences that are counted at once.
HELD_PAIRS, AT_ONCE = 4_000_000, 250_000
#: Rows that share their part of a table too large to be sent.
SHARED_ROWS = 20_000

_note = re.compile(r"^\s*\[\^[^\]\s]*\]:")
_token = re.compile(r"[^\W\d_]+|\d[\d.,]*|\n")
_whole = re.compile(r"[^\W_]+(?:[.,]\d+)*")
_unseen = re.compile("[­​-‏⁠﻿]")


#: Kinds of code points: separators, letters, digits, dots and commas, line feeds. Found out as they come.
_OTHER, _LETTER, _DIGIT, _POINT, _LINE = range(5)
_kinds = np.full(0x110000, 255, np.uint8)


def _kind(point: int) -> int:
    c = chr(point)
    if c in ".,\n":
        return _LINE if c == "\n" else _POINT
    return _DIGIT if c.isdecimal() else _LETTER if c.isalnum() else _OTHER


def _split(text: str) -> list[str]:
    """``_token.findall`` for long texts: what belongs to no token becomes blanks, at which the text is split."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds[points]
    if (kinds == 255).any():
        for p in np.unique(points[kinds == 255]).tolist():
            _kinds[p] = _kind(p)
        kinds = _kinds[points]
    # Dots and commas right after a digit, or after others of that kind there, belong to its number.
    at = np.flatnonzero(kinds == _POINT)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        before = np.where(at[first] > 0, kinds[at[first] - 1], _OTHER)
        kinds[at] = np.repeat(np.where(before == _DIGIT, _DIGIT, _OTHER), np.diff(np.append(first, len(at))))
    points = np.where(kinds == _OTHER, np.uint32(32), points)
    # Tokens of different kinds that touch, and line feeds, which are tokens one by one.
    touch = np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[1:] != _OTHER) & (kinds[:-1] != _OTHER) | (kinds[1:] == _LINE) & (kinds[:-1] == _LINE)) + 1
    return [x for x in np.insert(points, touch, 32).tobytes().decode("utf-32-le", "surrogatepass").split(" ") if x]


def _plainly(text: str) -> str:
    # A dotless or a dotted i counts as i on both sides, so that names stay equal.
    return _unseen.sub("", text).replace("İ", "i").lower().replace("ı", "i")


def _folded(text: str) -> list[str]:
    return _token.findall(_plainly(text))


def _plain(token: str) -> str:
    return token.replace(".", "").replace(",", "") if token[0] in "0123456789" else token


def tokens(text: str) -> list[str]:
    """Folded words and numbers (digits only, so that separators don't matter); line feeds stay."""
    return [_plain(t) for t in _folded(text)]


@dataclass
class Table:
    """Translations of target words as (source word, confidence), and weights of source words.

    ``plain`` are the words that sources also write in lower case, so that they are no names.
    """

    entries: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    plain: set[str] = field(default_factory=set)

    @staticmethod
    def of_rows(rows: list) -> Table:
        """From rows (kind, a, b, c): translations t, weights w and plain words p."""
        out = Table()
        for kind, a, b, c in rows:
            if kind == "t":
                out.entries.setdefault(a, []).append((b, c))
            elif kind == "w":
                out.weight[a] = c
            else:
                out.plain.add(a)
        return out


@dataclass
class Block:
    """The sentences of many groups, and the words that pairs of them explain."""

    first_s: np.ndarray  # of each group: number of its first sentence, with an end
    first_t: np.ndarray
    left: np.ndarray  # of each candidate pair: its sentences and the slice of its words
    right: np.ndarray
    cut: np.ndarray
    score: np.ndarray
    anchor: np.ndarray  # of each candidate pair: the part of its score that anchors give
    word_s: np.ndarray  # of each explained word: its identity in the source and in the target sentence
    word_t: np.ndarray
    word_w: np.ndarray  # what explaining it is worth, and how often it stands in either sentence
    most_s: np.ndarray
    most_t: np.ndarray
    heavy_s: np.ndarray
    heavy_t: np.ndarray
    group: np.ndarray
    n_t: np.ndarray  # of each group: distinct words in the sentences of its target


def _side(groups: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Token ids, the token of each id, the sentence of each token, and the first sentence of each group."""
    first = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64)
    # The number of a footnote is no anchor.
    found = _split(_plainly("\n".join([_note.sub("", s) if "[^" in s else s for g in groups for s in g])))
    raw, kinds = pd.factorize(np.array(found, dtype=object))
    same, words = pd.factorize(np.array([_plain(t) for t in kinds], dtype=object))
    ids = same[raw] if len(raw) else np.zeros(0, np.int64)
    words = words.tolist()
    is_end = ids == (words.index("\n") if "\n" in words else -1)
    return ids[~is_end].astype(np.int64), words, np.cumsum(is_end)[~is_end], first


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands (sorting integers is faster than hashing them)."""
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.diff(np.append(start, len(keys)))


def _surest(left: np.ndarray, right: np.ndarray, word: np.ndarray, conf: np.ndarray, n_right: int, n_words: int) -> np.ndarray:
    """Sorted by (left, right, word): of each of them the number of the row of most confidence, the first of several."""
    if not len(left):
        return np.zeros(0, np.int64)
    if (int(left.max()) + 1) * n_right * n_words < 1 << 62:
        key = (left * n_right + right) * n_words + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((word, right, left))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([v[order[1:]] != v[order[:-1]] for v in (left, right, word)])
    first = np.flatnonzero(fresh)
    sure = conf[order]
    top = np.flatnonzero(sure == np.repeat(np.maximum.reduceat(sure, first), np.diff(np.append(first, len(sure)))))
    run = (np.cumsum(fresh) - 1)[top]
    return order[top[np.concatenate([[True], run[1:] != run[:-1]])]]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number of each key, equal ones alike, and how often it stands."""
    order = np.argsort(keys)
    fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, np.bincount(number)[number]


def _spans(cut: np.ndarray) -> np.ndarray:
    """All numbers of the slices in ``cut``, one slice after the other."""
    size = cut[:, 1] - cut[:, 0]
    return np.repeat(cut[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def match(source: list[list[str]], target: list[list[str]], table: Table, least: float = 0.3) -> Block:
    """Candidate pairs of every group, from words that render each other.

    A pair is one if it explains ``least``, or twice that share of its lighter sentence.
    """
    s_id, words, s_of, first_s = _side(source)
    t_id, t_words, t_of, first_t = _side(target)
    ids = {w: i for i, w in enumerate(words)}
    n_words = len(words) + 1
    top = max(table.weight.values(), default=1.0)
    known = np.array([table.weight.get(w, -1.0) for w in words] + [0.0])
    number = np.array([w[0].isdigit() for w in words] + [False])
    weight = np.where(known >= 0, known, top)
    group_s = np.repeat(np.arange(len(source)), np.diff(first_s))
    group_t = np.repeat(np.arange(len(target)), np.diff(first_t))
    # Target words as source words: themselves, and by the table.
    start, to, sure = [0], [], []
    for w in t_words:
        own = {ids[e]: c for e, c in table.entries.get(w, ()) if e in ids}
        if w in ids and (known[ids[w]] < 0 or len(w) > 3):
            own[ids[w]] = 1.0
        to += own.keys()
        sure += own.values()
        start.append(len(to))
    start, to, sure = np.array(start), np.array(to, np.int64), np.array(sure, float)
    # One row for each word of a sentence.
    n_t_words = len(t_words) + 1
    s_key, s_times = _counted(s_of * n_words + s_id)
    s_of, s_id = s_key // n_words, s_key % n_words
    t_key, t_times = _counted(t_of * n_t_words + t_id)
    t_of, t_id = t_key // n_t_words, t_key % n_t_words
    count = start[t_id + 1] - start[t_id] if len(t_id) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(t_id)), count)
    at = start[t_id[rows]] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    x_of, x_id, x_sure, x_word, x_times = t_of[rows], to[at], sure[at], t_id[rows], t_times[rows]
    # Join on group and word.
    key = group_s[s_of] * n_words + s_id
    order = np.argsort(key, kind="stable")
    key, j_of, j_times = key[order], s_of[order], s_times[order]
    wanted = group_t[x_of] * n_words + x_id
    ends_at = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
    starts_at = np.append(0, ends_at[:-1]) if len(key) else ends_at
    runs = np.searchsorted(key[starts_at], wanted)
    meets = runs < len(starts_at)
    meets[meets] = key[starts_at[runs[meets]]] == wanted[meets]
    a, n = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    a[meets], n[meets] = starts_at[runs[meets]], (ends_at - starts_at)[runs[meets]]
    x = np.repeat(np.arange(len(wanted)), n)
    y = np.repeat(a, n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    # The surest rendering of a source word in a pair counts.
    picked = _surest(j_of[y], x_of[x], x_id[x], x_sure[x], len(group_t) + 1, n_words)
    x, y = x[picked], y[picked]
    left, right, word, t_word, conf = j_of[y], x_of[x], x_id[x], x_word[x], x_sure[x]
    most_s, most_t = j_times[y], x_times[x]
    pair = left * (len(group_t) + 1) + right
    gain = conf * weight[word]
    edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    total = np.add.reduceat(gain, edge) if len(edge) else np.zeros(0)
    # Anchors: unknown words and numbers that stand in one sentence of either side of the group.
    rare = ((known[word] < 0) | number[word]) & (conf == 1.0)
    met = np.bincount(a[meets], minlength=len(key) + 1)  # how often a source word is wanted, at its first place
    same = rare & (n[x] == 1) & (met[a[x]] == 1)
    anchor = np.add.reduceat(np.where(same, gain, 0.0), edge) if len(edge) else np.zeros(0)
    # The weight of a sentence: its known words, and unknown ones that stand on both sides.
    word_of = key % n_words
    shared = np.repeat(met[starts_at] > 0, ends_at - starts_at) | (known[word_of] >= 0)
    heavy_s = np.bincount(j_of, np.where(shared, weight[word_of], 0), len(group_s))
    best = np.zeros(len(t_id))
    some = np.flatnonzero(count)
    if len(some):
        best[some] = np.maximum.reduceat(np.where(meets | (known[x_id] >= 0), x_sure * weight[x_id], 0), (np.cumsum(count) - count)[some])
    heavy_t = np.bincount(t_of, best, len(group_t))
    ends = np.concatenate([edge, [len(pair)]])
    left_p, right_p = left[edge], right[edge]
    keep = (total >= least) | (total >= 2 * least * np.minimum(heavy_s[left_p], heavy_t[right_p])) & (total > 0)
    return Block(
        first_s, first_t, left_p[keep], right_p[keep], np.stack([ends[:-1][keep], ends[1:][keep]], 1), total[keep], anchor[keep],
        left * n_words + word, right * n_t_words + t_word, gain, most_s, most_t, heavy_s, heavy_t, group_s[left_p[keep]] if len(edge) else edge,
        np.bincount(group_t[t_of], minlength=len(target)),
    )


def chain(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (source, target) that never runs backward (longest increasing subsequence)."""
    anchors = sorted(set(anchors))
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(anchors):
        p = bisect_right(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p] = j
            at[p] = k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(anchors[k])
        k = back[k]
    return out[::-1]


def path(pairs: list[tuple[int, int, float]]) -> list[int]:
    """Numbers of the pairs (source, target, strength), sorted, on the strongest forward path.

    Neither side runs backward; a sentence that stands in one more pair costs AGAIN. Exact: a pair is
    looked for among all before it, or, where there are many, in a tree of the best by target.
    """
    if len(pairs) < 2:
        return list(range(len(pairs)))
    best: list[float] = []
    back: list[int] = []
    if len(pairs) <= 400:
        for k, (i, j, v) in enumerate(pairs):
            top, b = 0.0, -1
            for m in range(k):
                a, c, _ = pairs[m]
                if c <= j and (w := best[m] - (AGAIN if a == i or c == j else 0.0)) > top:
                    top, b = w, m
            best.append(top + v)
            back.append(b)
    else:
        _paths(pairs, best, back)
    out, k = [], max(range(len(pairs)), key=best.__getitem__)
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _paths(pairs: list[tuple[int, int, float]], best: list[float], back: list[int]) -> None:
    """``path`` for many pairs: a tree of prefix maxima by target, filled one source after the other."""
    places = {j: p for p, j in enumerate(sorted({j for _, j, _ in pairs}), 1)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)
    column: dict[int, tuple[float, int]] = {}  # the best that ends at a target
    row: list[tuple[int, float, int]] = []  # of the source at hand: target, best, number; best grows
    for k, (i, j, v) in enumerate(pairs):
        if k and pairs[k - 1][0] != i:
            for _, w, m in row:
                c = pairs[m][1]
                column[c] = max(column.get(c, (0.0, -1)), (w, m))
                p = places[c]
                while p < len(tree):
                    tree[p] = max(tree[p], (w, m))
                    p += p & -p
            row = []
        top, p = (0.0, -1), places[j] - 1
        while p:
            top = max(top, tree[p])
            p -= p & -p
        w, m = column.get(j, (0.0, -1))
        top = max(top, (w - AGAIN, m)) if m >= 0 else top
        if row:
            top = max(top, max((w - AGAIN, m) for _, w, m in row[-1:]))
        best.append(top[0] + v)
        back.append(top[1])
        row.append((j, best[-1], k) if not row or best[-1] > row[-1][1] else (j, row[-1][1], row[-1][2]))


def align_block(block: Block, use_chain: bool = True, use_program: bool = True, moved: bool = True) -> Iterator[tuple[int, int, int]]:
    """(group, source number, target number) of every pair.

    The switches leave out a step, to see what it decides.
    """
    groups = len(block.first_s) - 1
    light = np.minimum(block.heavy_s[block.left], block.heavy_t[block.right])
    alone = block.score >= AGREED[1] * light
    kept = np.flatnonzero(alone | (block.score >= PLENTY) & (block.score >= PLENTY_SHARE * light))
    words = _spans(block.cut[kept])
    size = block.cut[kept, 1] - block.cut[kept, 0]
    # A word that stands in no more pairs than it has places in its sentences is never used up; only the others are tracked.
    of = np.repeat(np.arange(len(kept)), size)
    word_s, often_s = _numbered(block.word_s[words])
    word_t, often_t = _numbered(block.word_t[words])
    scarce = (often_s > block.most_s[words]) | (often_t > block.most_t[words])
    free = np.bincount(of, np.where(scarce, 0.0, block.word_w[words]), len(kept)).tolist()
    words, of = words[scarce], of[scarce]
    word_s, word_t, word_w = word_s[scarce].tolist(), word_t[scarce].tolist(), block.word_w[words].tolist()
    room_s, room_t = (np.zeros(max(ids, default=-1) + 1, np.int64) for ids in (word_s, word_t))
    room_s[word_s], room_t[word_t] = block.most_s[words], block.most_t[words]
    room_s, room_t = room_s.tolist(), room_t.tolist()
    bound = np.searchsorted(of, np.arange(len(kept) + 1)).tolist()
    left, right, score = block.left[kept].tolist(), block.right[kept].tolist(), block.score[kept].tolist()
    anchor, lighter = block.anchor[kept].tolist(), light[kept].tolist()
    bounds = np.searchsorted(block.group[kept], np.arange(groups + 1)).tolist()
    low_s, low_t = block.first_s.tolist(), block.first_t.tolist()
    for g in range(groups):
        x, y = bounds[g], bounds[g + 1]
        if x == y:
            continue
        taken: set[int] = set()

        def confirm(chosen: list[tuple[float, int, float, float]]) -> None:
            """Take those (strength, pair, words and share asked) that still explain enough, the strongest first."""
            for _, k, least, share in sorted(chosen, reverse=True):
                rest = free[k]
                mine = [w for w in range(bound[k], bound[k + 1]) if room_s[word_s[w]] > 0 and room_t[word_t[w]] > 0]
                for w in mine:
                    rest += word_w[w]
                if rest > 0 and rest >= least and rest >= (PLENTY_SHARE if rest >= PLENTY else share) * lighter[k]:
                    for w in mine:
                        room_s[word_s[w]] -= 1
                        room_t[word_t[w]] -= 1
                    taken.add(k)

        fixed = chain([(left[k], right[k]) for k in range(x, y) if anchor[k] > 0]) if use_chain else []
        on = set(fixed)
        strong, order = {}, sorted(range(x, y), key=lambda k: (left[k], right[k]))
        for k in order:
            here = (left[k], right[k]) in on
            strong[k] = score[k] + ON_CHAIN if here else score[k] - anchor[k]
        chosen: dict[int, tuple[float, int, float, float]] = {k: (strong[k], k, 0.0, AGREED[1]) for k in order if (left[k], right[k]) in on}
        if use_program:
            a, c = low_s[g] - 1, low_t[g] - 1
            at = 0
            for i, j in [*fixed, (low_s[g + 1], low_t[g + 1])]:
                # A gap with the anchors at its ends, as a sentence there may be joined with one inside.
                while at < len(order) and left[order[at]] < a:
                    at += 1
                inside, m = [], at
                lone = i - a == 2 and j - c == 2
                while m < len(order) and left[order[m]] <= i:
                    k = order[m]
                    if c <= right[k] <= j and (strong[k] >= AGREED[0] or lone and a < left[k] < i and c < right[k] < j):
                        inside.append(k)
                    m += 1
                for p in path([(left[k], right[k], strong[k]) for k in inside]):
                    k = inside[p]
                    if k not in chosen:
                        chosen[k] = (strong[k], k, 0.0 if lone and strong[k] < AGREED[0] else AGREED[0], AGREED[1])
                a, c = i, j
        confirm(list(chosen.values()))
        if use_program and moved:
            left_over = [k for k in order if k not in taken and score[k] >= FREE[0]]
            while left_over:
                on_path = [left_over[p] for p in path([(left[k], right[k], score[k]) for k in left_over])]
                confirm([(score[k], k, *FREE) for k in on_path])
                gone = set(on_path)
                left_over = [k for k in left_over if k not in gone]
        for k in sorted(taken):
            yield g, left[k] - low_s[g], right[k] - low_t[g]


def sure_pairs(source: list[list[str]], target: list[list[str]], s: tuple, t: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sentences known without a table: on the chain of anchors, or alone between two of them or in a group."""
    s_id, s_words, s_of, first_s = s
    t_id, t_words, t_of, first_t = t
    ids = {w: i for i, w in enumerate(s_words) if w[0].isdigit() or len(w) > 3}
    to = np.array([ids.get(w, -1) for w in t_words] + [-1], np.int64)[t_id] if len(t_id) else t_id
    group_s, group_t = np.repeat(np.arange(len(source)), np.diff(first_s)), np.repeat(np.arange(len(target)), np.diff(first_t))
    n = len(s_words) + 1
    places = []
    for of, word, group in ((s_of, s_id, group_s), (t_of[to >= 0], to[to >= 0], group_t)):
        pair = _counted(of * n + word)[0]
        of, word = pair // n, pair % n
        key, at, count = np.unique(group[of] * n + word, return_index=True, return_counts=True)
        places.append((key[count == 1], of[at[count == 1]]))
    _, a, b = np.intersect1d(places[0][0], places[1][0], assume_unique=True, return_indices=True)
    anchors: dict[int, list[tuple[int, int]]] = {}
    for i, j, g in zip(places[0][1][a].tolist(), places[1][1][b].tolist(), group_s[places[0][1][a]].tolist()):
        anchors.setdefault(g, []).append((i, j))
    low_s, low_t = first_s.tolist(), first_t.tolist()
    out: list[tuple[int, int]] = []
    for g in range(len(source)):
        fixed = chain(anchors[g]) if g in anchors else []
        out += fixed
        i0, j0 = low_s[g] - 1, low_t[g] - 1
        for i, j in [*fixed, (low_s[g + 1], low_t[g + 1])]:
            if i - i0 == 2 and j - j0 == 2:
                out.append((i - 1, j - 1))
            i0, j0 = i, j
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


class Counts:
    """Counts of words and of pairs of words, of one task."""

    def __init__(self) -> None:
        self.ids: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.words: dict[str, dict[str, int]] = {"s": {}, "t": {}, "f": {}, "p": {}}
        self.n = 0
        self.sentences = 0

    def _add(self, kind: str, words: list[str], ids: np.ndarray) -> None:
        count = np.bincount(ids, minlength=len(words)) if len(ids) else np.zeros(0, np.int64)
        to = self.words[kind]
        for i in np.flatnonzero(count).tolist():
            to[words[i]] = to.get(words[i], 0) + int(count[i])

    def add(self, source: list[list[str]], target: list[list[str]]) -> None:
        """The groups of a block: sentences of either side."""
        for _ in self.parts(source, target):
            pass

    def parts(self, source: list[list[str]], target: list[list[str]]) -> Iterator[None]:
        """``add`` in parts, after each of which what is held may be handed on."""
        s, t = _side(source), _side(target)
        left, right = sure_pairs(source, target, s, t)
        self.sentences += sum(len(g) for g in source)
        sides = []
        for side, (ids, words, of, first), picked in (("s", s, left), ("t", t, right)):
            key = _counted(of * (len(words) + 1) + ids)[0]
            of, ids = key // (len(words) + 1), key % (len(words) + 1)
            start = np.searchsorted(of, np.arange(first[-1] + 1))
            if side == "s":
                self._add("f", words, ids)
            size = np.diff(start)[picked] if len(picked) else np.zeros(0, np.int64)
            sides.append((ids, words, start[picked] if len(picked) else size, size))
        (s_ids, s_words, s_at, s_n), (t_ids, t_words, t_at, t_n) = sides
        self.n += len(s_n)
        for kind, ids, words, at, n in (("s", s_ids, s_words, s_at, s_n), ("t", t_ids, t_words, t_at, t_n)):
            self._add(kind, words, ids[_spans(np.stack([at, at + n], 1))] if len(n) else ids[:0])
        # Sentences of very many pairs of words are counted in shares of their source words.
        share = np.maximum(1, AT_ONCE // np.maximum(t_n, 1))
        shares = -(-s_n // share)
        of = np.repeat(np.arange(len(s_n)), shares)
        skip = (np.arange(len(of)) - np.repeat(np.cumsum(shares) - shares, shares)) * share[of]
        s_at, s_n, t_at, t_n = s_at[of] + skip, np.minimum(share[of], s_n[of] - skip), t_at[of], t_n[of]
        size = s_n * t_n
        lot = np.cumsum(size) // HELD_PAIRS
        for low, high in zip(at := np.searchsorted(lot, np.unique(lot)), [*at[1:], len(lot)]):
            some = size[low:high]
            pair = np.repeat(np.arange(low, high), some)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(some) - some, some)
            to_s, to_t = (np.array([mine.setdefault(w, len(mine)) for w in words] + [0], np.int64) for mine, words in zip(self.ids, (s_words, t_words)))
            width = np.maximum(t_n, 1)[pair]
            key = (to_s[s_ids[s_at[pair] + k // width]] << 32) | to_t[t_ids[t_at[pair] + k % width]] if len(pair) else k
            if len(key):
                self.pairs.append(_counted(key))
                self.held += len(self.pairs[-1][0])
                yield

    def rows(self, everything: bool = True) -> pd.DataFrame:
        """What was counted, as rows (kind, a, b, n), and a new start."""
        return self.batch(everything).to_pandas()

    def batch(self, everything: bool = True) -> pa.Table:
        """``rows`` as Arrow."""
        out = [pa.table({c: pa.array([], kind) for c, kind in (("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()))})]

        def put(kind: str, a: pa.Array, b: pa.Array, n: np.ndarray | list) -> None:
            out.append(pa.table({"kind": pa.repeat(kind, len(a)), "a": a, "b": b, "n": pa.array(n, pa.int64())}))

        if self.pairs:
            key = np.concatenate([k for k, _ in self.pairs])
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(np.concatenate([c for _, c in self.pairs])[order], first)
            put("b", *(pa.array(list(mine), pa.string()).take(pa.array(ids)) for mine, ids in zip(self.ids, (key[first] >> 32, key[first] & 0xFFFFFFFF))), n)
        self.pairs, self.held, self.ids = [], 0, ({}, {})
        if everything:
            for kind, of in [*self.words.items(), ("n", {"": self.n}), ("m", {"": self.sentences})]:
                put(kind, pa.array(list(of), pa.string()), pa.repeat("", len(of)), list(of.values()))
        return pa.concat_tables(out)


def word_counts(rows: DataFrame, clean: Callable[[str, str], tuple[str, str] | None] | None = None, lower: bool = False) -> DataFrame:
    """``kind``, ``a``, ``b``, ``n`` summed over all ``rows`` (s, t): pairs of words b, source and target words of
    paired sentences s and t, sentences that hold a source word f, the numbers of paired sentences n and of
    all source sentences m.

    ``clean`` gives the texts to learn from, or None for a row that teaches nothing. With ``lower`` also p,
    the words that all sources, taught from or not, write in lower case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                texts = list(zip(*(batch.column(c).slice(start, BLOCK).to_pylist() for c in ("s", "t"))))
                if lower:
                    found, kinds = pd.factorize(np.array(_whole.findall("\n".join([s for s, _ in texts])), dtype=object))
                    small = np.array([w[0].islower() for w in kinds] + [False])
                    counts._add("p", kinds.tolist(), found[small[found]])
                if clean:
                    texts = [c for s, t in texts if (c := clean(s, t))]
                for _ in counts.parts([sentences(s) for s, _ in texts], [sentences(t) for _, t in texts]):
                    if counts.held > HELD_PAIRS:
                        yield from counts.batch(False).to_batches()
        yield from counts.batch().to_batches()

    # A task has combined what it hands on, so it is moved first and then summed.
    counted = rows.select("s", "t").mapInArrow(run, "kind string, a string, b string, n long")
    return counted.repartition("kind", "a", "b").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def learned(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The table as rows (kind, a, b, c), from ``word_counts`` and a lexicon (en, tr); see ``Table.of_rows``."""
    counts = cut(counts.where(f"kind <> 'b' or n >= {LEAST_COUNT}"))
    of = {k: counts.where(F.col("kind") == k) for k in "bstfp"}

    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda x: sorted(set(tokens(x or "")) - {"\n"}))

    given = lexicon.select(words("en").alias("e"), words("tr").alias("w")).where("size(e) > 0 and size(w) > 0")
    given = given.select(F.explode("w").alias("b"), "e", (SEEN / F.size("e")).alias("given")).select("b", F.explode("e").alias("a"), "given")
    given = given.groupBy("a", "b").agg(F.least(F.sum("given"), F.lit(SEEN)).alias("given"))
    sizes = {r["kind"]: r["n"] for r in counts.where("kind in ('n', 'm')").collect()}
    n_all, sentences_all = F.lit(float(sizes.get("n", 0))), float(sizes.get("m", 0))
    sums = (
        of["b"].select("a", "b", F.col("n").alias("c")).join(given, ["a", "b"], "full")
        .join(of["t"].select(F.col("a").alias("b"), F.col("n").alias("n_t")), "b", "left")
        .join(of["s"].select("a", F.col("n").alias("n_s")), "a", "left")
        .join(given.select("b").distinct().withColumn("n_given", F.lit(SEEN)), "b", "left")
        .na.fill(0)
    )
    lift = F.col("c") * n_all >= LEAST_LIFT * F.col("n_s") * F.col("n_t")
    sure = (F.col("c") + F.col("given")) / (F.col("n_t") + F.col("n_given"))
    good = sums.withColumn("sure", sure).where((F.col("sure") >= LEAST_SHARE) & ((F.col("given") > 0) | (F.col("c") >= LEAST_COUNT) & (F.col("c") >= LEAST_SHARE * F.col("n_t")) & lift))
    entries = cut(good)
    rendered = entries.select("a").distinct().withColumn("rendered", F.lit(True))
    seen = of["f"].select("a", F.col("n").alias("f")).join(rendered, "a", "full")
    # Rare words weigh most; a word that renders nothing weighs nothing, one of the lexicon alone half.
    weigh = F.log((sentences_all + 1) / F.col("f")) / float(min(RARE_LOG, np.log1p(max(1.0, sentences_all))))
    weight = F.when(F.col("rendered"), F.least(F.coalesce(weigh, F.lit(0.5)), F.lit(1.0))).otherwise(0.0)
    weights = seen.where(f"rendered or f >= {LEAST_COUNT}").select(F.lit("w").alias("kind"), "a", F.lit("").alias("b"), weight.alias("c"))
    plain = of["p"].where("n > 1").select(F.lit("p").alias("kind"), "a", F.lit("").alias("b"), F.lit(0.0).alias("c"))
    return entries.select(F.lit("t").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("sure").alias("c")).unionByName(weights).unionByName(plain)


def train(rows: DataFrame, lexicon: DataFrame, clean: Callable | None = None, lower: bool = False, most: int = TABLE_ROWS) -> Table | DataFrame:
    """The table learned from all ``rows`` (s, t): a Table where it has at most ``most`` rows, else the rows themselves."""
    table = learned(word_counts(rows, clean, lower), lexicon)
    got = table.limit(most + 1).collect()
    return Table.of_rows([tuple(r) for r in got]) if len(got) <= most else cut(table)


def with_table(rows: DataFrame, table: Table | DataFrame, run: Callable[[pd.DataFrame, Table], pd.DataFrame], schema: str, texts: tuple[str, str]) -> DataFrame:
    """``run`` over ``rows`` in blocks, with the table or the part of it that the words of a block need.

    A Table goes to the tasks as it is. One that is too large is joined with the distinct words of
    shares of some SHARED_ROWS rows; a word of very many shares is spread by the salts of ``lookup_join``.
    """
    if isinstance(table, Table):

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), BLOCK):
                    yield run(pdf.iloc[start : start + BLOCK], table)

        return rows.mapInPandas(each, schema)
    shares = max(1, -(-rows.count() // SHARED_ROWS))
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)).cast("int"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(n, w) for n, *row in pdf.itertuples(index=False) for w in {w for x in row if x for w in (*tokens(x), *_whole.findall(x))}]
            yield pd.DataFrame(found, columns=["_share", "a"]).drop_duplicates()

    used = rows.select("_share", *texts).mapInPandas(words, "_share int, a string").distinct()
    entries = table.groupBy("a").agg(F.collect_list(F.struct("kind", "b", "c")).alias("e"))
    needed = lookup_join(used, entries, "a", "inner").select("_share", "a", F.explode("e").alias("e")).select("_share", "e.kind", "a", "e.b", "e.c")

    def both(pdf: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        mine = Table.of_rows(list(part[["kind", "a", "b", "c"]].itertuples(index=False, name=None)))
        done = [run(pdf.iloc[start : start + BLOCK], mine) for start in range(0, len(pdf), BLOCK)]
        return pd.concat(done, ignore_index=True) if done else run(pdf, mine)

    return rows.groupBy("_share").cogroup(needed.groupBy("_share")).applyInPandas(both, schema)


def texts_of(groups: DataFrame) -> DataFrame:
    """``group_id`` and the joined sides ``s`` and ``t`` of the groups that are to be aligned."""
    return groups.where("parity_check and size(translated) > 0").select(
        "group_id", F.concat_ws("", "source").alias("s"), F.concat_ws("", "translated").alias("t")
    )


def align_groups(groups: DataFrame, table: Table | DataFrame, **steps: bool) -> DataFrame:
    """``group_id``, ``source_no``, ``translated_no``: the sentences that render each other.

    Of groups whose parity_check is true (null counts as false) and whose ``translated`` isn't empty;
    null members of the lists are left out. Groups are aligned one by one, so repeated rows give
    repeated pairs and nothing is shuffled (but words, where the table is too large to be sent).
    """

    def run(part: pd.DataFrame, table: Table) -> pd.DataFrame:
        block = match([sentences(x) for x in part["s"]], [sentences(x) for x in part["t"]], table)
        got = np.array(list(align_block(block, **steps)), np.int64).reshape(-1, 3)
        return pd.DataFrame({"group_id": part["group_id"].to_numpy()[got[:, 0]], "source_no": got[:, 1], "translated_no": got[:, 2]})

    kind = groups.schema["group_id"].dataType.simpleString()
    return with_table(texts_of(groups), table, run, f"group_id {kind}, source_no int, translated_no int", ("s", "t"))
