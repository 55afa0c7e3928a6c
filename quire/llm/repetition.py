"""Repetition inside a single document (problem 7).

Texts are folded to words in blocks, as arrays of code points: letters lose case and marks,
invisible characters are left out, everything else separates. All word and character n-grams of a text are
hashed; of each that stood earlier in the same text one part goes to the bucket of its hash, and a
logistic regression over these buckets, trained on a bounded sample that the exact measure labels and
calibrated (Platt) on a part held out, gives every text a probability, in Arrow batches. Only texts
that reach a fixed threshold are then measured exactly; the others never are. Where the sample has only
one class there is nothing to learn and every text is measured.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a passage must have to count as repeated, and the share from which a text is reported.
PASSAGE, SHARE = 5, 0.30
#: Rows the classifier is fitted on, about (those of least key hash, a part of all rows).
TRAIN_ROWS = 3000
#: Calibrated probability below which a text isn't measured.
LOW = 0.01
#: Lengths of the word n-grams and of the character n-grams of the features, and buckets of each.
WORD_GRAMS, CHAR_GRAM, BUCKETS = (1, 2, 3), 16, 64
#: Bits of a hash that are compared, beside the number of its text.
HASH_BITS = 40
#: Code points handled at once.
BLOCK_CHARS = 1_500_000
#: Columns of the features: the buckets of each kind, the share of each kind, the number of words.
KINDS = len(WORD_GRAMS) + 1
COLUMNS = KINDS * BUCKETS + KINDS + 1

_GAP, _DROP, _ALONE = 0, 0xFFFFFFFF, 1 << 24
_fold = np.zeros(0x110000, np.uint32)
_known = np.zeros(0x110000, bool)


def _class(point: int) -> int:
    """What a code point counts as: a folded letter, a gap, nothing, or a letter that is a word alone."""
    c = chr(point)
    kind = unicodedata.category(c)
    if kind in ("Mn", "Me", "Cf") or c == "ㅤ":
        return _DROP
    if kind[0] != "L" and kind != "Mc":
        return _GAP
    if c in "ıIİi":
        return ord("i")
    base = unicodedata.normalize("NFKD", c.lower())
    folded = next((ord(x) for x in base if unicodedata.category(x)[0] == "L"), point)
    # Scripts written without spaces: each letter is a word.
    alone = kind == "Lo" and (0x0E00 <= point < 0x1000 or 0x1780 <= point < 0x1800 or 0x3040 <= point < 0xA000 or 0x20000 <= point < 0x32000)
    return folded | _ALONE if alone else folded


def _folded(points: np.ndarray) -> np.ndarray:
    fresh = np.unique(points[~_known[points]])
    for p in fresh.tolist():
        _fold[p] = _class(p)
    _known[fresh] = True
    return _fold[points]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _seen(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at an earlier position."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``starts`` (the last is the end)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass(frozen=True)
class Words:
    """Hashed words of many texts, the first word of each text (with an end), and their folded characters."""

    words: np.ndarray
    at: np.ndarray
    folded: np.ndarray
    doc_at: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.at)

    def of(self, keep: np.ndarray) -> Words:
        """The words of the texts in ``keep`` (a mask) alone."""
        count = self.count[keep]
        return Words(self.words[np.repeat(keep, self.count)], np.concatenate([[0], np.cumsum(count)]), self.folded[:0], self.doc_at[:0])


def read(texts: list[str]) -> Words:
    """Fold texts and hash their words."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    doc_at = np.concatenate([[0], np.cumsum(lengths + 1)])  # one line feed between the texts
    folded = _folded(points)
    keep = np.flatnonzero(folded != _DROP)
    folded = folded[keep]
    doc_at = np.searchsorted(keep, doc_at)
    letter = folded != _GAP
    alone = (folded & _ALONE) != 0
    before = np.concatenate([[False], letter[:-1] & ~alone[:-1]])[: len(letter)]
    starts = np.flatnonzero(letter & (~before | alone))
    at = np.flatnonzero(letter)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), folded, doc_at)
    is_start = np.zeros(len(folded), bool)
    is_start[starts] = True
    word_of = np.cumsum(is_start[at]) - 1
    place = at - starts[word_of]
    value = _mix(folded[at].astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(32)))
    words = _mix(np.add.reduceat(value, np.searchsorted(at, starts)))
    return Words(words, np.searchsorted(starts, doc_at), folded, doc_at)


def _grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word n-gram without its text, its text, and its first word."""
    words, doc_of = w.words, np.repeat(np.arange(len(w.at) - 1, dtype=np.uint64), w.count)
    m = len(words) - size + 1
    if m <= 0:
        return words[:0], doc_of[:0], np.zeros(0, np.int64)
    key = words[:m].copy()
    for k in range(1, size):
        key = _mix(key) + words[k : k + m]
    inside = np.flatnonzero(doc_of[:m] == doc_of[size - 1 :])
    return _mix(key[inside]), doc_of[inside], inside


def exact(w: Words) -> np.ndarray:
    """For each text, the number of words in passages that occurred earlier in it."""
    key, doc, at = _grams(w, PASSAGE)
    hits = at[_seen(_mix(key ^ _mix(doc + np.uint64(77))))]
    edge = np.zeros(len(w.words) + PASSAGE, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + PASSAGE, -1)
    return _sums(np.cumsum(edge)[: len(w.words)] > 0, w.at)


def measure(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the texts, and of each text the number of words and of words in repeated passages."""
    w = read(texts)
    return w, w.count, exact(w)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features as (text, column, value): repeated n-grams of each kind by bucket, all of them, and the words."""
    n = len(w.at) - 1
    count = w.count
    docs, columns, values = [], [], []
    for kind in range(KINDS):
        key, doc = _grams(w, WORD_GRAMS[kind])[:2] if kind < len(WORD_GRAMS) else _char_grams(w)
        of = np.maximum(np.bincount(doc.astype(np.int64), minlength=n), 1)
        again = _again(key, doc)
        hit = (again >> np.uint64(HASH_BITS)).astype(np.int64)
        cells = np.bincount(hit * BUCKETS + (again % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS)
        cell = np.flatnonzero(cells)
        docs.append(cell // BUCKETS)
        columns.append(kind * BUCKETS + cell % BUCKETS)
        values.append(cells[cell] / of[cell // BUCKETS])
        docs.append(np.arange(n))
        columns.append(np.full(n, KINDS * BUCKETS + kind))
        values.append(np.bincount(hit, minlength=n) / of)
    docs.append(np.arange(n))
    columns.append(np.full(n, COLUMNS - 1))
    values.append(np.log1p(count) / 10)
    return np.concatenate(docs), np.concatenate(columns), np.concatenate(values)


def _again(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the n-grams of each text those that stood earlier in it: the text, and below it HASH_BITS of the hash."""
    both = np.sort((doc << np.uint64(HASH_BITS)) | (key >> np.uint64(64 - HASH_BITS)))
    return both[1:][both[1:] == both[:-1]]


def dense(sparse: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The features of ``n`` texts as a matrix."""
    doc, column, value = sparse
    return np.bincount(doc * COLUMNS + column, value, n * COLUMNS).reshape(n, COLUMNS)


def _char_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each character n-gram, and its text; none goes beyond the end of its text."""
    h = w.folded.astype(np.uint64)
    width = 1
    while width < CHAR_GRAM:
        h = _mix(h[: max(0, len(h) - width)]) + h[width:]
        width *= 2
    ends = w.doc_at[1:] - 1  # before the line feed
    ends[-1:] = len(w.folded)
    count = np.maximum(ends - w.doc_at[:-1] - CHAR_GRAM + 1, 0)
    at = np.repeat(w.doc_at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return _mix(h[at]), np.repeat(np.arange(len(count), dtype=np.uint64), count)


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@dataclass(frozen=True)
class Model:
    """Weights over the features and an offset, and the slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, sparse: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        doc, column, value = sparse
        z = np.bincount(doc, self.weights[column] * value, n) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Ridge of the weights, against which shares are scaled.
RIDGE, SCALE = 1.0, 20.0


def fit(table: np.ndarray, label: np.ndarray) -> Model | None:
    """Logistic regression on two thirds of the rows, Platt calibration on the rest; None for one class."""
    label = label.astype(float)
    third = np.arange(len(label)) % 3 == 2
    if not all(0 < part.sum() < len(part) for part in (label[third], label[~third])):
        return None
    design = np.hstack([table * SCALE, np.ones((len(table), 1))])
    weights = _newton(design[~third], label[~third], RIDGE)
    held, y = design[third] @ weights, label[third]
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, offset = _newton(np.column_stack([held, np.ones(len(held))]), target, 1e-3)
    return Model(weights[:-1] * SCALE, float(weights[-1]), float(max(slope, 1e-3)), float(offset))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on about ``rows`` texts: those whose key hash is in the part of all hashes that so many are expected in.

    One task fits, from the features of the sample; the model alone comes back.
    """
    n = df.count()  # of all rows, so that no text is read for it
    if not n:
        return None
    least = -(2**63) + int(2**64 * min(1.0, rows / n)) - 1
    sample = df.where(F.xxhash64(key) <= F.lit(least)).select(text).where(F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, labels = [np.zeros((0, COLUMNS))], [np.zeros(0, bool)]
        for batch in batches:
            for block in _blocks(batch.column(0).to_pylist()):
                w, count, covered = measure(block)
                tables.append(dense(features(w), len(block)))
                labels.append((count > 0) & (covered >= SHARE * count))
        table, label = np.concatenate(tables), np.concatenate(labels)
        order = np.lexsort((*table.T[-8:], label))  # the same model whatever order the rows come in
        order = order[np.argsort(_mix(np.arange(len(order), dtype=np.uint64)), kind="stable")]
        model = fit(table[order], label[order])
        got = np.concatenate([model.weights, [model.bias, model.slope, model.offset]]) if model else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64())], ["v"])

    got = np.array([r[0] for r in sample.coalesce(1).mapInArrow(run, "v double").collect()])
    return Model(got[:-3], *map(float, got[-3:])) if len(got) else None


def repeated_share(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, low: float = LOW, found: bool = False
) -> DataFrame:
    """``key``, ``n_words``, ``n_repeated``, ``share`` of every row, and ``probability`` by the model.

    A null, empty or wordless text has no words and a share of 0. A word is repeated if it lies in a
    passage of five or more words that occurred earlier in the text, as it is when read without case,
    marks, punctuation, digits and invisible characters. Without a model the probability is null.
    With ``found`` only the rows whose share reaches the threshold come back; texts of a lower
    probability than ``low`` aren't measured. Repeated rows give repeated rows, a null key stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in _blocks(batch.column(1).to_pylist()):
                keys = batch.column(0).slice(start, len(block))
                start += len(block)
                w = read(block)
                p = model.probability(features(w), len(block)) if model else np.full(len(block), np.nan)
                kept = (p >= low) & (w.count > 0) if found and model else np.ones(len(block), bool)
                if found and model:
                    w, keys, p = w.of(kept), keys.filter(pa.array(kept)), p[kept]
                count, covered = w.count, exact(w)
                hit = pa.array((count > 0) & (covered >= SHARE * count) if found else np.ones(len(count), bool))
                cols = [keys, pa.array(count), pa.array(covered), pa.array(covered / np.maximum(count, 1)), pa.array(p, mask=np.isnan(p))]
                yield pa.RecordBatch.from_arrays([c.filter(hit) for c in cols], [key, "n_words", "n_repeated", "share", "probability"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kind}, n_words long, n_repeated long, share double, probability double")
