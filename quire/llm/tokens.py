"""Encoding of a whole corpus with a public byte-level BPE (problem 5).

Texts are cut at content-defined positions: a rolling hash over the last 16 code points picks the
cuts, so equal passages fall into equal chunks wherever they stand. A chunk is encoded once a worker
process while it stays in a bounded cache, and reused for every document that holds it. Cutting
changes the tokens near a cut, so each join is repaired: the bytes between the last position before
and the first position after the join at which the pre-tokenizer must split (an ASCII letter or
digit followed by a space) are encoded again. Both sides agree from there on by construction, so the
ids equal those of the text encoded in one go.

The reuse stays inside a worker on purpose: one global table of chunks would move the whole corpus
and all its ids through two shuffles, which costs more than encoding it. There is no shuffle, and no
group that could become hot.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder with the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: The pattern by which these rank files split text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Average, least and largest size of a chunk in code points.
CHUNK_BITS, CHUNK_MIN, CHUNK_MAX = 10, 256, 4096
#: Code points of chunks a worker keeps.
CACHE_CHARS = 8_000_000
#: Code points handled at once.
BLOCK_CHARS = 2_000_000

#: Length from which a run of white space is handed over as one piece.
LONG_SPACE = 5000
#: Unicode White_Space. Fixed value.
_spaces = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """A rank file with the chunk cache of this process."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        word = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
        self.opens = [t[:1] == b" " for t in self.token]
        self.closes = [bool(t) and t[-1] in word for t in self.token]
        self.cache: dict[str, list[int]] = {}
        self.cached = 0

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not (run := _spaces.search(text)):
            return self.encoding.encode_ordinary(text)
        # The pattern takes such a run but for its last code point as one piece (all of it at the
        # end of the text); the library's regex engine would run out of stack on it.
        start, end = run.span()
        end -= end < len(text)
        return self.encode(text[:start]) + self.encoding._encode_single_piece(text[start:end]) + self.encode(text[end:])

    def chunk(self, text: str) -> list[int]:
        ids = self.cache.get(text)
        if ids is None:
            ids = self.encode(text)
            if self.cached > CACHE_CHARS:
                self.cache.clear()
                self.cached = 0
            self.cache[text] = ids
            self.cached += len(text)
        return ids

    def stitch(self, parts: list[list[int]]) -> list[int]:
        """The ids of the joined text, from the ids of its chunks."""
        opens, closes = self.opens, self.closes
        done: list[int] = []
        tail, stale = parts[0], False  # the ids after the last sure split; stale: not yet encoded as one
        at = self._last_split(tail)
        done += tail[:at]
        tail = tail[at:]
        for part in parts[1:]:
            split = next((i for i in range(1, len(part)) if opens[part[i]] and closes[part[i - 1]]), 0)
            if not split and not (part and opens[part[0]] and tail and closes[tail[-1]]):
                tail, stale = tail + part, True
                continue
            done += self._again(tail + part[:split])
            rest = part[split:]
            at = self._last_split(rest)
            done += rest[:at]
            tail, stale = rest[at:], False
        return done + (self._again(tail) if stale else tail)

    def _last_split(self, ids: list[int]) -> int:
        opens, closes = self.opens, self.closes
        return next((i for i in range(len(ids) - 1, 0, -1) if opens[ids[i]] and closes[ids[i - 1]]), 0)

    def _again(self, ids: list[int]) -> list[int]:
        return self.encode(b"".join([self.token[i] for i in ids]).decode("utf-8"))


def encoder(path: str) -> Encoder:
    """The encoder of a rank file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cuts(texts: list[str]) -> list[list[int]]:
    """Content-defined cut positions inside each text, without its ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    h = (points + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    for width, factor in ((1, 2246822519), (2, 3266489917), (4, 668265263), (8, 374761393)):
        wide = h * np.uint32(factor)
        wide[width:] += h[:-width] if len(h) > width else 0
        h = wide
    h ^= h >> np.uint32(13)
    found = np.flatnonzero((h * np.uint32(2654435761)) >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = np.cumsum([len(t) for t in texts])
    split = np.split(found, np.searchsorted(found, ends[:-1], side="right"))
    out = []
    for text, end, marks in zip(texts, ends.tolist(), split):
        start = end - len(text)
        mine: list[int] = []
        last = 0
        for mark in [*(marks - start).tolist(), len(text)]:
            while mark - last > CHUNK_MAX:
                last += CHUNK_MAX
                mine.append(last)
            if mark - last >= CHUNK_MIN and len(text) - mark >= CHUNK_MIN:
                mine.append(mark)
                last = mark
        out.append(mine)
    return out


def encode_texts(tool: Encoder, texts: list[str | None]) -> Iterator[list[int]]:
    """The ids of each text in order; an empty and a null text have none."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size > BLOCK_CHARS:
            yield from _block(tool, block)
            block, size = [], 0
    if block:
        yield from _block(tool, block)


def _block(tool: Encoder, texts: list[str]) -> Iterator[list[int]]:
    for text, marks in zip(texts, cuts(texts) if any(texts) else [[]] * len(texts)):
        if not text:
            yield []
        elif not marks:
            yield tool.chunk(text)
        else:
            ends = [0, *marks, len(text)]
            yield tool.stitch([tool.chunk(text[a:b]) for a, b in zip(ends, ends[1:])])


def _file(name: str, folder: str) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row.

    Empty and null texts get an empty list; a null key, repeated rows and further columns do no
    harm (one output row for each input row, only the two columns). An empty table gives none.
    """
    path = _file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for ids in encode_texts(tool, batch.column(1).to_pylist()):
                flat.extend(ids)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(
                pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(
    df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (int) of every row; 0 for an empty or null text."""
    path = _file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            sizes = pa.array([len(ids) for ids in encode_texts(tool, batch.column(0).to_pylist())], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], [*keep, "n_tokens"])

    fields = [f"`{c}` {df.select(c).schema[0].dataType.simpleString()}" for c in keep]
    return df.select(df[text], *[df[c] for c in keep]).mapInArrow(run, ", ".join([*fields, "n_tokens int"]))
