"""Sentences of a text, as the document pipeline splits them: within lines, after closing marks."""

from __future__ import annotations

import re
from functools import lru_cache

from quire.functions.sentences import ABBREVIATIONS, is_abbreviation, kept_spans

_end = re.compile("[.!?…]+[\"'”’)\\]]*(?=\\s)")
_mark = re.compile(r"\s*(?:\d+[.)]|[-*+•]|#{1,6}|\[\^[^\]\s]+\]:|>)\s*\Z")


#: Characters before a period that tell whether an abbreviation ends there.
BEFORE = max(map(len, ABBREVIATIONS)) + 2


@lru_cache(1 << 16)
def _abbreviated(end: str) -> bool | None:
    """Whether a text that ends so, before a period, ends in an abbreviation; None where more of it must be seen."""
    if len(end) == BEFORE and end.isascii() and all(c.isalpha() or c == "." for c in end):
        return False if end.isalpha() else None
    return is_abbreviation(end + ".", len(end))


def line_sentences(line: str) -> list[str]:
    """The sentences of one line; a list, heading or footnote mark stays with its sentence."""
    kept = kept_spans(line)
    out, start = [], 0
    for m in _end.finditer(line):
        at = m.start()
        if kept and any(a < at < b or a < m.end() < b for a, b in kept):
            continue
        if line[at] == ".":
            short = _abbreviated(line[max(0, at - BEFORE) : at])
            if short or short is None and is_abbreviation(line, at):
                continue
        if not out and _mark.match(line, start, m.end()):
            continue
        out.append(line[start : m.end()])
        start = m.end()
    if line[start:].strip():
        out.append(line[start:])
    return out


def sentences(text: str) -> list[str]:
    """All sentences in order; blank lines hold none."""
    return [s for line in text.split("\n") if line and not line.isspace() for s in line_sentences(line)]
