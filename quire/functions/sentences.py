"""Sentences of a text as spans that tile it: nothing is lost, white space stays with the sentence before."""

from __future__ import annotations

import re

#: Words whose period doesn't end a sentence (compared in lower case). Fixed values.
ABBREVIATIONS = frozenset(
    "e.g i.e etc vs cf no nos mr mrs ms dr prof sr jr st mt fig figs eq vol ch chap sec pp p ed eds al inc ltd co corp "
    "jan feb mar apr jun jul aug sep sept oct nov dec approx dept univ gen col lt sgt capt rev hon u.s u.k".split()
)
_end = re.compile("[.!?…]+[\"'”’)\\]]*\\s+")
_word = re.compile(r"[A-Za-z][A-Za-z.]*\Z")
_kept = re.compile(r"`+[^`]*`+|\[[^\]\n]*\]\([^)\n]*\)")


def is_abbreviation(text: str, at: int) -> bool:
    """Whether the period at ``at`` belongs to an abbreviation or an initial."""
    start = at
    while start > 0 and text[start - 1].isascii() and (text[start - 1].isalpha() or text[start - 1] == "."):
        start -= 1
    found = _word.search(text, start, at)
    if text[at] != "." or found is None:
        return False
    word = found.group()
    return (len(word) == 1 and word.isupper()) or word.lower().rstrip(".") in ABBREVIATIONS


def kept_spans(text: str) -> list[tuple[int, int]]:
    """Spans of inline code and links, inside which no sentence ends."""
    return [m.span() for m in _kept.finditer(text)] if "`" in text or "](" in text else []


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; they tile the text, an empty text has none."""
    kept = kept_spans(text)
    cuts = [0]
    for m in _end.finditer(text):
        inside = any(a < m.start() < b or a < m.end() < b for a, b in kept)
        if m.end() < len(text) and not inside and not is_abbreviation(text, m.start()):
            cuts.append(m.end())
    return list(zip(cuts, [*cuts[1:], len(text)])) if text else []


def split_sentences(text: str) -> list[str]:
    """The sentences; joined, they give the text."""
    return [text[a:b] for a, b in sentence_spans(text)]
