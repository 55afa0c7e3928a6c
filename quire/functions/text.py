"""Scalar text functions as Column expressions. A null input gives a null result.

Java's \\w, \\d and \\s are ASCII, and with its Unicode flag they hold marks and joiners that are no word
characters here; the classes below say what is meant. The dot doesn't stop at CR under (?d).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

#: Letters, word characters and white space, for use inside brackets.
L, W, S = r"\p{L}\p{Nl}\p{No}", r"\p{L}\p{N}_", r"\s\x0B\x1C-\x1F\x{85}\p{Z}"

#: Characters that end a sentence, with the marks that may close after them. Fixed values.
TERMINALS = ".!?:”\"’)…"
#: Superscript digits by which units carry footnote marks. Fixed values.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: A bare page number: arabic or roman, alone or with a total. Fixed pattern.
PAGE_NUMBER = rf"(?i)^[{S}]*(?:page[{S}]+)?(?:\p{{Nd}}{{1,4}}|[ivxlcdm]{{1,7}})(?:[{S}]*(?:/|of)[{S}]*\p{{Nd}}{{1,4}})?[{S}]*$"
#: Glyphs that open a list item. Fixed values.
BULLETS = r"•·▪■□◦‣○●►▸➢✓–—\-\*"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^[{S}]+|[{S}]+$", "")


def squeezed(text: Column) -> Column:
    """``trimmed``, with every run of white space as one space."""
    return trimmed(F.regexp_replace(text, rf"[{S}]+", " "))


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def words(text: Column) -> Column:
    """Runs of Unicode letters in order, each in lower case."""
    return F.transform(F.regexp_extract_all(text, lit(rf"[{L}]+"), lit(0)), F.lower)


def line_pattern(text: Column) -> Column:
    """The form by which repeated lines are recognised: lower case, digits as #, no punctuation, single spaces."""
    masked = F.regexp_replace(F.lower(text), r"\p{Nd}+", "#")
    return squeezed(F.regexp_replace(masked, rf"[^{W}{S}#]", ""))


def is_page_number(text: Column) -> Column:
    """Whether a line is only a page number (``47``, ``page 47``, ``xii``, ``3 of 120``)."""
    return text.rlike(PAGE_NUMBER)


def ends_with_terminal(text: Column) -> Column:
    """Whether the text ends a sentence, not counting a superscript footnote mark at its end."""
    bare = F.regexp_replace(text, rf"[{S}{SUPERSCRIPTS}]+$", "")
    return bare.rlike(r"[.!?:”\"’)…]$")


def to_superscript(text: Column) -> Column:
    """ASCII digits as superscript digits."""
    return F.translate(text, "0123456789", SUPERSCRIPTS)


def round_half(size: Column) -> Column:
    """To the nearest half, ties to even."""
    return F.bround(size * 2, 0) / 2


def numbered_level(text: Column) -> Column:
    """Heading level by numbering, 1 to 3: ``Chapter 3`` 1, ``3.2 Title`` 2; else null."""
    line = trimmed(text)
    number = F.regexp_extract(line, rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?[{S}]+[^{S}]", 1)
    depth = F.length(number) - F.length(F.replace(number, lit("."), lit(""))) + 1
    return F.when(line.rlike(rf"(?i)^(?:chapter|part|book)[{S}]+(?:\p{{Nd}}+|[ivxlcdm]+)(?:[^{W}]|$)"), lit(1)).when(
        number != "", F.least(depth, lit(3))
    )


def is_title_case(text: Column) -> Column:
    """Whether every word of four letters or more is capitalised, and there is one."""
    long = F.filter(F.regexp_extract_all(text, lit(rf"[{L}]+"), lit(0)), lambda w: F.length(w) >= 4)
    return (F.size(long) > 0) & F.forall(long, lambda w: w.rlike(r"^\p{Lu}"))


def has_letters(text: Column) -> Column:
    """Whether there is a Unicode letter."""
    return text.rlike(r"\p{L}")


def is_heading_candidate(
    lines: Column, size: Column, bold: Column, body_size: Column, ratio: Column | float, before_paragraph: Column
) -> Column:
    """A block of one or two short lines without end mark, set larger than the body or bold before a paragraph."""
    filled = F.filter(F.transform(lines, trimmed), lambda t: t != "")
    joined = F.array_join(filled, " ")
    shape = F.size(filled).between(1, 2) & (F.length(joined) <= 120) & ~joined.rlike(r"[.,;:]$") & has_letters(joined)
    large = (size >= body_size * ratio) | (bold & (size >= body_size) & before_paragraph)
    return shape & (body_size > 0) & large


def list_marker(text: Column) -> Column:
    """struct(marker, content) of a list item, else null: bullets and letters become ``-``, numbers ``N.``"""
    line = trimmed(text)
    bullet, numbered, letter = rf"(?d)^[{BULLETS}][{S}]+(.+)$", rf"(?d)^(\p{{Nd}}{{1,3}})[.)][{S}]+(.+)$", rf"(?d)^[a-z][.)][{S}]+(.+)$"
    return (
        F.when(line.rlike(bullet), F.struct(lit("-").alias("marker"), trimmed(F.regexp_extract(line, bullet, 1)).alias("content")))
        .when(line.rlike(numbered), F.struct(F.concat(F.regexp_extract(line, numbered, 1), lit(".")).alias("marker"), trimmed(F.regexp_extract(line, numbered, 2)).alias("content")))
        .when(line.rlike(letter), F.struct(lit("-").alias("marker"), trimmed(F.regexp_extract(line, letter, 1)).alias("content")))
    )


def list_level(x0: Column, base_x0: Column, size: Column) -> Column:
    """Nesting level 0 to 3 from the offset of the marker in steps of the font size (4 at least)."""
    steps = ((x0 - base_x0) / F.greatest(size, lit(4.0)) + 0.5).cast("int")
    return F.greatest(lit(0), F.least(lit(3), steps))


def footnote_definition(text: Column) -> Column:
    """struct(label, content) of a line that defines a footnote, else null."""
    form = rf"(?d)^[{S}]*(\p{{Nd}}{{1,3}}|[*†‡])[.):]?[{S}]+(.+)$"
    return F.when(
        text.rlike(form),
        F.struct(F.regexp_extract(text, form, 1).alias("label"), trimmed(F.regexp_extract(text, form, 2)).alias("content")),
    )


def is_footnote_marker(text: Column) -> Column:
    """Whether a raised span refers to a footnote: digits or one of the signs."""
    return trimmed(text).rlike(r"^(?:\p{Nd}+|[*†‡]+)$")


def looks_like_caption(text: Column) -> Column:
    """Whether a line begins like a caption, in any case."""
    return trimmed(text).rlike(rf"(?i)^(?:figure|fig|table|illustration)(?:[^{W}]|$)")


def matches_caption(text: Column) -> Column:
    """Whether a line begins as a numbered or lettered caption."""
    return trimmed(text).rlike(rf"^(?:Figure|Fig\.|Table|Illustration|Plate|Listing)[{S}]*[\p{{Nd}}A-Z]")


def is_label_like(lines: Column, width: Column, body_width: Column) -> Column:
    """Whether a block can be a label beside a drawing: at most two lines, 80 characters, half the body's width."""
    filled = F.filter(lines, lambda t: t != "")
    joined = F.array_join(filled, " ")
    narrow = (body_width <= 0) | (width <= body_width * 0.5)
    return F.size(filled).between(1, 2) & (F.length(joined) <= 80) & ~matches_caption(joined) & narrow


def is_monospace(font: Column) -> Column:
    return font.rlike("(?i)mono|courier|consolas|code")


def is_italic(font: Column) -> Column:
    return font.rlike("(?i)italic|oblique")


def font_family(font: Column) -> Column:
    """mono, sans or serif by the name of a font."""
    sans = font.rlike("(?i)sans|arial|helvetica|nimbus ?sans|verdana|calibri|segoe|tahoma")
    return F.when(is_monospace(font), "mono").when(sans, "sans").when(font.isNotNull(), "serif")


def color_hex(value: Column) -> Column:
    """``#rrggbb`` of a 24-bit colour; negative values count as black."""
    bits = F.greatest(value.cast("long"), lit(0)).bitwiseAND(lit(0xFFFFFF))
    return F.concat(lit("#"), F.lower(F.lpad(F.hex(bits), 6, "0")))


def image_line(line: Column) -> Column:
    """struct(image_id, src) of an image line, else null; src is null for the short form."""
    form = r'^<!--\s*image:(\d+)((?:\s+[a-z]+="[^"\n]*")*)\s*-->[ \t]*$'
    src = F.regexp_extract(F.regexp_extract(line, form, 2), r'(?<![a-z])src="([^"\n]*)"', 1)
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).cast("long").alias("image_id"), F.nullif(src, lit("")).alias("src")))


def format_image_line(image_id: Column, src: Column) -> Column:
    """The image line of an id; the short form where src is null or empty."""
    given = F.concat(lit("<!-- image:"), image_id, lit(' src="'), src, lit('" -->'))
    return F.when(src.isNotNull() & (src != ""), given).otherwise(F.concat(lit("<!-- image:"), image_id, lit(" -->")))


def legend_marker(line: Column) -> Column:
    """struct(image_id, more) of a legend marker, else null."""
    form = r'^<!--\s*legend:(\d+)(?:\s+more="(\d+)")?\s*-->[ \t]*$'
    more = F.coalesce(F.nullif(F.regexp_extract(line, form, 2), lit("")).cast("long"), lit(0))
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).cast("long").alias("image_id"), more.alias("more")))


def format_legend_marker(image_id: Column, more: Column) -> Column:
    """The legend marker of an id, with the number of labels left out where there are any."""
    return F.concat(lit("<!-- legend:"), image_id, F.when(more > 0, F.concat(lit(' more="'), more, lit('"'))).otherwise(""), lit(" -->"))


def turkish_fold(text: Column) -> Column:
    """Lower case by Turkish rules: I to dotless i, dotted I to i."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def target_stem(target: Column) -> Column:
    """All but the last two characters, four at least."""
    return F.substring(target, lit(1), F.greatest(lit(4), F.length(target) - 2))


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in ``text``, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, lit(part), lit("")))) / len(part)).cast("int")


def marker_counts(text: Column) -> Column:
    """struct of the counts of bold, single-star, code and footnote markers."""
    bold = occurrences(text, "**")
    return F.struct(
        bold.alias("bold"), (occurrences(text, "*") - 2 * bold).alias("star"),
        occurrences(text, "`").alias("code"), occurrences(text, "[^").alias("note"),
    )


def truncated(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), lit("…"))).otherwise(text)


def is_empty_answer(source: Column, answer: Column) -> Column:
    """Whether a source with text has an answer without any."""
    return (trimmed(source) != "") & (F.coalesce(trimmed(answer), lit("")) == "")


def is_truncated_answer(source: Column, answer: Column) -> Column:
    """Whether a source over 40 characters has an answer of less than a fifth of its length."""
    return (F.length(trimmed(source)) > 40) & (F.length(trimmed(answer)) < F.length(trimmed(source)) * 0.2)


def strip_markup(text: Column) -> Column:
    """Without comments, scripts, styles and tags."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(bare, r"</?[A-Za-z][^>]*>", "")


def strip_control(text: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(text, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def escape_markup(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as references."""
    out = F.replace(text, lit("&"), lit("&amp;"))
    return F.replace(F.replace(out, lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))


def redacted(text: Column, secrets: list[str]) -> Column:
    """With every secret as ***; longer ones first, so that none leaves a part of another."""
    out = text
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        out = F.replace(out, lit(secret), lit("***"))
    return out


def block_name(page: Column, index: Column) -> Column:
    """``p012-b003``"""
    return F.format_string("p%03d-b%03d", page.cast("int"), index.cast("int"))


def figure_file(image_id: Column) -> Column:
    """``img-00012.png``"""
    return F.format_string("img-%05d.png", image_id.cast("int"))


def timestamp_text(ts: Column) -> Column:
    """27 characters of ISO text in UTC, in microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def union_lines(left: Column, right: Column, compounds: Column) -> Column:
    """struct(text, doubtful): two lines as one.

    A hyphen at the end of the left line is dropped before a lower-case word, kept where the word is
    one of ``compounds`` (lower case), and kept as doubtful where it can't be told.
    """
    a, b = F.regexp_replace(left, rf"[{S}]+$", ""), F.regexp_replace(right, rf"^[{S}]+", "")
    head, tail = F.regexp_extract(a, rf"([{L}]+)-$", 1), F.regexp_extract(b, rf"^([{L}]+)", 1)
    compound = F.lower(F.concat(head, lit("-"), tail))
    kept = F.concat(a, b)
    broken = (head != "") & (tail != "")
    lower = tail.rlike(r"^\p{Ll}")
    doubtful = broken & (~lower | (~F.array_contains(compounds, compound) & (F.length(head) == 1)))
    text = (
        F.when(a == "", b).when(b == "", a).when(~broken, F.concat(a, lit(" "), b))
        .when(doubtful | F.array_contains(compounds, compound), kept)
        .otherwise(F.concat(F.substring(a, lit(1), F.length(a) - 1), b))
    )
    return F.struct(text.alias("text"), F.when(doubtful & (a != "") & (b != ""), F.concat(head, lit("-"), tail)).alias("doubtful"))


def continues_on_next_page(before: Column, after: Column) -> Column:
    """Whether a paragraph goes on: no end mark and a lower-case letter, or a hyphen and a letter."""
    a, b = trimmed(before), trimmed(after)
    hyphen = a.rlike("-$") & b.rlike(r"^\p{L}")
    return (a != "") & (b != "") & (hyphen | (~a.rlike("-$") & ~ends_with_terminal(a) & b.rlike(r"^\p{Ll}")))
