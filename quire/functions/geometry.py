"""Box algebra as Column expressions over struct<x0, y0, x1, y1: double> in page points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def union(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def area(a: Column) -> Column:
    return F.greatest(a.x1 - a.x0, lit(0.0)) * F.greatest(a.y1 - a.y0, lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that both cover; 0 where they only touch or lie apart."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def expand(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else lit(float(by))
    return box(a.x0 - by, a.y0 - by, a.x1 + by, a.y1 + by)


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    return (inner.x0 >= outer.x0 - slack) & (inner.y0 >= outer.y0 - slack) & (inner.x1 <= outer.x1 + slack) & (inner.y1 <= outer.y1 + slack)


def gap(a: Column, b: Column) -> Column:
    """The larger of the distances in x and y between two boxes, 0 where they touch."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1, lit(0.0))
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1, lit(0.0))
    return F.greatest(dx, dy)


def transformed(a: Column, m: Column) -> Column:
    """The box around ``a`` under the matrix struct(a, b, c, d, e, f)."""
    xs = [m.a * x + m.c * y + m.e for x in (a.x0, a.x1) for y in (a.y0, a.y1)]
    ys = [m.b * x + m.d * y + m.f for x in (a.x0, a.x1) for y in (a.y0, a.y1)]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def in_band(a: Column, page_height: Column, ratio: float = 0.12) -> Column:
    """Whether a box lies wholly in the top or the bottom band of the page."""
    band = page_height * ratio
    return (page_height > 0) & ((a.y1 <= band) | (a.y0 >= page_height - band))


def first_line_indent(boxes: Column) -> Column:
    """How far the first of several lines is set in from the others, which share a left edge within a point."""
    lines = F.filter(boxes, lambda b: b.x1 > b.x0)
    rest = F.transform(F.slice(lines, lit(2), F.greatest(F.size(lines) - 1, lit(0))), lambda b: b.x0)
    first = F.get(lines, 0)
    indent = first.x0 - F.array_min(rest)
    height = F.greatest(first.y1 - first.y0, lit(1.0))
    sits = (F.size(lines) >= 2) & (F.array_max(rest) - F.array_min(rest) <= 1.0) & (indent > 1.0) & (indent <= 3.0 * height)
    return F.when(sits, indent).otherwise(0.0)


def alignment(boxes: Column, container: Column) -> Column:
    """left, center, right or justify of the lines of a block.

    One line is centred if it is in its container; several are justified from three on where left
    edges agree within 1 point and right edges, but for the last, within 1.5.
    """
    lines = F.filter(boxes, lambda b: b.x1 > b.x0)
    n = F.size(lines)
    first = F.get(lines, 0)
    lefts, rights = F.transform(lines, lambda b: b.x0), F.transform(lines, lambda b: b.x1)
    body = F.when(first_line_indent(lines) > 0, F.slice(lefts, lit(2), F.greatest(n - 1, lit(0)))).otherwise(lefts)
    spread = lambda xs: F.array_max(xs) - F.array_min(xs)
    full = F.slice(rights, lit(1), F.greatest(n - 1, lit(0)))
    flush = spread(body) <= 1.0
    justified = flush & (n >= 3) & (spread(full) <= 1.5) & (F.element_at(rights, -1) <= F.array_max(full) + 1.5)
    left_edge, right_edge = F.array_min(lefts), F.array_max(rights)
    centred = F.forall(lines, lambda b: F.abs((b.x0 - left_edge) - (right_edge - b.x1)) <= 2.0)
    margin = first.x0 - container.x0
    alone = (container.x1 > container.x0) & (F.abs(margin - (container.x1 - first.x1)) <= 2.0) & (margin > 0.5)
    return (
        F.when(n == 0, "left")
        .when(n == 1, F.when(F.coalesce(alone, lit(False)), "center").otherwise("left"))
        .when(justified, "justify").when(flush, "left").when(centred, "center")
        .when(spread(rights) <= 1.0, "right").otherwise("left")
    )


def fit_within(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """struct(width, height) scaled down, never up, to fit."""
    scale = F.least(lit(1.0), max_width / width, max_height / height)
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"))


#: Least and greatest line height in em; the least also where nothing can be measured. Fixed values.
LINE_HEIGHTS = (1.15, 1.40)


def line_pitch(boxes: Column, font_size: Column) -> Column:
    """Line height in em: the median distance of the tops of following lines by the font size, within bounds."""
    tops = F.array_sort(F.transform(boxes, lambda b: b.y0))
    steps = F.array_sort(F.filter(F.transform(F.sequence(lit(1), F.greatest(F.size(tops) - 1, lit(1))), lambda i: F.get(tops, i) - F.get(tops, i - 1)), lambda d: d > 0))
    n = F.size(steps)
    middle = (F.get(steps, F.floor((n - 1) / 2).cast("int")) + F.get(steps, F.floor(n / 2).cast("int"))) / 2
    known = (font_size > 0) & (F.size(boxes) >= 2) & (n > 0)
    return F.when(known, F.least(lit(LINE_HEIGHTS[1]), F.greatest(lit(LINE_HEIGHTS[0]), F.round(middle / font_size, 3)))).otherwise(LINE_HEIGHTS[0])
