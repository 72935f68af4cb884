"""Boxes as struct(l, t, r, b) of doubles in page points, from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the layout: where the header's columns part, the group row's offset, the header band where no border is found.
COLUMN_SPLIT_X = 400.0
GROUP_ROW_OFFSET = 2.0
BAND_FALLBACK = {"top": 58.0, "bottom": 148.0, "left": 38.0, "right": 574.0}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box from two corners in any order."""
    return F.struct(F.least(left, right).alias("l"), F.least(top, bottom).alias("t"), F.greatest(left, right).alias("r"), F.greatest(top, bottom).alias("b"))


def word_box(word: Column) -> Column:
    return F.struct(word["x0"].alias("l"), word["top"].alias("t"), word["x1"].alias("r"), word["bottom"].alias("b"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area; boxes that only touch do not."""
    return (a["l"] < b["r"]) & (b["l"] < a["r"]) & (a["t"] < b["b"]) & (b["t"] < a["b"])


def covered(one: Column, boxes: Column | str) -> Column:
    """Whether a box meets any of an array of boxes."""
    return F.exists(_col(boxes), lambda other: overlaps(one, other))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def header_boxes(band: Column | str, group_top: Column | str) -> Column:
    """What hides a header: its left column over the full height, and the group row over the full width."""
    a = _col(band)
    strip = clamp(_col(group_top) + GROUP_ROW_OFFSET, a["t"], a["b"])
    return F.array(
        F.struct(a["l"].alias("l"), a["t"].alias("t"), F.least(F.lit(COLUMN_SPLIT_X), a["r"]).alias("r"), a["b"].alias("b")),
        F.struct(a["l"].alias("l"), strip.alias("t"), a["r"].alias("r"), a["b"].alias("b")),
    )


def union_box(boxes: Column | str) -> Column:
    """The smallest box that holds all boxes of an array; null for none."""
    a = _col(boxes)
    lows = [F.array_min(a[k]).alias(k) for k in ("l", "t")]
    highs = [F.array_max(a[k]).alias(k) for k in ("r", "b")]
    return F.when(F.size(a) > 0, F.struct(*lows, *highs))


def gap(a: Column, b: Column) -> Column:
    """The smallest positive distance of two boxes along an axis; 0 if there is none."""
    sides = F.array(a["l"] - b["r"], b["l"] - a["r"], a["t"] - b["b"], b["t"] - a["b"])
    return F.coalesce(F.array_min(F.filter(sides, lambda d: d > 0)), F.lit(0.0))


def from_canvas(rect: Column | str) -> Column:
    """A drawn rectangle (left, top, width, height, scaleX, scaleY; any may be null) as a box."""
    r = _col(rect)
    number = lambda name, default: F.coalesce(r[name], F.lit(default))
    left, top = number("left", 0.0), number("top", 0.0)
    return box(left, top, left + number("width", 0.0) * number("scaleX", 1.0), top + number("height", 0.0) * number("scaleY", 1.0))


def to_canvas(one: Column | str) -> Column:
    a = _col(one)
    return F.struct(a["l"].alias("left"), a["t"].alias("top"), (a["r"] - a["l"]).alias("width"), (a["b"] - a["t"]).alias("height"), F.lit(1.0).alias("scaleX"), F.lit(1.0).alias("scaleY"))


def scaled(one: Column | str, factor: Column) -> Column:
    """A box in other units, such as pixels (dpi / 72) or back."""
    a = _col(one)
    return F.struct(*[(a[k] * factor).alias(k) for k in ("l", "t", "r", "b")])


def editor_dpi(page_width: Column | str, target_px: int = 700) -> Column:
    """The resolution at which a page has about the wanted width, between 72 and 300; halves round to even."""
    return clamp(F.bround(F.lit(float(target_px)) * 72 / _col(page_width)).cast("int"), F.lit(72), F.lit(300))


def upright(current: Column | str, angle: Column | str) -> Column:
    """The rotation that is left after turning by an angle, from 0 to 359."""
    return F.pmod(_col(current) - _col(angle), F.lit(360))


def font_size(height: Column | str) -> Column:
    return F.greatest(F.lit(4.0), _col(height))


def baseline(page_height: Column | str, top: Column | str, size: Column | str) -> Column:
    """The baseline of hidden text from the bottom of the page."""
    return _col(page_height) - _col(top) - _col(size) * 0.8


def advance_width(text: Column | str, size: Column | str, widths: Column) -> Column:
    """The width of a text from a map of character widths in thousandths of the size; unknown characters count 556."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0), lambda n, c: n + F.coalesce(F.try_element_at(widths, c), F.lit(556)))
    return total * _col(size) / 1000.0


def horizontal_scale(box_width: Column | str, natural: Column | str) -> Column:
    """How far a text is stretched to fill its box, between 0.05 and 20; 1 if it has no width."""
    return F.when(_col(natural) <= 0, F.lit(1.0)).otherwise(clamp(_col(box_width) / _col(natural), F.lit(0.05), F.lit(20.0)))


#: The advance widths of Helvetica for U+0020 to U+007E in thousandths of the size (Adobe's public font metrics).
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]


def helvetica_widths() -> Column:
    """The widths as a map from character to number."""
    return F.create_map(*[F.lit(v) for k, w in enumerate(HELVETICA) for v in (chr(32 + k), w)])
