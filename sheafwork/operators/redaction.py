"""What hides a header, what of a page's text stays, and which words no box covers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.operators import segmentation as S
from sheafwork.session import bound_batches, join_heavy, ship_package

# Fixed values of border detection: grey values below this are ink; the share of a line that must be ink; search margins in points.
DARK_BELOW = 128
LINE_SHARE = 0.4
SIDE_SLACK = 25
CORNER_WINDOW = 3
CORNER_SLACK = 8
TOP_SLACK = 15
BOTTOM_BACK_SLACK = 5
BOTTOM_FORWARD_SLACK = 15
# Fixed values of the stamp on a hidden header, in points.
STAMP_SIZE = 22.0
STAMP_PADDING = 8.0
STAMP_SPACING = 4.0
#: Fixed value: the share of dark points from which a region holds ink.
INK_SHARE = 0.01


@dataclass(frozen=True)
class Search:
    """Where a page's border is looked for, in points: two spans of the upper and lower rule, one of the sides, and the box without any."""

    upper: tuple[float, float]
    lower: tuple[float, float]
    sides: tuple[float, float]
    guess: tuple[float, float, float, float]

    @classmethod
    def by_layout(cls) -> Search:
        """For a page whose labels were not read: the layout's band and some slack."""
        band = G.BAND_FALLBACK
        span = band["top"] - CORNER_SLACK, band["bottom"] + CORNER_SLACK
        return cls(span, span, (band["top"], band["bottom"]), tuple(band[k] for k in ("left", "top", "right", "bottom")))

    @classmethod
    def by_labels(cls, name_top: float, group_end: float) -> Search:
        """For a page with labels: the border begins at the name row and ends below the group row."""
        band = G.BAND_FALLBACK
        upper, lower = (name_top - TOP_SLACK, name_top + TOP_SLACK), (group_end - BOTTOM_BACK_SLACK, group_end + BOTTOM_FORWARD_SLACK)
        return cls(upper, lower, (min(band["top"], upper[0]), max(band["bottom"], lower[1])), (band["left"], name_top, band["right"], group_end))


class Ink:
    """A raster's dark points, asked in points for the first or last line in which enough of them lie."""

    def __init__(self, grey: np.ndarray, dpi: float):
        self.dark, self.unit = grey < DARK_BELOW, dpi / 72

    def _cut(self, span: tuple[float, float], axis: int) -> slice:
        low, high = (min(max(round(x * self.unit), 0), self.dark.shape[axis]) for x in span)
        return slice(low, max(low, high))

    def _lines(self, region: np.ndarray, axis: int) -> np.ndarray:
        return np.flatnonzero(region.mean(axis=axis) >= LINE_SHARE) if region.size else np.zeros(0, int)

    def sides(self, across: tuple[float, float], down: tuple[float, float]) -> list[int]:
        """The first and the last dark column, as numbers of the raster; none without one."""
        cut = self._cut(across, 1)
        found = cut.start + self._lines(self.dark[self._cut(down, 0), cut], 0)
        return [int(found[0]), int(found[-1])] if len(found) else []

    def rules(self, column: int, down: tuple[float, float]) -> np.ndarray:
        """The places, in points, of the rows that are dark beside a column: a tilted rule crosses it at one place of its own."""
        reach, cut = max(1, round(CORNER_WINDOW * self.unit)), self._cut(down, 0)
        beside = slice(max(0, column - reach), column + reach + 1)
        return (cut.start + self._lines(self.dark[cut, beside], 1)) / self.unit


def detect_band(grey: np.ndarray, dpi: float, name_top: float | None, group_top: float | None, row_height: float, anchored: bool) -> tuple[float, float, float, float, bool]:
    """(left, top, right, bottom, detected) of the printed border around the header, in points.

    Columns dark enough over the searched height give the sides, and the rules are read off beside each side, so that the box encloses
    a tilted border. A missing edge takes the place that is guessed. A page without labels is never hidden less than the layout's band
    does, whatever was detected: a stray line must not uncover a name.
    """
    layout = G.BAND_FALLBACK
    if anchored:
        search = Search.by_labels(layout["top"] if name_top is None else name_top, layout["bottom"] if group_top is None else group_top + row_height)
    else:
        search = Search.by_layout()
    ink = Ink(grey, dpi)
    sides = ink.sides((layout["left"] - SIDE_SLACK, layout["right"] + SIDE_SLACK), search.sides)
    upper = [rows[0] for rows in (ink.rules(column, search.upper) for column in sides) if len(rows)]
    lower = [rows[-1] for rows in (ink.rules(column, search.lower) for column in sides) if len(rows)]
    found = [column / ink.unit for column in sides] or [None, None]
    edges = found[0], min(upper, default=None), found[1], max(lower, default=None)
    box = tuple(float(guess if edge is None else edge) for edge, guess in zip(edges, search.guess, strict=True))
    if not anchored:
        box = tuple(outer(edge, floor) for outer, edge, floor in zip((min, min, max, max), box, search.guess, strict=True))
    return (*box, None not in edges)


def detect_bands(rasters: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file_id, page_idx, band, detected) from ``rasters(file_id, page_idx, grey, n_rows, n_cols, dpi)`` of header pages."""
    ship_package(rasters.sparkSession)
    bound_batches(rasters.sparkSession)
    found = anchors.select("file_id", "page_idx", "name_top", "group_top", "row_height", (F.col("name_found") | F.col("teacher_found") | F.col("group_found")).alias("anchored"))
    rows = join_heavy(rasters, found, ["file_id", "page_idx"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.n_rows, r.n_cols)
                known = bool(r.anchored) if r.anchored is not None and r.anchored == r.anchored else False
                left, top, right, bottom, found = detect_band(grey, r.dpi, r.name_top, r.group_top, r.row_height, known)
                out.append((r.file_id, r.page_idx, left, top, right, bottom, found))
            yield pd.DataFrame(out, columns=["file_id", "page_idx", "l", "t", "r", "b", "detected"])

    columns = rows.select("file_id", "page_idx", "grey", "n_rows", "n_cols", "dpi", "name_top", "group_top", "row_height", "anchored")
    found = columns.mapInPandas(run, "file_id string, page_idx int, l double, t double, r double, b double, detected boolean")
    return found.select("file_id", "page_idx", F.struct("l", "t", "r", "b").alias("band"), "detected")


def plan_boxes(bands: DataFrame, anchors: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(file_id, page_idx, band, detected, boxes, source): a reviewer's boxes where ``manual(file_id, page_idx, boxes)`` has them."""
    rows = bands.join(anchors.select("file_id", "page_idx", "group_top"), ["file_id", "page_idx"], "left")
    rows = rows.withColumn("auto", G.header_boxes("band", F.coalesce("group_top", F.lit(S.ANCHOR_FALLBACK["group"]))))
    if manual is None:
        return rows.select("file_id", "page_idx", "band", "detected", F.col("auto").alias("boxes"), F.lit("auto").alias("source"))
    drawn = manual.select("file_id", "page_idx", F.transform("boxes", lambda x: G.box(x["l"], x["t"], x["r"], x["b"])).alias("drawn"))
    rows = rows.join(drawn, ["file_id", "page_idx"], "full")
    is_drawn = F.col("drawn").isNotNull()
    band = F.when(is_drawn, G.union_box("drawn")).otherwise(F.col("band"))
    return rows.select(
        "file_id", "page_idx", band.alias("band"), (is_drawn | F.coalesce("detected", F.lit(False))).alias("detected"), F.coalesce("drawn", "auto").alias("boxes"), F.when(is_drawn, "manual").otherwise("auto").alias("source")
    )


def _hidden(word: Column, boxes: Column | str) -> Column:
    return F.coalesce(G.covered(word, boxes), F.lit(False))


def kept_words(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """The words that no box of their page meets: the text layer of the published page. ``boxes(file_id, page_idx, boxes)``."""
    box = F.struct(F.col("x0").alias("l"), F.col("top").alias("t"), F.col("x1").alias("r"), F.col("bottom").alias("b"))
    joined = words.join(boxes.select("file_id", "page_idx", "boxes"), ["file_id", "page_idx"], "left")
    return joined.where(~_hidden(box, "boxes")).drop("boxes")


def uncovered_group_words(words: DataFrame, plan: DataFrame, anchors: DataFrame) -> DataFrame:
    """Written words of the group row that no box covers: for a reviewer's attention, never a reason to hold a packet."""
    rows = S.row_words(words, anchors, plan).where("row = 'group'").where(~S.X.normalize_word("text").isin(S.LABEL_WORDS["group"]))
    return kept_words(rows.select(*words.columns), plan)


def uncovered_regions(flagged: DataFrame, drawn: DataFrame) -> DataFrame:
    """Flagged regions that no drawn region of the same page meets. Both: (file_id, page_idx, box)."""
    per_page = drawn.groupBy("file_id", "page_idx").agg(F.collect_list("box").alias("boxes"))
    return flagged.join(per_page, ["file_id", "page_idx"], "left").where(~_hidden(F.col("box"), "boxes")).drop("boxes")


def header_geometry(bands: DataFrame, words: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file_id, page_idx, detected, n_uncovered) without writing anything."""
    plan = plan_boxes(bands, anchors)
    left = uncovered_group_words(words, plan, anchors).groupBy("file_id", "page_idx").agg(F.count("*").alias("n_uncovered"))
    return plan.select("file_id", "page_idx", "detected").join(left, ["file_id", "page_idx"], "left").na.fill(0, ["n_uncovered"])


def seed_regions(packets: DataFrame, plan: DataFrame, flagged: DataFrame) -> DataFrame:
    """What a reviewer's editor starts from: (file_id, packet_index, offset, box), the planned boxes and then the flagged ones."""
    places = S.page_places(packets)
    planned = places.join(plan.select("file_id", "page_idx", F.explode("boxes").alias("box")), ["file_id", "page_idx"]).withColumn("kind", F.lit("auto"))
    marked = places.join(flagged.select("file_id", "page_idx", "box"), ["file_id", "page_idx"]).withColumn("kind", F.lit("flagged"))
    return planned.unionByName(marked).select("file_id", "packet_index", "offset", "kind", "box")


def text_operators(words: DataFrame, page_height: Column) -> DataFrame:
    """Each kept word as the operators of a hidden text layer: size, baseline, horizontal scale and escaped text."""
    size = G.font_size(F.col("bottom") - F.col("top"))
    rows = words.withColumn("size", size)
    natural = G.advance_width("text", "size", G.helvetica_widths())
    scale = G.horizontal_scale(F.greatest(F.col("x1") - F.col("x0"), F.lit(0.01)), natural)
    rows = rows.withColumns({"scale": scale, "baseline": G.baseline(page_height, "top", "size")})
    from sheafwork.functions.text import pdf_escaped

    shown = F.format_string("BT 3 Tr /F1 %.2f Tf %.4f 0 0 1 %.2f %.2f Tm (%s ) Tj ET", "size", "scale", "x0", "baseline", pdf_escaped("text"))
    return rows.withColumn("operator", shown)


def mark_operators(headers: DataFrame) -> DataFrame:
    """(file_id, page_idx, word_seq, operator): black boxes over each header, and white lines from the first box's upper left corner.

    ``headers(file_id, page_idx, boxes, lines, height)``; places come before those of words, so that marks are drawn first.
    """
    area = lambda b: F.format_string("q 0 g %.2f %.2f %.2f %.2f re f Q", b["l"], F.col("height") - b["b"], b["r"] - b["l"], b["b"] - b["t"])
    boxes = headers.select("file_id", "page_idx", F.posexplode(F.transform("boxes", area)).alias("k", "operator"))
    from sheafwork.functions.text import pdf_escaped

    first = F.get("boxes", 0)
    lines = headers.select("file_id", "page_idx", "height", first.alias("b"), F.posexplode("lines").alias("k", "line"))
    x, y = F.col("b.l") + STAMP_PADDING, F.col("height") - F.col("b.t") - STAMP_PADDING - (F.col("k") + 1) * STAMP_SIZE - F.col("k") * STAMP_SPACING
    shown = F.format_string("BT 0 Tr 1 g /F1 %.2f Tf 1.0000 0 0 1 %.2f %.2f Tm (%s ) Tj ET", F.lit(STAMP_SIZE), x, y, pdf_escaped("line"))
    stamps = lines.select("file_id", "page_idx", "k", shown.alias("operator"))
    place = lambda rows, least: rows.select("file_id", "page_idx", (F.col("k") + least).alias("word_seq"), "operator")
    return place(boxes, -2000).unionByName(place(stamps, -1000))


def draw_boxes(grey: np.ndarray, boxes: list[tuple[float, float, float, float]], dpi: float) -> np.ndarray:
    """A copy of a page's raster with black boxes; edges are rounded outwards."""
    out, unit = grey.copy(), dpi / 72
    for left, top, right, bottom in boxes:
        out[max(0, int(np.floor(top * unit))) : int(np.ceil(bottom * unit)), max(0, int(np.floor(left * unit))) : int(np.ceil(right * unit))] = 0
    return out


def redacted_rasters(rasters: DataFrame, plan: DataFrame) -> DataFrame:
    """(file_id, page_idx, grey, n_rows, n_cols) with the boxes of ``plan(file_id, page_idx, boxes)`` drawn; other pages as they are."""
    ship_package(rasters.sparkSession)
    bound_batches(rasters.sparkSession)
    pages = rasters.select("file_id", "page_idx", "grey", "n_rows", "n_cols", "dpi")
    rows = join_heavy(pages, plan.select("file_id", "page_idx", "boxes"), ["file_id", "page_idx"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = []
            for r in batch.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.n_rows, r.n_cols)
                drawn.append(r.grey if r.boxes is None else draw_boxes(grey, [(b["l"], b["t"], b["r"], b["b"]) for b in r.boxes], r.dpi).tobytes())
            yield pd.DataFrame({"file_id": batch["file_id"], "page_idx": batch["page_idx"], "grey": drawn, "n_rows": batch["n_rows"], "n_cols": batch["n_cols"]})

    return rows.mapInPandas(run, "file_id string, page_idx int, grey binary, n_rows int, n_cols int")


def ink_share(grey: np.ndarray, box: tuple[float, float, float, float], dpi: float) -> float:
    """The share of dark points in a region; 0 for an empty one."""
    unit = dpi / 72
    part = grey[max(0, round(box[1] * unit)) : max(0, round(box[3] * unit)), max(0, round(box[0] * unit)) : max(0, round(box[2] * unit))]
    return float((part < DARK_BELOW).mean()) if part.size else 0.0


def ink_in_regions(rasters: DataFrame, regions: DataFrame) -> DataFrame:
    """(file_id, page_idx, box, share, has_ink) for ``regions(file_id, page_idx, box)``."""
    ship_package(rasters.sparkSession)
    bound_batches(rasters.sparkSession)
    pages = rasters.select("file_id", "page_idx", "grey", "n_rows", "n_cols", "dpi")
    rows = join_heavy(pages, regions.groupBy("file_id", "page_idx").agg(F.collect_list("box").alias("boxes")), ["file_id", "page_idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.n_rows, r.n_cols)
                for b in r.boxes:
                    out.append((r.file_id, r.page_idx, b["l"], b["t"], b["r"], b["b"], ink_share(grey, (b["l"], b["t"], b["r"], b["b"]), r.dpi)))
            yield pd.DataFrame(out, columns=["file_id", "page_idx", "l", "t", "r", "b", "share"])

    schema = "file_id string, page_idx int, l double, t double, r double, b double, share double"
    found = rows.select("file_id", "page_idx", "grey", "n_rows", "n_cols", "dpi", "boxes").mapInPandas(run, schema)
    return found.select("file_id", "page_idx", F.struct("l", "t", "r", "b").alias("box"), "share", (F.col("share") >= INK_SHARE).alias("has_ink"))
