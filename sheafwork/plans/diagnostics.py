"""Read-only diagnostics: contact sheets, hold evidence, ink on second pages, and what a reviewer may choose."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.operators import redaction as R
from sheafwork.session import join_heavy, ship_package
from sheafwork.sources.png import grey_png, outlined, shrunk

# The printed title's first word, the name region above it in points, and where the title stands if it is not found.
TITLE_WORD = "plausibil"
NAME_REGION_LEFT, NAME_REGION_RIGHT = 15.0, 250.0
TITLE_FALLBACK_TOP, TITLE_SLACK = 35.04, 3.0

#: Options offered to a reviewer before all others are left out.
OPTIONS = 5


def contact_sheets(rasters: DataFrame, reasons: DataFrame, thumb_width: int = 360, columns: int = 4) -> DataFrame:
    """(file_id, pages, labels, png): the flagged pages of each file as thumbnails in page order; no row for a file without any.

    ``rasters(file_id, page_idx, grey, n_rows, n_cols)``, ``reasons(file_id, page_idx, reasons)``. The labels also stand in the image's text chunk.
    """
    ship_package(rasters.sparkSession)
    rows = join_heavy(rasters, reasons, ["file_id", "page_idx"]).select("file_id", "page_idx", "grey", "n_rows", "n_cols", F.array_join("reasons", "; ").alias("label"))

    def sheet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page_idx")
        thumbs = [shrunk(np.frombuffer(r.grey, np.uint8).reshape(int(r.n_rows), int(r.n_cols)), thumb_width) for r in group.itertuples()]
        cell = max(len(t) for t in thumbs) + 8
        out = np.full((cell * -(-len(thumbs) // columns), thumb_width * columns), 255, np.uint8)
        for k, thumb in enumerate(thumbs):
            y, x = k // columns * cell, k % columns * thumb_width
            out[y : y + len(thumb), x : x + thumb_width] = thumb
        labels = [f"page {p}: {label}" for p, label in zip(group["page_idx"], group["label"], strict=True)]
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "pages": [group["page_idx"].tolist()], "labels": [labels], "png": [grey_png(out, "\n".join(labels))]})

    return rows.groupBy("file_id").applyInPandas(sheet, "file_id string, pages array<int>, labels array<string>, png binary")


def evidence_image(grey: np.ndarray, dpi: float, band: tuple[float, float, float, float], boxes: list[tuple[float, float, float, float]]) -> bytes:
    """The header of a page with its band and boxes outlined, cut 40 points below the lowest of them."""
    bottom = max([band[3], *(b[3] for b in boxes)]) + 40
    return grey_png(outlined(grey, [band, *boxes], dpi)[: max(1, round(bottom * dpi / 72))])


def hold_reason(detected: Column | str, n_uncovered: Column | str, n_findings: Column | str) -> Column:
    """Why a dry run would hold a packet, the first that applies: ``detection``, ``uncovered_ink``, ``leak``, else ``clean``."""
    found, open_words, leaks = (F.col(c) if isinstance(c, str) else c for c in (detected, n_uncovered, n_findings))
    return F.when(~F.coalesce(found, F.lit(False)), "detection").when(F.coalesce(open_words, F.lit(0)) > 0, "uncovered_ink").when(F.coalesce(leaks, F.lit(0)) > 0, "leak").otherwise("clean")


def word_evidence(uncovered: DataFrame, plan: DataFrame) -> DataFrame:
    """Each uncovered word with its gap to the header's left box and strip, and its distance below the band."""
    box = F.struct(F.col("x0").alias("l"), F.col("top").alias("t"), F.col("x1").alias("r"), F.col("bottom").alias("b"))
    rows = uncovered.join(plan.select("file_id", "page_idx", "band", "boxes"), ["file_id", "page_idx"])
    left, strip = (G.gap(F.get("boxes", k), box) for k in (0, 1))
    return rows.select(*uncovered.columns, left.alias("gap_left"), strip.alias("gap_strip"), (F.col("top") - F.col("band.b")).alias("below_band"))


def diagnose(packets: DataFrame, geometry: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, tag, label, hold_reason) of packets with a header page.

    ``packets(file_id, tag, header_page, label)``, ``geometry(file_id, page_idx, detected, n_uncovered)``, ``findings(tag)``.
    """
    heads = packets.where("header_page IS NOT NULL").join(geometry.withColumnRenamed("page_idx", "header_page"), ["file_id", "header_page"], "left")
    counts = findings.groupBy("tag").agg(F.count("*").alias("n_findings"))
    rows = heads.join(counts, "tag", "left")
    return rows.select("file_id", "tag", F.coalesce("label", F.lit("undated")).alias("label"), hold_reason("detected", "n_uncovered", "n_findings").alias("hold_reason"))


def name_regions(packets: DataFrame, words: DataFrame) -> DataFrame:
    """(file_id, tag, page_idx, title_found, box): the region above the printed title of each packet's second page."""
    second = packets.where(F.size("page_indices") >= 2).select("file_id", "tag", F.get("page_indices", 1).alias("page_idx"))
    title = words.where((F.col("top") <= 188) & F.startswith(F.lower("text"), F.lit(TITLE_WORD))).groupBy("file_id", "page_idx").agg(F.min("top").alias("title_top"))
    rows = second.join(title, ["file_id", "page_idx"], "left")
    bottom = F.coalesce("title_top", F.lit(TITLE_FALLBACK_TOP)) - TITLE_SLACK
    box = F.struct(F.lit(NAME_REGION_LEFT).alias("l"), F.lit(0.0).alias("t"), F.lit(NAME_REGION_RIGHT).alias("r"), bottom.alias("b"))
    return rows.select("file_id", "tag", "page_idx", F.col("title_top").isNotNull().alias("title_found"), box.alias("box"))


def second_page_ink(packets: DataFrame, words: DataFrame, rasters: DataFrame) -> DataFrame:
    """name_regions with the share of dark points and whether that is ink."""
    regions = name_regions(packets, words)
    return regions.join(R.ink_in_regions(rasters, regions).drop("box"), ["file_id", "page_idx"])


def exposures(ink: DataFrame, findings: DataFrame) -> DataFrame:
    """Published second pages with ink: how many findings verification has there, and whether the page went unnoticed."""
    counts = findings.groupBy("file_id", "page_idx").agg(F.count("*").alias("n_findings"))
    rows = ink.join(counts, ["file_id", "page_idx"], "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return rows.withColumn("unnoticed", F.col("has_ink") & (F.col("n_findings") == 0))


def decision_options(packets: DataFrame, candidates: DataFrame, decisions: DataFrame, searched: DataFrame) -> DataFrame:
    """What a reviewer may choose for each packet, and what is chosen at first.

    ``packets(tag, name_text, auto_sid)``, ``candidates(tag, sid, rank)``, ``decisions(tag, sid)``, ``searched(tag, sid)``. Options are the best
    candidates, then a searched and a recorded entry if they are not among them, then null for "not on the roster". ``chosen`` is a recorded
    decision, else a searched entry, else the automatic one; ``open`` says that nothing was read, decided or searched, so nothing is chosen.
    """
    best = candidates.where(F.col("rank") <= OPTIONS).groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("rank", "sid"))).alias("best"))
    rows = packets.join(best, "tag", "left").join(searched.select("tag", F.col("sid").alias("searched")), "tag", "left")
    rows = rows.join(decisions.select("tag", F.col("sid").alias("recorded"), F.lit(True).alias("decided")), "tag", "left")
    first = F.coalesce(F.transform("best", lambda x: x["sid"]), F.array().cast("array<string>"))
    more = F.array_compact(F.array("searched", "recorded"))
    options = F.concat(first, F.array_except(F.array_distinct(more), first), F.array(F.lit(None).cast("string")))
    decided = F.coalesce("decided", F.lit(False))
    nothing = (F.coalesce("name_text", F.lit("")) == "") & ~decided & F.col("searched").isNull()
    chosen = F.when(nothing, F.lit(None)).when(decided, F.col("recorded")).otherwise(F.coalesce("searched", "auto_sid"))
    return rows.select("tag", options.alias("options"), chosen.alias("chosen"), nothing.alias("open"))


def icon(blocked: Column | str, decided: Column | str, sid: Column | str) -> Column:
    """A packet's state in a list: blocked, open, rejected or matched."""
    b, d, s = (F.col(c) if isinstance(c, str) else c for c in (blocked, decided, sid))
    return F.when(~d & b, "blocked").when(~d, "open").when(s.isNull(), "rejected").otherwise("matched")
