"""Page orientation: detections, human overrides, and the angle that is applied.

``detections(file_id, page_idx, angle, score, skew)``, ``overrides(file_id, page_idx, angle)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.session import bound_batches, ship_package

#: The least score of a trusted detection, the largest tolerated skew in degrees.
LEAST_SCORE = 0.6
MOST_SKEW = 3.0
#: Angles beyond this are not taken for a skewed line.
MOST_LINE_ANGLE = 20.0


def resolve(detections: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds confident, applied_angle, source, needs_confirmation, resolved and rotated.

    A human's angle wins; a confident upright page is taken as it is; a confident rotation waits for a human; else nothing is known.
    """
    rows = detections
    if overrides is None:
        rows = rows.withColumn("human", F.lit(None).cast("int"))
    else:
        rows = rows.join(overrides.select("file_id", "page_idx", F.col("angle").cast("int").alias("human")), ["file_id", "page_idx"], "left")
    sure = (F.col("score") >= LEAST_SCORE) & (F.coalesce(F.abs("skew"), F.lit(0.0)) <= MOST_SKEW)
    rows = rows.withColumn("confident", F.coalesce(sure, F.lit(False)))
    human = F.col("human").isNotNull()
    upright = F.col("confident") & (F.col("angle") == 0)
    rows = rows.withColumns(
        {
            "applied_angle": F.when(human, F.col("human")).when(upright, 0),
            "source": F.when(human, "human").when(upright, "auto").otherwise("none"),
            "needs_confirmation": ~human & F.col("confident") & (F.col("angle") != 0),
        }
    )
    return rows.withColumns({"resolved": F.col("applied_angle").isNotNull(), "rotated": F.coalesce(F.col("applied_angle") != 0, F.lit(False))}).drop("human")


def flags(resolved: DataFrame) -> DataFrame:
    """(file_id, page_idx, angle, status): pages that hold their packet, ``pending`` a human's word or ``unresolved``."""
    status = F.when(F.col("needs_confirmation"), "pending").when(~F.col("resolved"), "unresolved")
    return resolved.select("file_id", "page_idx", "angle", status.alias("status")).where("status IS NOT NULL")


def located_flags(resolved: DataFrame, places: DataFrame) -> DataFrame:
    """Flags with the packet and the place in it, from ``places(file_id, packet_index, page_idx, offset)``; null if in none."""
    return flags(resolved).join(places, ["file_id", "page_idx"], "left")


def turned(resolved: DataFrame, rotation: Column | str = "rotation") -> DataFrame:
    """Adds the page's /Rotate entry after the applied angle."""
    return resolved.withColumn("rotate", G.upright(rotation, F.coalesce("applied_angle", F.lit(0))))


def overrides_fingerprint(overrides: DataFrame) -> DataFrame:
    """(file_id, fingerprint): equal for equal sets of overrides, whatever their order."""
    entry = F.format_string("%d:%d", F.col("page_idx").cast("int"), F.col("angle").cast("int"))
    return overrides.groupBy("file_id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(entry)), ",").cast("binary")).alias("fingerprint"))


def cache_key(content_sha: Column | str, page_idx: Column | str, applied_angle: Column | str) -> Column:
    """The identity of a page for cached results: it does not change when another page is turned."""
    short = F.substring(F.col(content_sha) if isinstance(content_sha, str) else content_sha, 1, 16)
    angle = F.coalesce(F.col(applied_angle) if isinstance(applied_angle, str) else applied_angle, F.lit(0))
    return F.concat_ws("/", short, (F.col(page_idx) if isinstance(page_idx, str) else page_idx).cast("string"), angle.cast("string"))


def commit_rotation(overrides: DataFrame, file_id: str, page_idx: int, angle: int | None) -> DataFrame:
    """The overrides with one page's angle set, or forgotten for None."""
    rest = overrides.where(~((F.col("file_id") == file_id) & (F.col("page_idx") == page_idx)))
    if angle is None:
        return rest
    row = overrides.sparkSession.range(1).select(F.lit(file_id).alias("file_id"), F.lit(page_idx).alias("page_idx"), F.lit(angle % 360).alias("angle"))
    return rest.select("file_id", "page_idx", "angle").unionByName(row)


def rotate(grey: np.ndarray, angle: int) -> np.ndarray:
    """A raster turned back by a detected angle."""
    return np.rot90(grey, k=(angle // 90) % 4)


def estimate_skew(grey: np.ndarray, dark_below: int = 128, step: float = 0.25) -> float | None:
    """The angle in degrees at which rows of ink are sharpest, within MOST_LINE_ANGLE; None for a page without ink.

    Dark points are projected along each angle; text lines and rules that lie along it make the projection's variance largest. Of equally
    sharp angles, which a narrow raster has, the least is taken.
    """
    y, x = np.nonzero(grey < dark_below)
    if len(y) < 50:
        return None
    angles = np.arange(-MOST_LINE_ANGLE, MOST_LINE_ANGLE + step / 2, step)
    best = []
    for a in np.deg2rad(angles):
        place = np.round(y * np.cos(a) - x * np.sin(a)).astype(np.int64)
        best.append(np.bincount(place - place.min()).astype(float).var())
    sharpest = angles[np.asarray(best) == max(best)]
    return float(sharpest[np.argmin(np.abs(sharpest))])


Classifier = Callable[[np.ndarray], tuple[int, float]]


def detect(rasters: DataFrame, make_classifier: Callable[[], Classifier]) -> DataFrame:
    """Detections of ``rasters(file_id, page_idx, grey, n_rows, n_cols)``; the classifier is made once a worker batch stream."""
    ship_package(rasters.sparkSession)
    bound_batches(rasters.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = make_classifier()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                grey = np.frombuffer(r.grey, np.uint8).reshape(r.n_rows, r.n_cols)
                angle, score = classify(grey)
                out.append((r.file_id, r.page_idx, int(angle), float(score), estimate_skew(rotate(grey, angle))))
            yield pd.DataFrame(out, columns=["file_id", "page_idx", "angle", "score", "skew"])

    return rasters.select("file_id", "page_idx", "grey", "n_rows", "n_cols").mapInPandas(run, "file_id string, page_idx int, angle int, score double, skew double")


def cached(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results for wanted, new cache): only rows of ``wanted`` whose keys the cache lacks are computed. Serves OCR words as well."""
    misses = compute(wanted.join(cache.select(*keys).distinct(), keys, "left_anti"))
    whole = cache.unionByName(misses.select(*cache.columns))
    return whole.join(wanted.select(*keys).distinct(), keys, "left_semi"), whole
