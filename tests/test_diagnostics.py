import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.operators import redaction as R
from sheafwork.plans import diagnostics as P
from sheafwork.sources import documents as D
from sheafwork.sources.png import grey_png, outlined, shrunk


def pixels(png):
    """Samples of a grey PNG without row filters."""
    width, height = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    at, data = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def rasters(spark, *pages):
    return spark.createDataFrame([("f", k, bytearray(g.tobytes()), *g.shape, 72.0) for k, g in pages], "file_id string, page_idx int, grey binary, n_rows int, n_cols int, dpi double")


def test_contact_sheet_shows_flagged_pages_only(spark):
    pages = rasters(spark, *((k, np.full((20, 10), 40 * k, np.uint8)) for k in range(4)))
    reasons = spark.createDataFrame([("f", 3, ["b", "c"]), ("f", 1, ["a"])], "file_id string, page_idx int, reasons array<string>")
    found = P.contact_sheets(pages, reasons, thumb_width=10, columns=2).first()
    assert found["labels"] == ["page 1: a", "page 3: b; c"]
    sheet = pixels(bytes(found["png"]))
    assert sheet.shape == (28, 20) and sheet[5, 5] == 40 and sheet[5, 15] == 120 and sheet[25, 5] == 255
    assert P.contact_sheets(pages, reasons.where("false")).count() == 0


def test_images():
    grey = np.arange(200, dtype=np.uint8).reshape(20, 10)
    assert (pixels(grey_png(grey, "note")) == grey).all()
    assert shrunk(grey, 5).shape == (10, 5)
    assert outlined(np.zeros((50, 50), np.uint8), [(10, 10, 30, 30)], 72)[10, 20] == 128
    assert pixels(P.evidence_image(np.zeros((200, 50), np.uint8), 72, (5, 5, 40, 20), [(5, 5, 40, 60)])).shape == (100, 50)


def test_second_page_ink_and_exposure(spark):
    clean, inked = np.full((792, 612), 255, np.uint8), np.full((792, 612), 255, np.uint8)
    inked[5:25, 100:200] = 0
    packets = spark.createDataFrame([("f", "a", [0, 1]), ("f", "b", [2, 3]), ("f", "c", [4])], "file_id string, tag string, page_indices array<int>")
    words = spark.createDataFrame([("f", 1, 0, "Plausibility", 40.0, 90.0, 50.0, 62.0)], "file_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double")
    ink = P.second_page_ink(packets, words, rasters(spark, (1, inked), (3, clean)))
    assert {r["tag"]: (r["title_found"], r["has_ink"]) for r in ink.collect()} == {"a": (True, True), "b": (False, False)}
    findings = spark.createDataFrame([("f", 9)], "file_id string, page_idx int")
    assert {r["tag"]: r["unnoticed"] for r in P.exposures(ink, findings).collect()} == {"a": True, "b": False}


def test_rasters_are_never_broadcast_and_come_in_bounded_batches(spark):
    """Spark takes a raster for 100 bytes, so that any number of pages seems small enough to send to every task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    # of ranges Spark knows the size
    key = [F.lit("f").alias("file_id"), F.col("id").cast("int").alias("page_idx")]
    pages = spark.range(3).select(*key, F.unhex(F.repeat(F.lit("FF"), F.lit(200))).alias("grey"), F.lit(20).alias("n_rows"), F.lit(10).alias("n_cols"), F.lit(72.0).alias("dpi"))
    one = spark.range(1, 2)
    regions = one.select(*key, F.struct(*[F.lit(x).alias(n) for n, x in zip("ltrb", (0.0, 0.0, 5.0, 4.0), strict=True)]).alias("box"))
    reasons = one.select(*key, F.array(F.lit("a")).alias("reasons"))
    anchors = one.select(*key, *[F.lit(1.0).alias(c) for c in ("name_top", "group_top", "row_height")], *[F.lit(True).alias(f"{c}_found") for c in ("name", "teacher", "group")])
    drawn = R.redacted_rasters(pages, regions.select("file_id", "page_idx", F.array("box").alias("boxes")))
    for frame in (R.ink_in_regions(pages, regions), drawn, R.detect_bands(pages, anchors), P.contact_sheets(pages, reasons)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert {r["page_idx"]: bytes(r["grey"]).count(0) for r in drawn.collect()} == {0: 0, 1: 20, 2: 0}
    assert [(r["page_idx"], r["share"], r["has_ink"]) for r in R.ink_in_regions(drawn.withColumn("dpi", F.lit(72.0)), regions).collect()] == [(1, 1.0, True)]


@pytest.mark.parametrize("bad", [b"", b"x", b"%PDF-1.4\n"])
def test_other_bytes_are_no_pages(bad):
    assert D.read_pdf(bad) == []


def test_diagnose(spark):
    packets = spark.createDataFrame([("f", "a", 0, "r"), ("f", "b", 1, None), ("f", "c", 2, "r"), ("f", "d", None, "r"), ("f", "e", 3, "r")], "file_id string, tag string, header_page int, label string")
    geometry = spark.createDataFrame([("f", 0, False, 1), ("f", 1, True, 2), ("f", 2, True, 0), ("f", 3, True, 0)], "file_id string, page_idx int, detected boolean, n_uncovered long")
    found = P.diagnose(packets, geometry, spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")).collect()
    assert {r["tag"]: (r["label"], r["hold_reason"]) for r in found} == {"a": ("r", "detection"), "b": ("undated", "uncovered_ink"), "c": ("r", "leak"), "e": ("r", "clean")}
