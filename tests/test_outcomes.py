"""Redaction, leaks, outcomes, ledger, reports and the command line on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork import cli
from sheafwork.functions import fuzzy as Z
from sheafwork.functions import geometry as G
from sheafwork.operators import dispositions as O
from sheafwork.operators import leak as L
from sheafwork.operators import orientation as R
from sheafwork.operators import redaction as X
from sheafwork.operators import segmentation as S
from sheafwork.plans import pipeline as P
from sheafwork.sources import documents as D
from sheafwork.sources import sidecars as J


def border(dpi, drop=0.0, top=58.0, bottom=148.0, left=38.0, right=574.0):
    unit = dpi / 72
    grey = np.full((int(792 * unit), int(612 * unit)), 255, np.uint8)
    for x in np.arange(int(left * unit), int(right * unit) + 1):
        tilt = drop * (x / unit - left) / (right - left)
        for y in (top, bottom):
            at = int(round((y + tilt) * unit))
            grey[at : at + 2, x] = 0
    for x, tilt in ((left, 0.0), (right, drop)):
        grey[int((top + tilt) * unit) : int((bottom + tilt) * unit) + 2, int(x * unit) : int(x * unit) + 2] = 0
    return grey


@pytest.mark.parametrize("drop", [0, 5, 10, 15])
def test_border_is_found_under_tilt(drop):
    left, top, right, bottom, found = X.detect_band(border(100, drop), 100, 68.0, 111.0, 24.0, True)
    assert found and abs(left - 38) < 2 and abs(right - 574) < 2
    assert top <= 59 and bottom >= 147 + min(drop, 1)


def test_no_border_falls_back():
    blank = np.full((1100, 850), 255, np.uint8)
    assert X.detect_band(blank, 100, None, None, 24.0, False) == (38.0, 58.0, 574.0, 148.0, False)
    assert X.detect_band(blank, 100, 70.0, 115.0, 25.0, True) == (38.0, 70.0, 574.0, 140.0, False)


def test_a_page_without_labels_is_hidden_no_less_than_the_layout_says():
    """A border that is found further inside, or a stray line, must not uncover what the layout's band covers."""
    for found in ((42, 62, 570, 144), (60, 64, 560, 146), (30, 52, 580, 155)):
        left, top, right, bottom = found
        box = X.detect_band(border(72, top=top, bottom=bottom, left=left, right=right), 72, None, None, 24.0, False)
        assert box[0] <= 38 and box[1] <= 58 and box[2] >= 574 and box[3] >= 148 and box[4]
        assert box[0] == min(38, left) and box[1] == min(58, top)
    half = np.full((792, 612), 255, np.uint8)
    half[50:160, 100] = 0
    assert X.detect_band(half, 72, None, None, 24.0, False)[:4] == (38.0, 58.0, 574.0, 148.0)
    labelled = X.detect_band(border(72, top=90, bottom=180, left=42, right=570), 72, 98.0, 140.0, 38.0, True)
    assert labelled[4] and abs(labelled[0] - 42) <= 1 and abs(labelled[1] - 90) <= 1


def test_paths_of_other_packets_are_not_taken(spark):
    """A packet that is pending again keeps its file; a new one of the same entry gets the next free number, and so on the next run."""
    natural = "731046/PRT/02/7310460201"
    rows = [("a", 1, None), ("b", 2, "7310460201"), ("c", 3, "7310460201"), ("d", 4, "7310460201")]
    packets = spark.createDataFrame([(t, k, "PRT", []) for t, k, _ in rows], f"tag string, ord int, worksheet_type string, issues array<{S.ISSUE}>")
    decisions = spark.createDataFrame([(t, sid) for t, _, sid in rows if sid], "tag string, sid string")
    roster = spark.createDataFrame([("7310460201",)], "sid string")
    ledger = spark.createDataFrame([("a", "7310460201", f"{natural}.pdf"), ("z", "7310460201", f"{natural}_3.pdf"), ("d", "7310460201", f"{natural}_5.pdf")], "tag string, sid string, path string")
    none = spark.createDataFrame([], "tag string")
    made = lambda known: O.decide(packets, decisions, roster, known, held_matches=none, undetected=none, leaks=none, detection_overrides=none, composition_overrides=none)
    first = {r["tag"]: r["path"] for r in made(ledger).collect()}
    assert first == {"a": None, "d": f"{natural}_2.pdf", "b": f"{natural}_4.pdf", "c": f"{natural}_5.pdf"}
    after = spark.createDataFrame(O.merge_ledger(ledger, made(ledger)).collect(), ledger.schema)
    assert after.select("path").distinct().count() == after.count() == 5
    assert {r["tag"]: r["path"] for r in made(after).collect()} == first
    queue = spark.createDataFrame([("q", "7310460201", "PRT", "x"), ("b", "7310460201", "PRT", "x")], "tag string, sid string, worksheet_type string, reason string")
    released = {r["tag"]: r["path"] for r in O.release(queue, roster, none, none, after).collect()}
    assert released == {"b": f"{natural}_4.pdf", "q": f"{natural}_6.pdf"}


def test_bands_plan_and_kept_words(spark):
    grey = border(100)
    raster = spark.createDataFrame([("f", 0, bytearray(grey.tobytes()), *grey.shape, 100.0)], "file_id string, page_idx int, grey binary, n_rows int, n_cols int, dpi double")
    words = [("Name:", 45.0, 68.0), ("Ann", 150.0, 68.0), ("Group", 45.0, 111.0), ("Bea", 450.0, 116.0), ("body", 60.0, 170.0), ("10/3/2025", 450.0, 70.0)]
    rows = spark.createDataFrame([("f", 0, k, t, x, x + 30, y, y + 12) for k, (t, x, y) in enumerate(words)], "file_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double")
    anchors = S.header_anchors(rows)
    bands = X.detect_bands(raster, anchors)
    assert bands.first()["detected"]
    plan = X.plan_boxes(bands, anchors)
    assert sorted(r["text"] for r in X.kept_words(rows, plan).collect()) == ["10/3/2025", "body"]
    assert X.header_geometry(bands, rows, anchors).first()["n_uncovered"] == 0
    manual = spark.createDataFrame([("f", 0, [(100.0, 90.0, 40.0, 60.0)])], "file_id string, page_idx int, boxes array<struct<l:double,t:double,r:double,b:double>>")
    drawn = X.plan_boxes(bands, anchors, manual).first()
    assert drawn["source"] == "manual" and tuple(drawn["band"]) == (40.0, 60.0, 100.0, 90.0)


def test_touching_boxes_do_not_overlap(spark):
    one = spark.sql("SELECT named_struct('l', 0D, 't', 0D, 'r', 10D, 'b', 10D) a, named_struct('l', 10D, 't', 0D, 'r', 20D, 'b', 10D) b, named_struct('l', 9D, 't', 9D, 'r', 20D, 'b', 20D) c")
    assert one.select(G.overlaps(F.col("a"), F.col("b")), G.overlaps(F.col("a"), F.col("c"))).first()[:] == (False, True)


def test_one_letter_off_is_a_fuzzy_finding(spark):
    words = spark.createDataFrame([("f", 0, "Lindqvest was here, lindqvisr"), ("g", 0, "nothing")], "file_id string, page_idx int, text string")
    roster = spark.createDataFrame([("1", "Lindqvist", "Torsten")], "sid string, last_name string, first_name string")
    found = {(r["file_id"], r["token"], r["exact"]) for r in L.leak_findings(words, roster).collect()}
    assert found == {("f", "lindqvest", False), ("f", "lindqvisr", False)}
    assert {r["file_id"]: r["ok"] for r in L.leak_report(words, roster).collect()} == {"f": False, "g": True}


def test_fuzzy_blocking_loses_no_pair(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(5, 16)))
    tokens, names = sorted({word() for _ in range(250)}), sorted({word() for _ in range(120)})
    a = spark.createDataFrame([(t,) for t in tokens], "token string")
    b = spark.createDataFrame([(n,) for n in names], "name string")
    found = {(r["token"], r["name"]) for r in L.fuzzy_pairs(a, b).collect()}
    assert found == {(t, n) for t in tokens for n in names if Z.py_ratio(t, n) >= 80}


def decide(spark, rows, decisions, **more):
    packets = spark.createDataFrame(rows, f"tag string, ord int, worksheet_type string, issues array<{S.ISSUE}>")
    table = lambda tags: spark.createDataFrame([(t,) for t in tags], "tag string")
    ledger = spark.createDataFrame(more.get("ledger", []), "tag string, sid string, path string")
    made = spark.createDataFrame(decisions, "tag string, sid string")
    roster = spark.createDataFrame([("7310460201",), ("7310460202",)], "sid string")
    names = ("held_matches", "undetected", "leaks", "detection_overrides", "composition_overrides")
    return O.decide(packets, made, roster, ledger, **{n: table(more.get(n, [])) for n in names}, allow_delete=more.get("allow_delete", True)), ledger


def test_decision_table(spark):
    fine, ask, hard = [], [("total_mismatch", None, "1/2")], [("no_header", 3, "")]
    tags = {
        "p": (fine, "pending"), "q": (fine, "consent_hold"), "n": (fine, "rejected"), "x": (fine, "held_back"), "i": (ask, "held_back"), "j": (ask, "written"),
        "k": (hard, "held_back"), "b": (fine, "held_back"), "c": (fine, "written"), "l": (fine, "held_back"), "w": (fine, "written"),
    }
    rows = [(t, k, "T", issues) for k, (t, (issues, _)) in enumerate(tags.items())]
    sid = "7310460201"
    decisions = [("n", None), ("x", "9999999999")] + [(t, sid) for t in "ijkbclw"]
    found, _ = decide(spark, rows, decisions, held_matches=["q"], composition_overrides=["j", "k"], undetected=["b", "c"], detection_overrides=["c", "l"], leaks=["l"])
    got = {r["tag"]: r for r in found.collect()}
    assert {t: r["outcome"] for t, r in got.items()} == {t: want for t, (_, want) in tags.items()}
    assert [got[t]["path"] for t in "jcw"] == [f"731046/T/02/{sid}{s}.pdf" for s in ("", "_2", "_3")]


def test_rerun_changes_nothing_and_frees_paths(spark):
    rows = [("a", 0, "T", []), ("b", 1, "T", [])]
    sid = "7310460201"
    first, ledger = decide(spark, rows, [("a", sid), ("b", sid)])
    after = O.merge_ledger(ledger, first)
    kept = [tuple(r) for r in after.orderBy("tag").select("tag", "sid", "path").collect()]
    again, before = decide(spark, rows, [("a", sid), ("b", sid)], ledger=kept)
    assert [tuple(r) for r in O.merge_ledger(before, again).orderBy("tag").select("tag", "sid", "path").collect()] == kept
    assert O.deletions(again).count() == 0
    freed, before = decide(spark, rows, [("a", None), ("b", sid)], ledger=kept)
    assert [(r["tag"], r["path"]) for r in O.merge_ledger(before, freed).collect()] == [("b", f"731046/T/02/{sid}.pdf")]
    skipped, _ = decide(spark, rows, [("a", None)], ledger=kept, allow_delete=False)
    assert {r["tag"]: r["outcome"] for r in skipped.collect()} == {"a": "deletion_skipped", "b": "pending"}


def test_orientation(spark):
    detections = spark.createDataFrame([("f", 0, 0, 0.9, 1.0), ("f", 1, 180, 0.9, 0.0), ("f", 2, 0, 0.26, None), ("f", 3, 90, 0.9, 9.0)], "file_id string, page_idx int, angle int, score double, skew double")
    overrides = spark.createDataFrame([("f", 1, 180)], "file_id string, page_idx int, angle int")
    alone = {r["page_idx"]: r for r in R.resolve(detections).collect()}
    assert [alone[k]["needs_confirmation"] for k in range(4)] == [False, True, False, False]
    both = {r["page_idx"]: r for r in R.resolve(detections, overrides).collect()}
    assert [both[k]["source"] for k in range(4)] == ["auto", "human", "none", "none"] and both[1]["rotated"]
    lines = np.full((200, 300), 255, np.uint8)
    for x in range(300):
        for y in (40, 90, 140):
            lines[int(y + np.tan(np.deg2rad(2)) * x), x] = 0
    assert abs(abs(R.estimate_skew(lines)) - 2) <= 0.5


def test_preflight_and_published_files(spark, tmp_path):
    word = lambda p, k, t, x, y: ("s", p, k, t, float(x), float(x) + 6 * len(t), float(y), float(y) + 12)
    words = []
    for p, name in ((0, "Oskar Brandt"), (2, "Pelle Ungern")):
        words += [word(p, 0, "Name:", 45, 68), *(word(p, 1 + k, n, 150 + 60 * k, 68) for k, n in enumerate(name.split())), word(p, 5, "PRT", 29, 736), word(p, 6, "(01/2024)", 60, 736), word(p, 7, "Page 1 of 2", 513, 747)]
        words += [word(p + 1, 0, "Page 2 of 2", 513, 747), word(p + 1, 1, "Answers", 50, 300)]
    w = spark.createDataFrame(words, "file_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([("s", k, 612.0, 792.0, True) for k in range(4)], "file_id string, page_idx int, width double, height double, has_text boolean")
    roster = spark.createDataFrame([(1, "7310460201", "Brandt", "Oskar")], "ord int, sid string, last_name string, first_name string")
    bands = spark.createDataFrame([("s", k, (38.0, 58.0, 574.0, 148.0), True) for k in (0, 2)], "file_id string, page_idx int, band struct<l:double,t:double,r:double,b:double>, detected boolean")
    counts = P.preflight_counts(P.preflight(P.Inputs(pages, w, roster), bands=bands)).first()
    assert (counts["n_packets"], counts["n_no_match"], counts["n_auto"], counts["n_clean"], counts["n_needs_editor"]) == (2, 1, 1, 1, 1)

    scan, out, decisions = tmp_path / "s", tmp_path / "out", tmp_path / "decisions"
    pages.write.parquet(f"{scan}/pages"), w.write.parquet(f"{scan}/words"), bands.write.parquet(f"{scan}/bands")
    decisions.mkdir()
    (decisions / "s.json").write_text(json.dumps({"s_p000": "7310460201", "s_p002": None}))
    (tmp_path / "r.csv").write_text("SID,Last Name,First Name\n7310460201,Brandt,Oskar\n")
    common = ["--roster", str(tmp_path / "r.csv"), "--out", str(out)]
    scanned = [*common, "--scan", str(scan), "--decisions", str(decisions)]
    assert cli.main(["verify", *common], spark) == 1
    assert cli.main(["preflight", *scanned], spark) == 0 and cli.main(["analyze", *scanned], spark) == 0
    assert cli.main(["run", *scanned], spark) == 0
    assert cli.main(["verify", *common], spark) == 0
    shown = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/words")
    assert "Oskar" not in {r["text"] for r in shown.collect()} and "Answers" in {r["text"] for r in shown.collect()}

    files = {p.relative_to(out).as_posix() for p in out.rglob("*.pdf")}
    assert len(files) == 1
    (page, *_), marks = D.read_pdf((out / next(iter(files))).read_bytes()), (out / next(iter(files))).read_bytes()
    assert {"SID: 7310460201", "PD: 02"} <= {t for t, *_ in page[2]} and not {"Oskar", "Brandt"} & {t for t, *_ in page[2]} and marks
    assert J.read_queue(spark, f"{out}/.manual_queue/s").count() == 0 and J.read_ledger(spark, f"{out}/.ledger/s.json").first()["tag"] == "s_p000"

    ops = X.text_operators(w.where("page_idx = 1"), F.lit(792.0)).select(F.lit("t").alias("tag"), F.lit(0).alias("offset"), "word_seq", "operator")
    made = D.publish(ops, spark.createDataFrame([("t", 0, 612.0, 792.0)], "tag string, offset int, width double, height double"), spark.createDataFrame([("t", "a/b.pdf")], "tag string, path string")).first()
    back = D.read_pdf(bytes(made["content"]))
    assert [x[0] for x in back[0][2]] == ["Page 2 of 2", "Answers"]
    assert abs(back[0][2][1][1] - 50) < 0.01 and abs(back[0][2][1][2] - 92) < 0.5 and abs(back[0][2][1][3] - 300) < 0.1
