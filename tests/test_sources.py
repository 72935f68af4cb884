"""Rosters, sidecars, documents and streams through files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.operators import dispositions as O
from sheafwork.sources import documents as D
from sheafwork.sources import roster as S
from sheafwork.sources import sidecars as J
from sheafwork.streaming import ingest as T

HEAD = "SID,Last Name,First Name\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_blocks_periods_and_held_names(spark, tmp_path):
    path = write(tmp_path / "r.csv", HEAD + "7310460201,Brandt,Oskar\n7310460202,Teschner,Wilma \n,,\n\n7310460303,Lindqvist,Torsten\n")
    write(tmp_path / "r_holds.csv", "Last Name,First Name\nUngern,Pelle\n,\n")
    entries, held = S.load_full_roster(spark, path)
    assert [(r["ord"], r["sid"], r["full_name"]) for r in entries.orderBy("ord").collect()] == [(2, "7310460201", "Oskar Brandt"), (3, "7310460202", "Wilma Teschner"), (5, "7310460303", "Torsten Lindqvist")]
    assert [r["last_name"] for r in held.collect()] == ["Ungern"]
    assert S.load_roster(spark, path, period=2)[0].count() == 2 and S.load_roster(spark, path, infer_from="x PD03.pdf")[0].count() == 1
    for bad in ({}, {"period": "9"}):
        with pytest.raises(S.RosterError):
            S.load_roster(spark, path, **bad)


@pytest.mark.parametrize(
    "rows, code",
    [
        ("7310460201,Brandt,\n", "partly_blank"),
        ("731046020,Brandt,Oskar\n", "malformed_sid"),
        ("7310460201,Brandt,Oskar\n7310460201,Lindqvist,Torsten\n", "duplicate_sid"),
        ("7310460201,Brandt,Oskar\n7310460302,Lindqvist,Torsten\n", "period_mismatch"),
    ],
)
def test_violations(spark, tmp_path, rows, code):
    with pytest.raises(S.RosterError, match=code):
        S.load_full_roster(spark, write(tmp_path / "r.csv", HEAD + rows))


def test_a_name_on_both_lists_and_missing_columns(spark, tmp_path):
    path = write(tmp_path / "r.csv", HEAD + "7310460201,Brandt,Oskar\n")
    write(tmp_path / "r_holds.csv", "Last Name,First Name\n BRANDT,oskar\n")
    with pytest.raises(S.RosterError, match="held_name"):
        S.load_full_roster(spark, path)
    with pytest.raises(S.RosterError, match="no column"):
        S.load_full_roster(spark, write(tmp_path / "x.csv", "SID,Name\n1,2\n"))


def test_prepared_roster_is_stable(spark):
    raw = spark.createDataFrame([(2, "1", "Brandt.", "Oskar"), (3, "2", "Lindqvist", "Torsten,"), (4, "2", "Falkenau", "Niklas"), (5, "", "", "")], "row_num int, sid string, last_name string, first_name string")
    clean, held = S.prepare_roster(raw)
    assert [tuple(r)[1:] for r in clean.orderBy("row_num").collect()] == [("1", "Brandt", "Oskar"), ("", "", "")]
    again, kept = S.prepare_roster(clean, held)
    assert again.exceptAll(clean).count() == 0 and kept.exceptAll(held).count() == 0 and held.count() == 2


def test_sidecars_round_trip(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    J.write_decisions(spark, spark.createDataFrame([("b", "1"), ("a", None)], "tag string, sid string"), path("d"))
    assert sorted(map(tuple, J.read_decisions(spark, path("d")).collect())) == [("a", None), ("b", "1")]
    assert J.read_decisions(spark, path("none")).count() == 0
    J.write_page_order(spark, [2, 0, 1], path("o"))
    assert J.read_page_order(spark, path("o"), "f").first()["sequence"] == [2, 0, 1]
    J.write_page_order(spark, None, path("o"))
    assert J.read_page_order(spark, path("o"), "f").count() == 0
    blocks = write(tmp_path / "b.json", json.dumps({"teacher_code": "x", "blocks": {"1": {"class_period": 1, "month": 3}}}))
    assert J.read_blocks(spark, blocks).first()["block"] == "01"
    geometry = spark.sql("SELECT 'a' AS tag, o AS offset, array(named_struct('l', 1D, 't', 2D, 'r', 3D, 'b', 4D)) AS boxes FROM VALUES (0), (2) AS t(o)")
    J.write_geometry(spark, geometry, path("g"))
    assert J.read_geometry(spark, path("g")).exceptAll(geometry).count() == 0
    ledger = spark.createDataFrame([("a", "1", "p")], "tag string, sid string, path string")
    assert J.write_ledger(spark, ledger, path("l")) and not J.write_ledger(spark, ledger, path("l"), J.read_ledger(spark, path("l")).cache())


def test_queue_round_trip(spark, tmp_path):
    rows = spark.sql("SELECT 'a b' AS tag, '1' AS sid, 'T' AS worksheet_type, 'x' AS reason, 'in.pdf' AS pdf_path, map('2', array(array(1D, 2D, 3D, 4D))) AS flagged_regions UNION ALL SELECT 'c', NULL, NULL, 'y', NULL, NULL")
    folder = str(tmp_path / "queue")
    assert J.read_queue(spark, folder).count() == 0
    J.write_queue(spark, rows, folder)
    shown = lambda q: sorted(map(str, q.collect()))
    assert shown(J.read_queue(spark, folder)) == shown(rows)
    assert [(r["tag"], r["offset"], tuple(r["box"])) for r in J.flagged_boxes(J.read_queue(spark, folder)).collect()] == [("a b", 2, (1.0, 2.0, 3.0, 4.0))]
    J.write_queue(spark, J.read_queue(spark, folder).where("tag = 'c'"), folder)  # from the folder that it replaces
    assert [r["tag"] for r in J.read_queue(spark, folder).collect()] == ["c"]
    J.write_queue(spark, rows.select("tag", "sid", "worksheet_type", "reason").where("false"), folder)
    assert J.read_queue(spark, folder).count() == 0


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    """At each step of replacing a ledger its readers find the old or the new one, and a later writer goes on."""
    path = str(tmp_path / "l")
    old, new = (spark.createDataFrame([("a", "1", p)], "tag string, sid string, path string") for p in ("old", "new"))
    assert J.write_ledger(spark, old, path)
    with pytest.raises(ZeroDivisionError):
        J.replace_folder(spark, path, lambda fresh: 1 / 0)
    assert J.read_ledger(spark, path).first()["path"] == "old"
    (tmp_path / "l").rename(tmp_path / "l.old")  # it stepped aside, and then the writer died
    assert J.read_ledger(spark, path).first()["path"] == "old"
    assert J.write_ledger(spark, O.upsert(J.read_ledger(spark, path), new, ["tag"]), path, J.read_ledger(spark, path))
    assert J.read_ledger(spark, path).first()["path"] == "new" and not (tmp_path / "l.old").exists()


def test_drawn_borders_round_trip(spark, tmp_path):
    path = str(tmp_path / "g")
    boxes = spark.sql("SELECT 'a' AS tag, 0 AS offset, array(named_struct('l', 1D, 't', 2D, 'r', 3D, 'b', 4D)) AS boxes")
    bands = spark.sql("SELECT 'b' AS tag, named_struct('l', 5D, 't', 6D, 'r', 7D, 'b', 8D) AS band")
    J.write_geometry(spark, boxes, path, bands)
    assert J.read_geometry(spark, path).collect() == boxes.collect() and J.read_geometry_bands(spark, path).collect() == bands.collect()


def test_broken_files_become_rows_and_empty_trees_errors(spark, tmp_path):
    (tmp_path / ".cache").mkdir()
    (tmp_path / ".cache" / "hidden.pdf").write_bytes(b"x")
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "good.pdf").write_bytes(D.write_pdf([(612, 792, None, ["BT 3 Tr /F1 12.00 Tf 1.0000 0 0 1 45.00 714.40 Tm (a\\(b ) Tj ET"])]))
    pages = {r["file_id"]: r for r in D.decode_pages(D.scan_files(spark, str(tmp_path), must_exist=True), lambda: D.read_pdf).collect()}
    assert set(pages) == {"bad", "good"} and pages["bad"]["error"] and pages["good"]["words"][0]["text"] == "a(b"
    with pytest.raises(ValueError):
        D.scan_files(spark, str(tmp_path), glob="*.tif", must_exist=True)


def test_decoded_pages_leave_a_worker_in_small_batches():
    """A batch of many files is not held as words: pages are handed on while later files are still bytes."""
    import pyarrow as pa

    seen = []

    def decode(data):
        seen.append(data)
        return [(1.0, 2.0, [(f"w{k}", k, k + 1.0, 0.0, 1.0) for k in range(3000)])] * 2

    files = pa.RecordBatch.from_pydict({"file_id": [f"f{k}" for k in range(40)], "path": [""] * 40, "content_sha": [""] * 40, "content": [b"x"] * 40})
    stream = D.decoded_batches(iter([files]), decode)
    first = next(stream)
    assert len(seen) < 5 and first.num_rows == 6
    rows = [r for batch in (first, *stream) for r in batch.to_pylist()]
    assert [(r["file_id"], r["page_idx"], len(r["words"])) for r in rows] == [(f"f{k}", j, 3000) for k in range(40) for j in (0, 1)]
    assert rows[79]["words"][7] == {"text": "w7", "x0": 7.0, "x1": 8.0, "top": 0.0, "bottom": 1.0}


def test_published_packets_span_batches():
    """Pages stream in; a packet that crosses a batch is one file, and files leave before all pages are there."""
    import pyarrow as pa

    op = "BT 3 Tr /F1 10.00 Tf 1.0000 0 0 1 5.00 700.00 Tm (w ) Tj ET"
    pages = [(f"p{k:05}", j, 10.0, 800.0, None, None, None, [op] if j else None) for k in range(3000) for j in range(3)]
    schema = pa.schema([("path", pa.string()), ("offset", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("grey", pa.binary()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("ops", pa.list_(pa.string()))])
    seen = []

    def batches():
        for k in range(0, len(pages), 100):
            seen.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pages[k : k + 100], strict=True), schema, strict=True)], schema=schema)

    stream = D.published_batches(batches())
    first = next(stream)
    assert len(seen) < 70
    files = [(r["path"], r["content"]) for b in (first, *stream) for r in b.to_pylist()]
    assert [f for f, _ in files] == [f"p{k:05}" for k in range(3000)]
    assert all([len(w) for _, _, w in D.read_pdf(content)] == [0, 1, 1] for _, content in files[::50])


def test_words_from_recognition(spark):
    rows = spark.createDataFrame([("f", 0, 144.0, 10.0, 700.0, [" Page ", "--", "x1"], [[0.0, 0.0, 20.0, 10.0], [1.0, 1.0, 2.0, 2.0], [2.0, 2.0, 4.0, 8.0]])], "file_id string, page_idx int, dpi double, left double, top double, texts array<string>, boxes array<array<double>>")
    assert [(r["text"], r["x0"], r["x1"], r["top"], r["bottom"]) for r in D.words_from_recognition(rows).orderBy("word_seq").collect()] == [("Page", 10.0, 20.0, 700.0, 705.0), ("x1", 11.0, 12.0, 701.0, 704.0)]


def test_streamed_packets_span_batches(spark, tmp_path):
    rows = [("f", k, h, n, 2, n is not None, "T", k == 3) for k, (h, n) in enumerate([(True, 1), (False, 2), (False, 2), (True, None)])]
    frame = spark.createDataFrame(rows, T.FEATURES)
    frame.where("page_idx < 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.where("page_idx >= 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = T.into_table(T.segment_stream(T.drop_folder(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("packet_index").collect()
    assert [(r["page_indices"], r["is_orphan"]) for r in found] == [([0, 1], False), ([2], True), ([3], False)]


def test_finished_files_leave_no_state():
    class State:
        exists, get, kept = False, None, "unset"

        def update(self, value):
            self.kept = value

        def remove(self):
            self.kept = None

    pages = pd.DataFrame([("f", 0, True, 1, 2, True, "T", False), ("f", 1, False, 2, 2, True, None, True)], columns=[c.split()[0] for c in T.FEATURES.split(", ")])
    for part, kept in ((pages.iloc[:1], True), (pages, False)):
        state = State()
        list(T._segment(("f",), iter([part]), state))
        assert (state.kept is not None) == kept


def test_widths_and_scale(spark):
    one = spark.range(1).select(G.advance_width(F.lit("Ab"), F.lit(10.0), G.helvetica_widths()).alias("w"), G.horizontal_scale(F.lit(1000.0), F.lit(1.0)).alias("s"), G.editor_dpi(F.lit(612.0)).alias("d"))
    assert tuple(one.first()) == (12.23, 20.0, 82)
