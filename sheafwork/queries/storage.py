"""Queries over sources and sinks: what is written is read back, and the rows read are held against SQL over the input.

Sidecars and rosters are documents of one scan or one class, so their queries write and read one such file of the nation table, which
has the same rows at every size. Files go to the shared folder of the session. The other queries run over the large tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.operators import orientation as T
from sheafwork.operators import redaction as R
from sheafwork.queries import inputs as I
from sheafwork.queries.registry import query
from sheafwork.session import shared_folder
from sheafwork.sources import documents as D
from sheafwork.sources import roster as S
from sheafwork.sources import sidecars as J

_TAG = "concat('t', lpad(CAST(n_nationkey AS STRING), 2, '0'), ' ', n_name)"
_NATION_ROWS = f"""SELECT CAST(n_nationkey AS INT) AS k, {_TAG} AS tag, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE lpad(CAST(n_nationkey * 7919 AS STRING), 10, '0') END AS sid,
  CASE WHEN n_nationkey % 5 = 2 THEN NULL ELSE concat('out/"', n_name, '".pdf') END AS path, CAST(90 * (n_nationkey % 4) AS INT) AS angle FROM nation"""


@query("SELECT tag, sid FROM n", n=_NATION_ROWS)
def sidecar_decisions(n: DataFrame) -> DataFrame:
    """A null number, confirmed without consent, is told from a packet that has no row."""
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "decisions")
    J.write_decisions(spark, n.select("tag", "sid"), folder)
    return J.read_decisions(spark, folder)


@query("SELECT tag, sid, path FROM n", n=_NATION_ROWS)
def sidecar_ledger(n: DataFrame) -> DataFrame:
    """Written twice, of which the second time changes nothing and so writes nothing."""
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "ledger")
    rows = n.select("tag", "sid", "path")
    if not J.write_ledger(spark, rows, folder) or J.write_ledger(spark, rows, folder, J.read_ledger(spark, folder)):
        raise AssertionError("a ledger is written if it differs, and only then")
    return J.read_ledger(spark, folder)


@query("SELECT 'f' AS file_id, k AS page_idx, angle FROM n", n=_NATION_ROWS)
def sidecar_orientation(n: DataFrame) -> DataFrame:
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "orientation")
    J.write_orientation_overrides(spark, n.select(F.col("k").alias("page_idx"), "angle"), folder)
    return J.read_orientation_overrides(spark, folder, "f")


@query("SELECT DISTINCT tag FROM n", n=_NATION_ROWS)
def sidecar_tags(n: DataFrame) -> DataFrame:
    """A set: repeated tags are written once."""
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "tags")
    J.write_tags(spark, n.select("tag").unionByName(n.select("tag")), folder)
    return J.read_tags(spark, folder)


_DRAWN = f"""SELECT {_TAG} AS tag, CAST(n_nationkey % 3 AS INT) AS offset, CAST(n_nationkey AS DOUBLE) AS l, CAST(n_regionkey AS DOUBLE) AS t, CAST(n_nationkey + 0.5E0 AS DOUBLE) AS r, CAST(n_regionkey + 20 AS DOUBLE) AS b,
  n_nationkey % 2 = 0 AS banded FROM nation"""


@query(
    """SELECT tag, 'boxes' AS kind, "offset", l, t, r, b FROM d UNION ALL SELECT tag, 'band', NULL, l, t, r, b FROM d WHERE banded""",
    d=_DRAWN,
)
def sidecar_geometry(d: DataFrame) -> DataFrame:
    """Drawn boxes of header and further pages, and drawn borders."""
    spark, folder = d.sparkSession, shared_folder(d.sparkSession, "geometry")
    box = F.struct("l", "t", "r", "b")
    J.write_geometry(spark, d.select("tag", "offset", F.array(box).alias("boxes")), folder, d.where("banded").select("tag", box.alias("band")))
    boxes = J.read_geometry(spark, folder).select("tag", F.lit("boxes").alias("kind"), "offset", F.explode("boxes").alias("x"))
    bands = J.read_geometry_bands(spark, folder).select("tag", F.lit("band").alias("kind"), F.lit(None).cast("int").alias("offset"), F.col("band").alias("x"))
    return boxes.unionByName(bands).select("tag", "kind", "offset", "x.l", "x.t", "x.r", "x.b")


@query(
    """SELECT tag, sid, 'W' AS worksheet_type, 'held' AS reason, path AS pdf_path, CASE WHEN angle > 0 THEN k % 3 END AS "offset", CASE WHEN angle > 0 THEN k::DOUBLE END AS l,
      CASE WHEN angle > 0 THEN angle::DOUBLE END AS t FROM n""",
    n=_NATION_ROWS,
)
def sidecar_queue(n: DataFrame) -> DataFrame:
    """The manual queue, one document a packet, with the regions that were flagged."""
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "queue")
    region = F.array(F.col("k").cast("double"), F.col("angle").cast("double"), F.lit(300.0), F.lit(400.0))
    flagged = F.when(F.col("angle") > 0, F.create_map((F.col("k") % 3).cast("string"), F.array(region)))
    J.write_queue(spark, n.select("tag", "sid", F.lit("W").alias("worksheet_type"), F.lit("held").alias("reason"), F.col("path").alias("pdf_path"), flagged.alias("flagged_regions")), folder)
    queue = J.read_queue(spark, folder)
    boxes = J.flagged_boxes(queue).select("tag", "offset", "box.l", "box.t")
    return queue.drop("flagged_regions").join(boxes, "tag", "left")


@query("SELECT '07' AS block, 3 AS class_period, NULL::INT AS month, count(*) AS n_pages, sum(k * page) AS checksum FROM (SELECT k, row_number() OVER (ORDER BY angle, k DESC) AS page FROM n)", n=_NATION_ROWS)
def sidecar_order_and_provenance(n: DataFrame) -> DataFrame:
    """A scan's page order, and the block that a run was resolved to."""
    spark, folder = n.sparkSession, shared_folder(n.sparkSession, "scan")
    J.write_page_order(spark, [r["k"] for r in n.orderBy("angle", F.desc("k")).collect()], f"{folder}/order")
    J.write_provenance(spark, "07", 3, None, f"{folder}/provenance")
    pages = J.read_page_order(spark, f"{folder}/order", "f").select(F.posexplode("sequence").alias("at", "k"))
    return J.read_provenance(spark, f"{folder}/provenance").crossJoin(pages.agg(F.count("*").alias("n_pages"), F.sum((F.col("at") + 1) * F.col("k")).alias("checksum")))


_CLASS_ROWS = f"""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT) AS row_num, concat('731046', lpad(CAST(1 AS STRING), 2, '0'), lpad(CAST(n_nationkey AS STRING), 2, '0')) AS sid,
  {I.last_name('n_nationkey')} AS last_name, concat(n_name, ', "', {I.first_name('n_nationkey')}, '"') AS first_name FROM nation"""
_CLASS_HELD = f"SELECT CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INT) AS ord, {I.last_name('r_regionkey + 500')} AS last_name, r_name AS first_name FROM region"


@query(
    """SELECT row_num AS ord, sid, last_name, first_name, substr(sid, 7, 2) AS period, false AS held FROM c UNION ALL SELECT ord, NULL, last_name, first_name, NULL, true FROM h""",
    c=_CLASS_ROWS,
    h=_CLASS_HELD,
)
def roster_files(c: DataFrame, h: DataFrame) -> DataFrame:
    """A class's roster and its held names as CSV files: commas and quotes in names, row numbers, validation on reading."""
    spark, path = c.sparkSession, f"{shared_folder(c.sparkSession, 'roster')}/roster.csv"
    S.write_roster(c, h, path)
    entries, held = S.load_full_roster(spark, path)
    one, again = S.load_roster(spark, path, infer_from="scan PD01.pdf")
    found = entries.join(one.select("sid"), "sid", "left_semi").select("ord", "sid", "last_name", "first_name", "period", F.lit(False).alias("held"))
    kept = held.join(again.select("ord"), "ord", "left_semi").select("ord", F.lit(None).cast("string").alias("sid"), "last_name", "first_name", F.lit(None).cast("string").alias("period"), F.lit(True).alias("held"))
    return found.unionByName(kept)


def _plain_text_decoder() -> D.Decoder:
    """Pages of a text parted by line ends, words by blanks; a text without a line end is no document."""

    def decode(data: bytes):
        if b"\n" not in data:
            raise ValueError("no line")
        lines = data.decode().split("\n")
        return [(612.0, 792.0, [(w, 12.0 * k, 12.0 * k + 10, 20.0, 32.0) for k, w in enumerate(line.split(" ")) if w]) for line in lines]

    return decode


@query(
    """WITH d AS (SELECT 'd' || doc_id AS file_id, coalesce(text, '') AS text FROM t), l AS (SELECT file_id, text, string_split(text, chr(10)) AS pages FROM d),
    p AS (SELECT file_id, text, unnest(pages) AS page, unnest(range(len(pages))) AS page_idx FROM l WHERE contains(text, chr(10)))
    SELECT file_id, sha256(text) AS content_sha, page_idx::INT AS page_idx, len(list_filter(string_split(page, ' '), lambda w: w <> ''))::INT AS n_words, '' AS error FROM p
    UNION ALL SELECT file_id, sha256(text), NULL, 0, 'ValueError: no line' FROM d WHERE NOT contains(text, chr(10))""",
    t="SELECT CAST(doc_id AS STRING) AS doc_id, text FROM documents",
)
def decoded_pages(t: DataFrame) -> DataFrame:
    """A file that its reader refuses is one row with the error; the others give a row a page, with the hash of their content."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    files = t.select(F.concat(F.lit("d"), "doc_id").alias("file_id"), F.lit("").alias("path"), content.alias("content"))
    files = files.withColumn("content_sha", D.content_hash("content"))
    pages = D.decode_pages(files, _plain_text_decoder)
    return pages.select("file_id", "content_sha", "page_idx", F.size("words").alias("n_words"), "error")


@query("SELECT page_idx, word_seq, text, x0, x1 FROM w WHERE x0 >= 40 AND x1 <= 300 AND top >= 60 AND bottom <= 130", w=I.WORDS)
def words_in_region(w: DataFrame) -> DataFrame:
    return D.words_in(w, 40, 60, 300, 130).select("page_idx", "word_seq", "text", "x0", "x1")


_HAS_TEXT = "SELECT 'f' AS file_id, CAST(o_orderkey AS INT) AS page_idx, o_custkey % 4 > 0 AS has_text FROM orders"


@query(
    """SELECT w.page_idx, word_seq, CASE WHEN has_text THEN text ELSE upper(text) END AS text FROM w JOIN g ON w.page_idx = g.page_idx""",
    w=I.WORDS,
    g=_HAS_TEXT,
)
def native_or_recognised_words(w: DataFrame, g: DataFrame) -> DataFrame:
    """Pages with a text layer keep its words, the others take those that were recognised."""
    return D.chosen_words(w, w.withColumn("text", F.upper("text")), g).select("page_idx", "word_seq", "text")


#: Results of an engine: boxes in pixels at 144 dpi within a region whose corner is given in points.
_RECOGNISED = """SELECT CAST(l_orderkey AS INT) AS page_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS seq,
  CASE l_linenumber % 4 WHEN 0 THEN '--' WHEN 1 THEN concat('  ', l_returnflag, '.') WHEN 2 THEN CAST(l_partkey AS STRING) ELSE concat(l_linestatus, ' ') END AS text,
  CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y, CAST(l_orderkey % 50 AS DOUBLE) AS dx, CAST(l_orderkey % 70 AS DOUBLE) AS dy FROM lineitem"""


@query(
    """SELECT page_idx, seq AS word_seq, trim(text) AS text, x / 2 + dx AS x0, (x + 31) / 2 + dx AS x1, y / 2 + dy AS top, (y + 17) / 2 + dy AS bottom FROM o WHERE text <> '--'""",
    o=_RECOGNISED,
)
def recognised_words(o: DataFrame) -> DataFrame:
    c = F.col
    word = F.struct("seq", "text", F.array(c("x"), c("y"), c("x") + 31, c("y") + 17).alias("box"))
    found = o.groupBy("page_idx", "dx", "dy").agg(F.sort_array(F.collect_list(word)).alias("w"))
    results = found.select(F.lit("f").alias("file_id"), "page_idx", F.lit(144.0).alias("dpi"), c("dx").alias("left"), c("dy").alias("top"), c("w.text").alias("texts"), c("w.box").alias("boxes"))
    return D.words_from_recognition(results).drop("file_id")


_BUNDLES = "SELECT CAST(o_orderkey AS INT) AS page_idx, concat('c', CAST(o_custkey AS STRING)) AS tag, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k FROM orders"


@query(
    """SELECT tag, k AS page_idx, row_number() OVER (PARTITION BY tag, k ORDER BY word_seq)::INT - 1 AS word_seq, text, round(x0, 2) AS x0, round(top, 2) AS top FROM w JOIN b ON w.page_idx = b.page_idx""",
    w=I.WORDS,
    b=_BUNDLES,
)
def published_files(w: DataFrame, b: DataFrame) -> DataFrame:
    """Packets as PDF files with a hidden text layer, read back word by word."""
    words = w.join(b.select("page_idx", "tag", F.col("k").alias("offset")), "page_idx")
    pages = b.select("tag", F.col("k").alias("offset"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    files = D.publish(R.text_operators(words, F.lit(792.0)), pages, b.select("tag").distinct().withColumn("path", F.concat("tag", F.lit(".pdf"))))
    files = files.select(F.regexp_replace("path", r"\.pdf$", "").alias("file_id"), "path", "content").withColumn("content_sha", D.content_hash("content"))
    read = D.words_of(D.decode_pages(files, lambda: D.read_pdf))
    return read.select(F.col("file_id").alias("tag"), "page_idx", "word_seq", "text", F.round("x0", 2).alias("x0"), F.round("top", 2).alias("top"))


#: Blank rasters of 120 x 80 points at 72 dpi with one dark block, and a box that lies in another place.
_BLOTS = """SELECT CAST(s_suppkey AS INT) AS page_idx, CAST(5 + s_suppkey % 41 AS INT) AS x, CAST(3 + s_suppkey % 31 AS INT) AS y, CAST(1 + s_suppkey % 23 AS INT) AS n, CAST(10 + s_suppkey % 17 AS INT) AS bx, CAST(8 + s_suppkey % 13 AS INT) AS up FROM supplier"""


def _blots(p: DataFrame) -> DataFrame:
    """Rasters whose block of n x n points begins at (x, y)."""
    white, black = (lambda n: F.repeat(F.lit("FF"), n)), (lambda n: F.repeat(F.lit("00"), n))
    c = F.col
    blank, line = white(F.lit(120)), F.concat(white(c("x")), black(c("n")), white(120 - c("x") - c("n")))
    grey = F.unhex(F.concat(F.repeat(blank, c("y")), F.repeat(line, c("n")), F.repeat(blank, 80 - c("y") - c("n"))))
    return p.select(F.lit("f").alias("file_id"), "page_idx", grey.alias("grey"), F.lit(80).alias("n_rows"), F.lit(120).alias("n_cols"), F.lit(72.0).alias("dpi"))


_SHARED = "greatest(0, least(x + n, bx + 30) - greatest(x, bx)) * greatest(0, least(y + n, up + 20) - greatest(y, up))"


@query(
    f"""SELECT page_idx, round({_SHARED} / 600.0::DOUBLE, 9) AS share, {_SHARED} >= 6 AS has_ink, n * n AS dark_before, n * n - {_SHARED} + 600 AS dark_after FROM p""",
    p=_BLOTS,
)
def hidden_ink(p: DataFrame) -> DataFrame:
    """The ink of a region, and the dark points of the page before and after the region is hidden."""
    rasters = _blots(p)
    region = G.box(F.col("bx") * 1.0, F.col("up") * 1.0, F.col("bx") + 30.0, F.col("up") + 20.0)
    regions = p.select(F.lit("f").alias("file_id"), "page_idx", region.alias("box"))
    ink = R.ink_in_regions(rasters, regions).select("page_idx", F.round("share", 9).alias("share"), "has_ink")
    dark = lambda name: ((F.length(F.hex("grey")) - F.length(F.replace(F.hex("grey"), F.lit("00"), F.lit("")))) / 2).cast("long").alias(name)
    after = R.redacted_rasters(rasters, regions.select("file_id", "page_idx", F.array("box").alias("boxes")))
    return ink.join(rasters.select("page_idx", dark("dark_before")), "page_idx").join(after.select("page_idx", dark("dark_after")), "page_idx")


_RULED = "SELECT CAST(s_suppkey AS INT) AS page_idx, CAST(90 * (s_suppkey % 4) AS INT) AS angle, CAST(3 + s_suppkey % 5 AS INT) AS gap FROM supplier"


def _longest_run() -> T.Classifier:
    """Upright (0) for rules that run along rows, a quarter turn (90) for those along columns."""

    def classify(grey: np.ndarray) -> tuple[int, float]:
        dark = grey < 128
        return (0, 0.9) if dark.mean(axis=1).max() >= dark.mean(axis=0).max() else (90, 0.8)

    return classify


@query(
    """SELECT page_idx, CASE WHEN angle % 180 = 0 THEN 0 ELSE 90 END AS angle, CASE WHEN angle % 180 = 0 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS score, 0.0::DOUBLE AS skew,
      angle % 180 = 0 AS resolved FROM p""",
    p=_RULED,
)
def detected_orientations(p: DataFrame) -> DataFrame:
    """Ruled pages, upright or on their side: the angle that an engine gives, the skew once they are turned back, and what is applied."""
    line, blank, turned = F.repeat(F.lit("00"), F.lit(90)), F.repeat(F.lit("FF"), F.lit(90)), F.col("angle") % 180 != 0
    rows = F.substring(F.repeat(F.concat(line, F.repeat(blank, F.col("gap"))), F.lit(30)), 1, 2 * 90 * 90)
    column = F.substring(F.repeat(F.concat(F.lit("00"), F.repeat(F.lit("FF"), F.col("gap"))), F.lit(30)), 1, 2 * 90)
    grey = F.unhex(F.when(turned, F.repeat(column, F.lit(90))).otherwise(rows))
    rasters = p.select(F.lit("f").alias("file_id"), "page_idx", grey.alias("grey"), F.lit(90).alias("n_rows"), F.lit(90).alias("n_cols"))
    return T.resolve(T.detect(rasters, _longest_run)).select("page_idx", "angle", "score", "skew", "resolved")


@query(
    """WITH x AS (SELECT page_idx, least(l1, r1) AS la, least(t1, b1) AS ta, greatest(l1, r1) AS ra, greatest(t1, b1) AS ba, least(l2, r2) AS lb, least(t2, b2) AS tb, greatest(l2, r2) AS rb, greatest(t2, b2) AS bb FROM b)
    SELECT page_idx, page_idx % 3 = 0 OR page_idx % 2 = 0 AS detected, CASE WHEN page_idx % 3 = 0 THEN 'manual' ELSE 'auto' END AS source,
      CASE WHEN page_idx % 3 = 0 THEN least(la, lb) ELSE 38 END::DOUBLE AS l, CASE WHEN page_idx % 3 = 0 THEN greatest(ba, bb) ELSE 148 END::DOUBLE AS b, 2 AS n_boxes FROM x""",
    b=I.BOXES,
)
def planned_boxes(b: DataFrame) -> DataFrame:
    """A reviewer's boxes take the place of the automatic ones, and their union that of the border."""
    c, key = F.col, F.lit("f").alias("file_id")
    band = F.struct(*[F.lit(v).alias(n) for n, v in zip("ltrb", (38.0, 58.0, 574.0, 148.0), strict=True)])
    bands = b.select(key, "page_idx", band.alias("band"), (c("page_idx") % 2 == 0).alias("detected"))
    anchors = b.select(key, "page_idx", F.lit(111.0).alias("group_top"))
    drawn = F.array(*[F.struct(*[c(f"{n}{k}").alias(n) for n in "ltrb"]) for k in (1, 2)])
    plan = R.plan_boxes(bands, anchors, b.where("page_idx % 3 = 0").select(key, "page_idx", drawn.alias("boxes")))
    return plan.select("page_idx", "detected", "source", "band.l", "band.b", F.size("boxes").alias("n_boxes"))
