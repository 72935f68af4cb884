"""Queries over redaction, outcomes, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.functions import text as X
from sheafwork.operators import dispositions as O
from sheafwork.operators import redaction as R
from sheafwork.operators import rounds as D
from sheafwork.operators import segmentation as S
from sheafwork.plans import pipeline as P
from sheafwork.queries import inputs as I
from sheafwork.queries.packets import _FOLD
from sheafwork.queries.registry import query


def _boxes(b: DataFrame) -> DataFrame:
    c = F.col
    return b.select("file_id", "page_idx", F.array(G.box(c("l1"), c("t1"), c("r1"), c("b1")), G.box(c("l2"), c("t2"), c("r2"), c("b2"))).alias("boxes"))


_BOXES = """WITH x AS (SELECT file_id, page_idx, least(l1, r1) AS la, least(t1, b1) AS ta, greatest(l1, r1) AS ra, greatest(t1, b1) AS ba, least(l2, r2) AS lb, least(t2, b2) AS tb, greatest(l2, r2) AS rb, greatest(t2, b2) AS bb FROM b)
"""


@query(
    _BOXES
    + """SELECT w.file_id, w.page_idx, word_seq FROM w LEFT JOIN x ON w.file_id = x.file_id AND w.page_idx = x.page_idx
    WHERE NOT coalesce((x0 < ra AND la < x1 AND top < ba AND ta < bottom) OR (x0 < rb AND lb < x1 AND top < bb AND tb < bottom), false)""",
    w=I.WORDS,
    b=I.BOXES,
)
def kept_words(w: DataFrame, b: DataFrame) -> DataFrame:
    return R.kept_words(w, _boxes(b)).select("file_id", "page_idx", "word_seq")


_FLAGGED = "SELECT 'f' AS file_id, CAST(l_orderkey AS INT) AS page_idx, CAST(l_linenumber AS INT) AS n, CAST(l_quantity * 11 AS DOUBLE) AS l, CAST(l_suppkey % 100 AS DOUBLE) AS t FROM lineitem"


@query(
    _BOXES
    + """SELECT f.file_id, f.page_idx, n, l, t FROM f LEFT JOIN x ON f.file_id = x.file_id AND f.page_idx = x.page_idx
    WHERE NOT coalesce((l < ra AND la < l + 20 AND t < ba AND ta < t + 10) OR (l < rb AND lb < l + 20 AND t < bb AND tb < t + 10), false)""",
    f=_FLAGGED,
    b=I.BOXES,
)
def uncovered_regions(f: DataFrame, b: DataFrame) -> DataFrame:
    flagged = f.select("file_id", "page_idx", "n", G.box(F.col("l"), F.col("t"), F.col("l") + 20, F.col("t") + 10).alias("box"))
    drawn = _boxes(b).select("file_id", "page_idx", F.explode("boxes").alias("box"))
    return R.uncovered_regions(flagged, drawn).select("file_id", "page_idx", "n", F.col("box.l").alias("l"), F.col("box.t").alias("t"))


@query(
    """SELECT file_id, page_idx, word_seq, round(greatest(4, bottom - top), 6) AS size, round(792 - top - greatest(4, bottom - top) * 0.8::DOUBLE, 6) AS baseline, replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)') AS escaped FROM w""",
    w=I.WORDS,
)
def text_operators(w: DataFrame) -> DataFrame:
    rows = R.text_operators(w, F.lit(792.0))
    return rows.select("file_id", "page_idx", "word_seq", F.round("size", 6).alias("size"), F.round("baseline", 6).alias("baseline"), X.pdf_escaped("text").alias("escaped"))


#: Printed borders on blank pages of 612 x 200 points; every fifth has none, and every third has labels that say where it is.
_BORDERS = """SELECT CAST(s_suppkey AS INT) AS page_idx, CAST(15 + s_suppkey % 46 AS INT) AS l, CAST(51 + s_suppkey % 13 AS INT) AS t, CAST(545 + s_suppkey % 53 AS INT) AS r, CAST(128 + s_suppkey % 27 AS INT) AS b,
  s_suppkey % 5 > 0 AS drawn, s_suppkey % 3 = 0 AS labelled FROM supplier"""


@query(
    """SELECT page_idx, drawn AS detected, CASE WHEN labelled THEN CASE WHEN drawn THEN l ELSE 38 END ELSE CASE WHEN drawn THEN least(l, 38) ELSE 38 END END::DOUBLE AS l,
    CASE WHEN labelled THEN CASE WHEN drawn THEN t ELSE t + 9 END ELSE CASE WHEN drawn THEN least(t, 58) ELSE 58 END END::DOUBLE AS t,
    CASE WHEN labelled THEN CASE WHEN drawn THEN r ELSE 574 END ELSE CASE WHEN drawn THEN greatest(r, 574) ELSE 574 END END::DOUBLE AS r,
    CASE WHEN labelled THEN CASE WHEN drawn THEN b ELSE b - 4 END ELSE CASE WHEN drawn THEN greatest(b, 148) ELSE 148 END END::DOUBLE AS b FROM p""",
    p=_BORDERS,
)
def detected_bands(p: DataFrame) -> DataFrame:
    """A border that is found stands as it is where labels say so, and is widened to the layout's band elsewhere."""
    white, black = (lambda n: F.repeat(F.lit("FF"), n)), (lambda n: F.repeat(F.lit("00"), n))
    c, width = F.col, 612
    blank, edge = white(F.lit(width)), F.concat(white(c("l")), black(c("r") - c("l") + 1), white(width - 1 - c("r")))
    sides = F.concat(white(c("l")), black(F.lit(1)), white(c("r") - c("l") - 1), black(F.lit(1)), white(width - 1 - c("r")))
    page = F.concat(F.repeat(blank, c("t")), edge, F.repeat(sides, c("b") - c("t") - 1), edge, F.repeat(blank, 199 - c("b")))
    grey = F.unhex(F.when(c("drawn"), page).otherwise(F.repeat(blank, F.lit(200))))
    key = F.lit("f").alias("file_id"), "page_idx"
    rasters = p.select(*key, grey.alias("grey"), F.lit(200).alias("n_rows"), F.lit(width).alias("n_cols"), F.lit(72.0).alias("dpi"))
    label = [c("labelled").alias(f"{name}_found") for name in ("name", "teacher", "group")]
    anchors = p.select(*key, (c("t") + 9.0).alias("name_top"), (c("b") - 24.0).alias("group_top"), F.lit(20.0).alias("row_height"), *label)
    return R.detect_bands(rasters, anchors).select("page_idx", "detected", "band.l", "band.t", "band.r", "band.b")


#: The decision table: the first condition that holds.
_DECIDE = r"""WITH j AS (SELECT p.tag, p.ord, d.sid, p.worksheet_type, p.issue, d.tag IS NOT NULL AS decided, l.path AS old_path, l.sid AS old_sid, r.sid IS NOT NULL AS known,
    p.tag IN (SELECT tag FROM held) AS held, p.tag IN (SELECT tag FROM borderless) AS borderless, p.tag IN (SELECT tag FROM leaking) AS leaking, p.tag IN (SELECT tag FROM seen) AS seen, p.tag IN (SELECT tag FROM confirmed) AS confirmed
  FROM p LEFT JOIN d ON p.tag = d.tag LEFT JOIN l ON p.tag = l.tag LEFT JOIN r ON d.sid = r.sid),
c AS (SELECT *, CASE WHEN NOT decided AND held THEN 'consent_hold/held_name' WHEN NOT decided THEN 'pending/no_decision' WHEN sid IS NULL AND old_path IS NOT NULL THEN 'rejected/deleted' WHEN sid IS NULL THEN 'rejected/no_consent'
    WHEN NOT known THEN 'held_back/not_on_roster' WHEN issue IS NOT NULL AND NOT (confirmed AND issue = 'total_mismatch') THEN 'held_back/issues' WHEN borderless AND NOT seen THEN 'held_back/border_not_detected'
    WHEN leaking THEN 'held_back/leak' ELSE 'written/ok' END AS v FROM j),
o AS (SELECT *, split_part(v, '/', 1) AS outcome, split_part(v, '/', 2) AS reason, concat_ws('/', substr(sid, 1, 6), worksheet_type, substr(sid, 7, 2), sid) AS base FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY outcome, base ORDER BY CASE WHEN regexp_replace(old_path, '(_[0-9]+)?\.pdf$', '') = base THEN coalesce(TRY_CAST(regexp_extract(old_path, '_([0-9]+)\.pdf$', 1) AS INT), 1) END NULLS LAST, ord, tag) AS place FROM o),
"""
#: The free numbers of each natural path among the ledger rows that stay, counted off one by one: place k takes the k-th.
_FREE = r"""kept AS (SELECT regexp_replace(path, '(_[0-9]+)?\.pdf$', '') AS base, coalesce(TRY_CAST(regexp_extract(path, '_([0-9]+)\.pdf$', 1) AS INT), 1) AS n FROM l WHERE tag NOT IN (SELECT tag FROM {gone})),
sizes AS (SELECT base, count(*) AS c, max(n) AS m FROM (SELECT base, 1 AS n FROM {wanted} UNION ALL SELECT base, n FROM kept) GROUP BY base),
free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS place FROM (SELECT base, unnest(range(1, c + m + 1)) AS n FROM sizes) AS s WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.base = s.base AND kept.n = s.n))
"""
_DECIDE += (
    _FREE.format(gone="o WHERE outcome IN ('written', 'rejected')", wanted="o WHERE outcome = 'written'")
    + """, z AS (SELECT tag, ord, sid, worksheet_type, outcome, reason, CASE WHEN outcome = 'written' THEN concat(q.base, CASE WHEN free.n > 1 THEN concat('_', free.n) ELSE '' END, '.pdf') END AS path, old_sid, old_path
  FROM q LEFT JOIN free ON q.base = free.base AND q.place = free.place)
"""
)
_RUN = {
    "p": I.RUN_PACKETS,
    "d": I.DECISIONS,
    "r": I.RUN_ROSTER,
    "l": I.LEDGER,
    "held": I.HELD_TAGS,
    "borderless": I.BORDERLESS_TAGS,
    "leaking": I.LEAK_TAGS,
    "seen": I.SEEN_TAGS,
    "confirmed": I.CONFIRMED_TAGS,
}


def _run(p: DataFrame, d: DataFrame, r: DataFrame, l: DataFrame, held: DataFrame, borderless: DataFrame, leaking: DataFrame, seen: DataFrame, confirmed: DataFrame) -> DataFrame:  # noqa: E741
    issue = F.struct(F.col("issue").alias("code"), F.lit(0).alias("page"), F.lit("").alias("detail"))
    packets = p.withColumn("issues", F.when(F.col("issue").isNotNull(), F.array(issue)).otherwise(F.array().cast(f"array<{S.ISSUE}>")))
    return O.decide(packets, d, r, l, held_matches=held, undetected=borderless, leaks=leaking, detection_overrides=seen, composition_overrides=confirmed)


@query(_DECIDE + "SELECT * FROM z", **_RUN)
def dispositions(**t: DataFrame) -> DataFrame:
    return _run(**t).drop("notes")


@query(
    _DECIDE
    + """SELECT count(*) AS n_packets, count(*) FILTER (outcome = 'written') AS n_written, count(*) FILTER (outcome = 'rejected') AS n_rejected, count(*) FILTER (outcome = 'held_back') AS n_held_back,
    count(*) FILTER (outcome = 'consent_hold') AS n_consent_hold, count(*) FILTER (outcome = 'pending') AS n_pending, count(*) FILTER (outcome = 'deletion_skipped') AS n_deletion_skipped, count(*) FILTER (reason = 'deleted') AS n_deleted FROM z""",
    **_RUN,
)
def run_summary(**t: DataFrame) -> DataFrame:
    return O.run_summary(_run(**t))


@query(
    _DECIDE
    + "SELECT tag, old_path FROM z WHERE old_path IS NOT NULL AND (reason = 'deleted' OR (outcome = 'written' AND old_path <> path)) AND old_path NOT IN (SELECT path FROM z WHERE path IS NOT NULL)",
    **_RUN,
)
def deletions(**t: DataFrame) -> DataFrame:
    return O.deletions(_run(**t))


@query(
    _DECIDE
    + """SELECT coalesce(l.tag, n.tag) AS tag, CASE WHEN n.tag IS NOT NULL THEN n.sid ELSE l.sid END AS sid, CASE WHEN n.tag IS NOT NULL THEN n.path ELSE l.path END AS path
    FROM l FULL JOIN (SELECT * FROM z WHERE outcome = 'written') n ON l.tag = n.tag WHERE coalesce(l.tag, n.tag) NOT IN (SELECT tag FROM z WHERE outcome = 'rejected')""",
    **_RUN,
)
def ledger_merge(**t: DataFrame) -> DataFrame:
    return O.merge_ledger(t["l"], _run(**t))


@query(
    _DECIDE
    + """, u AS (SELECT tag, 'x' AS sid, 'T' AS worksheet_type, 'older' AS reason FROM leaking), n AS (SELECT tag, sid, worksheet_type, reason FROM z WHERE reason = 'border_not_detected')
    SELECT * FROM u WHERE tag NOT IN (SELECT tag FROM n) UNION ALL SELECT * FROM n""",
    **_RUN,
)
def queue_enqueue(**t: DataFrame) -> DataFrame:
    queue = t["leaking"].select("tag", F.lit("x").alias("sid"), F.lit("T").alias("worksheet_type"), F.lit("older").alias("reason"))
    return O.enqueue(queue, _run(**t))


@query(
    _DECIDE
    + """, n AS (SELECT tag, sid, worksheet_type FROM z WHERE outcome = 'held_back'),
    g AS (SELECT n.*, CASE WHEN n.sid NOT IN (SELECT sid FROM r) THEN 'not_on_roster' WHEN tag IN (SELECT tag FROM borderless) AND tag NOT IN (SELECT tag FROM seen) THEN 'flagged_region_uncovered' WHEN tag IN (SELECT tag FROM leaking) THEN 'leak' ELSE 'ok' END AS release_reason,
      concat_ws('/', substr(sid, 1, 6), worksheet_type, substr(sid, 7, 2), sid) AS base FROM n),
    h AS (SELECT g.*, CASE WHEN regexp_replace(path, '(_[0-9]+)?\\.pdf$', '') = base THEN coalesce(TRY_CAST(regexp_extract(path, '_([0-9]+)\\.pdf$', 1) AS INT), 1) END AS own FROM g LEFT JOIN l ON g.tag = l.tag),
    y AS (SELECT *, row_number() OVER (PARTITION BY release_reason, base ORDER BY own NULLS LAST, tag) AS place FROM h), """
    + _FREE.replace("kept", "kept2").replace("sizes", "sizes2").replace("free", "free2").format(gone="g WHERE release_reason = 'ok'", wanted="g WHERE release_reason = 'ok'")
    + """SELECT tag, sid, release_reason = 'ok' AS released, release_reason, CASE WHEN release_reason = 'ok' THEN concat(y.base, CASE WHEN free2.n > 1 THEN concat('_', free2.n) ELSE '' END, '.pdf') END AS path
    FROM y LEFT JOIN free2 ON y.base = free2.base AND y.place = free2.place""",
    **_RUN,
)
def queue_release(**t: DataFrame) -> DataFrame:
    queue = _run(**t).where("outcome = 'held_back'").select("tag", "sid", "worksheet_type", "reason")
    uncovered = t["borderless"].join(t["seen"], "tag", "left_anti")
    return O.release(queue, t["r"], uncovered, t["leaking"], t["l"])


@query(
    _DECIDE
    + """SELECT coalesce(g.label, 'undated') AS label, count(*) AS n_packets, count(*) FILTER (outcome = 'written') AS n_clean, count(*) FILTER (reason = 'issues') AS n_issues,
    count(*) FILTER (reason = 'border_not_detected') AS n_border, count(*) FILTER (reason = 'leak') AS n_leak FROM z LEFT JOIN g ON z.tag = g.tag GROUP BY 1""",
    **_RUN,
    g=I.ROUND_OF_TAG,
)
def holds_by_round(g: DataFrame, **t: DataFrame) -> DataFrame:
    return O.holds_by_round(_run(**t), g)


@query(
    _DECIDE + "SELECT tag, sid, path, n_owners FROM (SELECT tag, sid, base AS path, count(*) OVER (PARTITION BY base) AS n_owners FROM o WHERE outcome = 'written') WHERE n_owners > 1",
    **_RUN,
)
def path_owners(**t: DataFrame) -> DataFrame:
    rows = _run(**t).where("outcome = 'written'").select("tag", "sid", O.natural_path("sid", "worksheet_type").alias("path"))
    return O.path_owner(rows)


@query(
    _DECIDE + "SELECT path, count(*) AS n_owners FROM (SELECT path FROM l WHERE tag NOT IN (SELECT tag FROM o WHERE outcome IN ('written', 'rejected')) UNION ALL SELECT path FROM z WHERE path IS NOT NULL) GROUP BY path",
    **_RUN,
)
def ledger_owners(**t: DataFrame) -> DataFrame:
    """Every path of the ledger after a run has one owner."""
    return O.merge_ledger(t["l"], _run(**t)).groupBy("path").agg(F.count("*").alias("n_owners"))


@query("SELECT tag, sid FROM d WHERE sid IS NOT NULL AND substr(sid, 7, 2) <> '02'", d=I.DECISIONS)
def scope_mismatches(d: DataFrame) -> DataFrame:
    return D.scope_mismatches(d, "02")


#: Preflight over the page stream: scores, held names and borders follow from the packet's place.
_PRE = """, v AS (SELECT k.*, (SELECT count(*) FROM i WHERE i.file_id = k.file_id AND i.packet_index = k.packet_index) AS n_issues, first_page % 3 <> 0 AS plausible, first_page % 5 = 1 AS auto, first_page % 7 <> 2 AS detected, first_page % 4 = 3 AS uncovered FROM k),
y AS (SELECT *, (n_issues > 0 OR NOT detected) AS blocked FROM v), e AS (SELECT *, NOT is_orphan AND NOT blocked AND plausible AS clean FROM y)
"""


def _preflight(p: DataFrame) -> DataFrame:
    packets = S.with_tags(S.segment_packets(p))
    first = F.get("page_indices", 0)
    return P.verdicts(
        packets.withColumns(
            {
                "top_score": F.when(first % 3 != 0, 90.0).otherwise(40.0),
                "auto_sid": F.when(first % 5 == 1, "x"),
                "detected": first % 7 != 2,
                "n_uncovered": F.when(first % 4 == 3, 2).otherwise(0),
            }
        )
    )


@query(
    _FOLD
    + _PRE
    + """SELECT count(*) AS n_packets, count(*) FILTER (page_count_mismatch) AS n_mismatch, count(*) FILTER (is_orphan) AS n_orphans, count(*) FILTER (NOT plausible) AS n_no_match, 0::BIGINT AS n_orientation, count(*) FILTER (blocked) AS n_blocked,
    count(*) FILTER (uncovered) AS n_advisory, count(*) FILTER (auto) AS n_auto, count(*) FILTER (clean) AS n_clean, count(*) FILTER (is_orphan) AS n_cannot_process, count(*) - count(*) FILTER (clean) - count(*) FILTER (is_orphan) AS n_needs_editor FROM e""",
    p=I.PAGE_STREAM,
)
def preflight_counts(p: DataFrame) -> DataFrame:
    return P.preflight_counts(_preflight(p))


@query(_FOLD + _PRE + "SELECT file_id, packet_index FROM e WHERE blocked AND NOT is_orphan AND NOT page_count_mismatch", p=I.PAGE_STREAM)
def preflight_other_blocked(p: DataFrame) -> DataFrame:
    return P.other_blocked(_preflight(p)).select("file_id", "packet_index")


@query(
    _FOLD
    + _PRE
    + """, z AS (SELECT i.file_id, coalesce(i.page, k.header_page, k.first_page) AS page_idx, code AS why FROM i JOIN k ON i.file_id = k.file_id AND i.packet_index = k.packet_index
    UNION ALL SELECT file_id, coalesce(header_page, first_page), 'no_match' FROM e WHERE NOT plausible)
    SELECT file_id, page_idx, count(DISTINCT why)::INT AS n_reasons FROM z GROUP BY ALL""",
    p=I.PAGE_STREAM,
)
def contact_sheet_reasons(p: DataFrame) -> DataFrame:
    return P.page_reasons(_preflight(p)).select("file_id", "page_idx", F.size("reasons").alias("n_reasons"))


_FLAGS = "SELECT concat('s', CAST(CAST(floor(conv_id / 6) AS INT) AS STRING)) AS file_id, CAST(conv_id % 6 AS INT) AS page_idx, 180 AS angle, CASE WHEN conv_id % 2 = 0 THEN 'pending' ELSE 'unresolved' END AS status FROM conversations WHERE turn = 0"


@query(
    _FOLD + "SELECT g.file_id, a.packet AS packet_index, g.page_idx, concat('orientation_', status) AS code FROM g JOIN a ON g.file_id = a.file_id AND g.page_idx = a.page_idx",
    p=I.PAGE_STREAM,
    g=_FLAGS,
)
def orientation_issues(p: DataFrame, g: DataFrame) -> DataFrame:
    packets = S.with_orientation_issues(S.segment_packets(p), g)
    rows = packets.select("file_id", "packet_index", F.explode("issues").alias("i")).where(F.startswith("i.code", F.lit("orientation_")))
    return rows.select("file_id", "packet_index", F.col("i.page").alias("page_idx"), F.col("i.code").alias("code"))
