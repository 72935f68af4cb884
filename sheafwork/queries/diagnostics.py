"""Queries over diagnostics: hold evidence, second pages, and a reviewer's options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import geometry as G
from sheafwork.plans import diagnostics as P
from sheafwork.queries import inputs as I
from sheafwork.queries.registry import query

_FOUND = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN true ELSE o_custkey % 3 > 0 END AS detected, CASE WHEN o_custkey % 4 = 1 THEN NULL ELSE CAST(o_custkey % 4 AS INT) END AS n_uncovered, o_totalprice AS price, o_custkey AS cust FROM orders"


@query(
    """SELECT tag, CASE WHEN NOT coalesce(detected, false) THEN 'detection' WHEN coalesce(n_uncovered, 0) > 0 THEN 'uncovered_ink' WHEN price > 300000 THEN 'leak' ELSE 'clean' END AS hold_reason,
      CASE WHEN cust % 5 > 0 THEN CASE WHEN cust % 2 = 0 THEN 'rejected' ELSE 'matched' END WHEN NOT coalesce(detected, false) THEN 'blocked' ELSE 'open' END AS icon FROM t""",
    t=_FOUND,
)
def hold_evidence(t: DataFrame) -> DataFrame:
    leaks = F.when(F.col("price") > 300000, 1)
    blocked, decided, sid = ~F.coalesce("detected", F.lit(False)), F.col("cust") % 5 > 0, F.when(F.col("cust") % 2 == 1, "x")
    return t.select("tag", P.hold_reason("detected", "n_uncovered", leaks).alias("hold_reason"), P.icon(blocked, decided, sid).alias("icon"))


@query(
    """WITH x AS (SELECT file_id, page_idx, least(l1, r1) AS la, least(t1, b1) AS ta, greatest(l1, r1) AS ra, greatest(t1, b1) AS ba, least(l2, r2) AS lb, least(t2, b2) AS tb, greatest(l2, r2) AS rb, greatest(t2, b2) AS bb FROM b)
    SELECT w.file_id, w.page_idx, word_seq, coalesce(list_min(list_filter([la - x1, x0 - ra, ta - bottom, top - ba], lambda d: d > 0)), 0) AS gap_left,
      coalesce(list_min(list_filter([lb - x1, x0 - rb, tb - bottom, top - bb], lambda d: d > 0)), 0) AS gap_strip, top - greatest(ba, bb) AS below_band
    FROM w JOIN x ON w.file_id = x.file_id AND w.page_idx = x.page_idx""",
    w=I.WORDS,
    b=I.BOXES,
)
def word_evidence(w: DataFrame, b: DataFrame) -> DataFrame:
    c = F.col
    boxes = F.array(G.box(c("l1"), c("t1"), c("r1"), c("b1")), G.box(c("l2"), c("t2"), c("r2"), c("b2")))
    plan = b.select("file_id", "page_idx", boxes.alias("boxes")).withColumn("band", G.union_box("boxes"))
    return P.word_evidence(w, plan).select("file_id", "page_idx", "word_seq", "gap_left", "gap_strip", "below_band")


_SECOND = "SELECT 'f' AS file_id, concat('o', CAST(o_orderkey AS STRING)) AS tag, CAST(o_orderkey AS INT) AS page, CAST(1 + o_custkey % 2 AS INT) AS n FROM orders"


@query(
    """WITH g AS (SELECT page_idx, min(top) AS top FROM w WHERE top <= 188 AND text LIKE 'Plausib%' GROUP BY 1)
    SELECT tag, page AS page_idx, top IS NOT NULL AS title_found, coalesce(top, 35.04::DOUBLE) - 3 AS bottom FROM t LEFT JOIN g ON t.page = g.page_idx WHERE n = 2""",
    t=_SECOND,
    w=I.WORDS.replace("THEN 'Teacher:'", "THEN 'Plausibility'"),
)
def second_page_regions(t: DataFrame, w: DataFrame) -> DataFrame:
    pages = F.when(F.col("n") == 2, F.array(F.lit(-1), F.col("page"))).otherwise(F.array("page"))
    found = P.name_regions(t.withColumn("page_indices", pages), w)
    return found.select("tag", "page_idx", "title_found", F.col("box.b").alias("bottom"))


_CANDIDATES = "SELECT concat('o', CAST(l_orderkey AS STRING)) AS tag, CAST(l_suppkey AS STRING) AS sid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity) AS INT) AS rank FROM lineitem"
_REVIEWED = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Ann' END AS name_text, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS STRING) END AS auto_sid FROM orders"
_RECORDED = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_custkey AS STRING) END AS sid FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
_SEARCHED = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CAST(o_custkey % 100 AS STRING) AS sid FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM')"


@query(
    """WITH b AS (SELECT tag, list(sid ORDER BY rank) AS best FROM k WHERE rank <= 5 GROUP BY 1),
    j AS (SELECT p.*, coalesce(best, []) AS best, s.sid AS searched, d.sid AS recorded, d.tag IS NOT NULL AS decided FROM p LEFT JOIN b ON p.tag = b.tag LEFT JOIN s ON p.tag = s.tag LEFT JOIN d ON p.tag = d.tag),
    o AS (SELECT *, list_concat(best, CASE WHEN searched IS NOT NULL AND NOT list_contains(best, searched) THEN [searched] ELSE [] END) AS one, name_text = '' AND NOT decided AND searched IS NULL AS nothing FROM j)
    SELECT tag, array_to_string(list_concat(one, CASE WHEN recorded IS NOT NULL AND NOT list_contains(one, recorded) THEN [recorded] ELSE [] END), ',') AS options,
      CASE WHEN nothing THEN NULL WHEN decided THEN recorded ELSE coalesce(searched, auto_sid) END AS chosen, nothing AS "open" FROM o""",
    p=_REVIEWED,
    k=_CANDIDATES,
    d=_RECORDED,
    s=_SEARCHED,
)
def decision_options(p: DataFrame, k: DataFrame, d: DataFrame, s: DataFrame) -> DataFrame:
    return P.decision_options(p, k, d, s).select("tag", F.array_join("options", ",").alias("options"), "chosen", "open")
