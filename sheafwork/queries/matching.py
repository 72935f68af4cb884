"""Queries over name resolution and leak verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import fuzzy as Z
from sheafwork.operators import leak as L
from sheafwork.operators import match as M
from sheafwork.queries import inputs as I
from sheafwork.queries.registry import query

_CLASS = ["file_id"]


def _variant_scores(text: str, sorted_text: str) -> str:
    """DuckDB SQL: the best plain or token-sorted ratio over the variants of a name f, l."""
    parts = []
    for variant in ("fl", "lf", "l", "f"):
        ordered = "sfl" if variant in ("fl", "lf") else variant
        parts += [Z.ratio_sql(text, variant), Z.ratio_sql(sorted_text, ordered)]
    return f"greatest({', '.join(parts)})"


_SCORES = rf"""WITH n AS (SELECT *, trim(regexp_replace(lower(name_text), '\s+', ' ', 'g')) AS t FROM p), x AS (SELECT *, array_to_string(list_sort(string_split(t, ' ')), ' ') AS st FROM n),
e AS (SELECT file_id, ord AS eo, sid, first_name AS f, last_name AS l, concat(first_name, ' ', last_name) AS fl, concat(last_name, ' ', first_name) AS lf,
  array_to_string(list_sort([first_name, last_name]), ' ') AS sfl, held FROM (SELECT *, false AS held FROM r UNION ALL SELECT file_id, ord, '' AS sid, last_name, first_name, true AS held FROM h)),
s AS (SELECT x.file_id, x.tag, x.ord, x.round, eo, sid, held, concat(f, ' ', l) AS full_name, CASE WHEN length(replace(t, ' ', '')) < 3 THEN 0.0::DOUBLE ELSE {_variant_scores("t", "st")} END AS score FROM x JOIN e ON x.file_id = e.file_id),
k AS (SELECT *, row_number() OVER (PARTITION BY tag, held ORDER BY score DESC, eo) AS rank FROM s),
b AS (SELECT x.file_id, x.tag, x.ord, x.round, a.sid AS top_sid, a.score AS top_score, coalesce(a.score - coalesce(c.score, 0), 0) AS margin, hh.full_name AS held_name, hh.score AS held_score,
  (hh.score IS NOT NULL AND (a.score IS NULL OR hh.score >= a.score)) AS is_held_match
  FROM x LEFT JOIN k a ON x.tag = a.tag AND a.rank = 1 AND NOT a.held LEFT JOIN k c ON x.tag = c.tag AND c.rank = 2 AND NOT c.held LEFT JOIN k hh ON x.tag = hh.tag AND hh.rank = 1 AND hh.held),
w AS (SELECT *, row_number() OVER (PARTITION BY file_id, round, top_sid ORDER BY top_score DESC, ord) AS place FROM b WHERE top_score >= 82 AND margin >= 12 AND NOT is_held_match)
"""
_INPUTS = {"p": I.PROBES, "r": I.ROSTER, "h": I.HELD}


def _native(p: DataFrame, r: DataFrame, h: DataFrame) -> DataFrame:
    return M.propose(p, r, h, Z.native_name_score, _CLASS)


@query(_SCORES + "SELECT tag, sid, round(score, 9) AS score, rank::INT AS rank FROM k WHERE NOT held AND rank <= 5", **_INPUTS)
def propose_top_candidates(p: DataFrame, r: DataFrame, h: DataFrame) -> DataFrame:
    return M.best_candidates(p, r, Z.native_name_score, _CLASS).select("tag", "sid", F.round("score", 9).alias("score"), "rank")


@query(_SCORES + "SELECT tag, top_sid, round(top_score, 9) AS top_score, round(margin, 9) AS margin, held_name, round(held_score, 9) AS held_score, is_held_match FROM b", **_INPUTS)
def propose_margins(p: DataFrame, r: DataFrame, h: DataFrame) -> DataFrame:
    rows = _native(p, r, h)
    return rows.select("tag", "top_sid", *[F.round(c, 9).alias(c) for c in ("top_score", "margin")], "held_name", F.round("held_score", 9).alias("held_score"), "is_held_match")


@query(_SCORES + "SELECT b.tag, b.round, w.top_sid AS auto_sid FROM b LEFT JOIN w ON b.tag = w.tag AND w.place = 1", **_INPUTS)
def assign_exclusive(p: DataFrame, r: DataFrame, h: DataFrame) -> DataFrame:
    """Which packet belongs to which roster entry, and which abstain."""
    return M.assign_exclusive(_native(p, r, h)).select("tag", "round", "auto_sid")


@query(None, **_INPUTS)
def assign_exclusive_weighted(p: DataFrame, r: DataFrame, h: DataFrame) -> DataFrame:
    """The same with the weighted scorer, in Python over Arrow batches."""
    rows = M.assign_exclusive(M.propose(p, r, h, Z.name_score, _CLASS))
    return rows.select("tag", "round", "top_sid", F.round("top_score", 6).alias("top_score"), "auto_sid")


@query(
    """SELECT label, sid, array_to_string(tags, ' ') AS tags FROM (SELECT coalesce(label, 'undated') AS label, sid, list_sort(list(d.tag)) AS tags FROM d LEFT JOIN g ON d.tag = g.tag WHERE sid IS NOT NULL GROUP BY 1, 2) WHERE len(tags) > 1""",
    d=I.DECISIONS,
    g=I.ROUND_OF_TAG,
)
def duplicate_decisions(d: DataFrame, g: DataFrame) -> DataFrame:
    return M.duplicate_decisions(d, g).withColumn("tags", F.array_join("tags", " "))


#: A roster whose names are the words of the benchmark's texts: the first is the given name, the second the surname.
_BANNED = "SELECT lpad(CAST(item_id AS STRING), 10, '0') AS sid, split_part(text, ' ', 1) AS first_name, split_part(text, ' ', 2) AS last_name FROM benchmark"
_TOKENS = """WITH t AS (SELECT DISTINCT file_id, page_idx, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+'), lambda x: lower(x))) AS token FROM w),
n AS (SELECT DISTINCT sid, unnest(list_transform(regexp_extract_all(concat_ws(' ', first_name, last_name), '[A-Za-z'']+'), lambda x: lower(x))) AS token FROM r),
m AS (SELECT * FROM n WHERE length(token) >= 3),
x AS (SELECT t.file_id, t.page_idx, m.sid, t.token FROM t JOIN m ON t.token = m.token)
"""
_FUZZY = f""", a AS (SELECT DISTINCT token FROM t WHERE length(token) >= 5), b AS (SELECT DISTINCT token AS name FROM m WHERE length(token) >= 5),
c AS (SELECT token, name FROM a JOIN b ON greatest(length(token), length(name)) <= 1.5 * least(length(token), length(name)) WHERE {Z.ratio_sql("token", "name")} >= 80),
z AS (SELECT t.file_id, t.page_idx, m.sid, t.token FROM t JOIN c ON t.token = c.token JOIN m ON m.token = c.name
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file_id = t.file_id AND x.page_idx = t.page_idx AND x.sid = m.sid AND x.token = t.token)),
f AS (SELECT *, true AS exact FROM x UNION ALL SELECT *, false AS exact FROM z)
"""
_LEAK = {"w": I.OUTPUT_WORDS, "r": _BANNED}


@query(_TOKENS + "SELECT *, true AS exact FROM x", **_LEAK)
def leak_exact(w: DataFrame, r: DataFrame) -> DataFrame:
    return L.exact_findings(L.page_tokens(w), L.roster_tokens(r))


@query(_TOKENS + _FUZZY + "SELECT * FROM f", **_LEAK)
def leak_findings(w: DataFrame, r: DataFrame) -> DataFrame:
    return L.leak_findings(w, r)


@query(
    _TOKENS
    + _FUZZY
    + """, k AS (SELECT file_id, count(*) AS n, count(*) FILTER (exact) AS e FROM f GROUP BY 1)
    SELECT q.file_id, coalesce(n, 0) AS n_findings, coalesce(e, 0) AS n_exact, n IS NULL AS ok FROM (SELECT DISTINCT file_id FROM w) q LEFT JOIN k ON q.file_id = k.file_id""",
    **_LEAK,
)
def leak_report(w: DataFrame, r: DataFrame) -> DataFrame:
    return L.leak_report(w, r)


#: The whole tables: every word of the benchmark's texts is a name, and the documents are the output.
_ALL_BANNED = "SELECT lpad(CAST(item_id AS STRING), 10, '0') AS sid, text AS first_name, CAST(NULL AS STRING) AS last_name FROM benchmark"
_WHOLE_LEAK = {"w": I.DOCUMENT_WORDS, "r": _ALL_BANNED}


@query(_TOKENS + "SELECT *, true AS exact FROM x", **_WHOLE_LEAK)
def leak_exact_documents(w: DataFrame, r: DataFrame) -> DataFrame:
    return L.exact_findings(L.page_tokens(w), L.roster_tokens(r))


@query(None, **_WHOLE_LEAK)
def leak_findings_documents(w: DataFrame, r: DataFrame) -> DataFrame:
    """Exact and fuzzy findings; the SQL that compares all pairs is too slow here, a test compares them by brute force."""
    return L.leak_findings(w, r)


@query(None, **_WHOLE_LEAK)
def leak_report_documents(w: DataFrame, r: DataFrame) -> DataFrame:
    return L.leak_report(w, r)
