"""Queries over scalar expressions: texts, dates, similarity, geometry, rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import dates as D
from sheafwork.functions import fuzzy as Z
from sheafwork.functions import geometry as G
from sheafwork.functions import text as X
from sheafwork.operators import orientation as R
from sheafwork.queries import inputs as I
from sheafwork.queries.registry import query
from sheafwork.session import ship_package
from sheafwork.sources import roster as S

_MARKERS = """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('Page ', CAST(turn + 1 AS STRING), ' of 4') WHEN 1 THEN concat('x Page  ', CAST(turn AS STRING), ' of  8 y')
  WHEN 2 THEN concat('Page 1 of 2 Page ', CAST(turn AS STRING), ' of 2') WHEN 3 THEN NULL ELSE text END AS footer FROM conversations"""


@query(
    r"""WITH m AS (SELECT conv_id, turn, regexp_extract_all(coalesce(footer, ''), 'Page\s+(\d+)\s+of\s+(\d+)', 1) AS a, regexp_extract_all(coalesce(footer, ''), 'Page\s+(\d+)\s+of\s+(\d+)', 2) AS b FROM t)
    SELECT conv_id, turn, CASE WHEN ok THEN num END AS page_num, CASE WHEN ok THEN total END AS page_total
    FROM (SELECT conv_id, turn, TRY_CAST(a[1] AS INT) AS num, TRY_CAST(b[1] AS INT) AS total, coalesce(len(a) = 1 AND TRY_CAST(a[1] AS INT) BETWEEN 1 AND TRY_CAST(b[1] AS INT), false) AS ok FROM m)""",
    t=_MARKERS,
)
def page_marker_parse(t: DataFrame) -> DataFrame:
    rows = t.select("conv_id", "turn", X.page_marker("footer").alias("m"))
    return rows.select("conv_id", "turn", F.col("m.num").alias("page_num"), F.col("m.total").alias("page_total"))


@query(
    r"""WITH m AS (SELECT p_partkey, regexp_extract(label, '(.+?)\s*\(?\d{2}[/\s]\d{4}\)?', 1) AS h FROM t)
    SELECT p_partkey, nullif(upper(regexp_replace(regexp_replace(h, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), '') AS slug FROM m""",
    t="SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, ' (0', CAST(1 + p_size % 9 AS STRING), '/2024)') WHEN 1 THEN concat('+', p_type, '+', p_brand, ' 12 2023 Page 1 of 2') WHEN 2 THEN p_name ELSE ' (01/2024)' END AS label FROM part",
)
def worksheet_slug(t: DataFrame) -> DataFrame:
    return t.select("p_partkey", X.worksheet_slug("label").alias("slug"))


@query(
    """SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(list_sort(w), ' ')) AS tokens_md5
    FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z'']+'), lambda x: lower(x))) AS w FROM t)""",
    t="SELECT doc_id, text FROM documents",
)
def tokenize_distinct(t: DataFrame) -> DataFrame:
    rows = t.select("doc_id", X.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("w"), " ").cast("binary")).alias("tokens_md5"))


@query(
    r"""WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS normal, first_name AS f, last_name AS l, name FROM t)
    SELECT c_custkey, normal, length(replace(normal, ' ', '')) < 3 AS too_short, concat(f, ' ', l, '|', l, ' ', f, '|', l, '|', f) AS variants FROM n""",
    t=f"SELECT c_custkey, concat('  ', upper({I.first_name('c_custkey')}), '   ', c_mktsegment, ' ') AS name, {I.first_name('c_custkey')} AS first_name, {I.last_name('c_custkey')} AS last_name FROM customer",
)
def normalize_names(t: DataFrame) -> DataFrame:
    return t.select("c_custkey", X.normalize_name("name").alias("normal"), X.too_short_to_read("name").alias("too_short"), F.array_join(X.name_variants("first_name", "last_name"), "|").alias("variants"))


_DATE_SQL = r"""
WITH s AS (SELECT o_orderkey, regexp_replace(coalesce(date_text, ''), '^\s+|\s+$', '', 'g') AS t FROM d),
n AS (SELECT o_orderkey, t, regexp_matches(t, '^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$') AS num, TRY_CAST(regexp_extract(t, '^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$', 1) AS INT) AS m,
  TRY_CAST(regexp_extract(t, '^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$', 2) AS INT) AS dd, TRY_CAST(regexp_extract(t, '^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$', 3) AS INT) AS y,
  TRY_CAST(regexp_extract(t, '\b((?:19|20)\d{2})\b', 1) AS INT) AS wy FROM s),
w AS (SELECT *, CASE WHEN num THEN CASE WHEN m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 THEN m END ELSE coalesce(__FULL__, __SHORT__) END AS month,
  CASE WHEN num THEN CASE WHEN y < 100 THEN y + 2000 ELSE y END ELSE wy END AS year FROM n)
"""
_DATE_SQL = _DATE_SQL.replace("__FULL__", "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '\\b{m.lower()}\\b') THEN {k + 1}" for k, m in enumerate(I._MONTHS)) + " END").replace(
    "__SHORT__", "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '\\b{m[:3].lower()}\\b') THEN {k + 1}" for k, m in enumerate(I._MONTHS)) + " END"
)


@query(_DATE_SQL + "SELECT o_orderkey, month FROM w", d=I.DATES)
def parse_month(d: DataFrame) -> DataFrame:
    return d.select("o_orderkey", D.parse_month("date_text").alias("month"))


@query(_DATE_SQL + "SELECT o_orderkey, CASE WHEN month IS NOT NULL AND year IS NOT NULL THEN printf('%04d-%02d', year, month) ELSE 'undated' END AS label FROM w", d=I.DATES)
def round_label(d: DataFrame) -> DataFrame:
    return d.select("o_orderkey", D.round_label("date_text").alias("label"))


@query(
    r"""WITH s AS (SELECT c_custkey, regexp_extract(path, '([^/]*)\.pdf$', 1) AS stem FROM t), n AS (SELECT *, regexp_extract(stem, '(?i)PD\s*0*(\d+)', 1) AS d FROM s)
    SELECT c_custkey, stem, CASE WHEN d = '' THEN NULL WHEN length(d) < 2 THEN lpad(d, 2, '0') ELSE d END AS period FROM n""",
    t="SELECT c_custkey, concat('in/x.y/', c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN ' PD' WHEN 1 THEN ' pd 0' WHEN 2 THEN '_' ELSE ' PD00' END, CAST(1 + c_nationkey AS STRING), '.v2.pdf') AS path FROM customer",
)
def period_from_file_name(t: DataFrame) -> DataFrame:
    return t.select("c_custkey", X.file_stem("path").alias("stem"), X.period_from_file_name("path").alias("period"))


@query(
    r"""SELECT p_partkey, regexp_replace(label, '[!-/:-@\[-`{-~]+$', '') AS stripped, replace(replace(replace(label, '\', '\\'), '(', '\('), ')', '\)') AS escaped,
      CASE WHEN length(CAST(p_size AS VARCHAR)) < 2 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE CAST(p_size AS VARCHAR) END AS filled,
      printf('%s_p%03d', p_brand, p_partkey) AS tag, concat('d/', p_brand, '_holds.csv') AS sidecar,
      CASE WHEN p_size % 2 = 0 THEN concat('SID: ', lpad(CAST(p_partkey AS VARCHAR), 10, '0'), '|PD: ', substr(lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 7, 2)) ELSE 'REDACTED' END AS stamp,
      CASE WHEN p_size % 3 = 0 THEN p_size ELSE -1 END AS issue_page, list_extract(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'], p_size) AS month_name
    FROM t""",
    t="SELECT p_partkey, CAST(p_size AS INT) AS p_size, p_brand, concat(p_name, CASE p_size % 3 WHEN 0 THEN '.,!' WHEN 1 THEN ' (a)' ELSE '' END) AS label FROM part",
)
def text_scalars(t: DataFrame) -> DataFrame:
    sid = F.when(F.col("p_size") % 2 == 0, F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    issue = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("page "), F.col("p_size").cast("string"), F.lit(": unreadable"))).otherwise("packet has 3 pages")
    return t.select(
        "p_partkey",
        X.strip_trailing_punctuation("label").alias("stripped"),
        X.pdf_escaped("label").alias("escaped"),
        X.zero_filled("p_size").alias("filled"),
        X.packet_tag("p_brand", "p_partkey").alias("tag"),
        X.sidecar_path(F.concat(F.lit("d/"), F.col("p_brand"), F.lit(".csv")), "_holds.csv").alias("sidecar"),
        F.array_join(X.stamp_lines(sid), "|").alias("stamp"),
        X.issue_page(issue, F.lit(-1)).alias("issue_page"),
        D.month_name("p_size").alias("month_name"),
    )


_PAIR = f"SELECT c_custkey, concat({I.first_name('c_custkey')}, ' ', {I.last_name('c_custkey')}) AS a, concat({I.last_name('c_custkey + 7')}, ' ', {I.first_name('c_custkey')}) AS b FROM customer"


@query(
    f"""WITH s AS (SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM t)
    SELECT c_custkey, round({Z.ratio_sql("a", "b")}, 9) AS ratio, round({Z.ratio_sql("sa", "sb")}, 9) AS token_sort FROM s""",
    t=_PAIR,
)
def fuzzy_ratio(t: DataFrame) -> DataFrame:
    return t.select("c_custkey", F.round(Z.ratio("a", "b"), 9).alias("ratio"), F.round(Z.token_sort_ratio("a", "b"), 9).alias("token_sort"))


@query(None, t=_PAIR)
def fuzzy_weighted(t: DataFrame) -> DataFrame:
    """The weighted ratio, over Arrow batches; golden scores and the plain ratio bound it in the tests."""
    ship_package(t.sparkSession)
    return t.select("c_custkey", F.round(Z.weighted_ratio("a", "b"), 9).alias("weighted"))


_VIOLATIONS = r"""WITH b AS (SELECT *, sum(CASE WHEN sid = '' AND last_name = '' AND first_name = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY row_num) AS block FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY file_id, sid ORDER BY row_num) AS nth, first_value(substr(sid, 7, 2)) OVER (PARTITION BY file_id, block ORDER BY row_num) AS bp
  FROM b WHERE NOT (sid = '' AND last_name = '' AND first_name = '')),
v AS (SELECT file_id, row_num, CASE WHEN sid = '' OR last_name = '' OR first_name = '' THEN 'partly_blank' WHEN NOT regexp_matches(sid, '^\d{10}$') THEN 'malformed_sid'
  WHEN nth > 1 THEN 'duplicate_sid' WHEN substr(sid, 7, 2) <> bp THEN 'period_mismatch' END AS code, sid FROM f)
"""


@query(
    _VIOLATIONS
    + """SELECT * FROM v WHERE code IS NOT NULL UNION ALL SELECT file_id, row_num, 'held_name', sid FROM f
    WHERE EXISTS (SELECT 1 FROM h WHERE h.file_id = f.file_id AND lower(h.last_name) = lower(f.last_name) AND lower(h.first_name) = lower(f.first_name))""",
    r=I.ROSTER_ROWS,
    h=I.HELD_NAMES,
)
def roster_violations(r: DataFrame, h: DataFrame) -> DataFrame:
    return S.roster_violations(r, h, ["file_id"])


@query(
    """SELECT row_num AS ord, sid, last_name, first_name, concat_ws(' ', first_name, last_name) AS full_name, substr(sid, 1, 6) AS teacher_code, substr(sid, 7, 2) AS period, substr(sid, 9, 2) AS student_index
    FROM r WHERE NOT (sid = '' AND last_name = '' AND first_name = '')""",
    r=I.ROSTER_ROWS,
)
def roster_entries(r: DataFrame) -> DataFrame:
    return S.entries(r)


@query(
    """SELECT row_num AS ord, sid, concat_ws(' ', first_name, last_name) AS full_name FROM r
    WHERE NOT (sid = '' AND last_name = '' AND first_name = '') AND substr(sid, 7, 2) = '01' AND contains(lower(concat_ws(' ', first_name, last_name)), 'ae')""",
    r=I.ROSTER_ROWS,
)
def period_and_name_filter(r: DataFrame) -> DataFrame:
    return S.search(S.in_period(S.entries(r), 1), " AE ").select("ord", "sid", "full_name")


_CLEAN = r"""WITH c AS (SELECT row_num, regexp_replace(trim(sid), '[!-/:-@\[-`{-~]+$', '') AS sid, regexp_replace(trim(last_name), '[!-/:-@\[-`{-~]+$', '') AS last_name,
  regexp_replace(trim(first_name), '[!-/:-@\[-`{-~]+$', '') AS first_name FROM r), n AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM c)
"""


@query(_CLEAN + "SELECT row_num, sid, last_name, first_name FROM n WHERE n = 1 OR sid = ''", r=I.RAW_ROSTER)
def prepare_roster_clean(r: DataFrame) -> DataFrame:
    return S.prepare_roster(r)[0]


@query(
    _CLEAN
    + """SELECT ord, last_name, first_name FROM h UNION ALL SELECT min(row_num) + 1000000 AS ord, last_name, first_name FROM n
    WHERE n > 1 AND sid <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.last_name = n.last_name AND h.first_name = n.first_name) GROUP BY last_name, first_name""",
    r=I.RAW_ROSTER,
    h=I.HELD_NAMES.replace("upper(", "("),
)
def prepare_roster_held(r: DataFrame, h: DataFrame) -> DataFrame:
    return S.prepare_roster(r, h)[1]


_SHAPES = """SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS n, CAST(l_quantity AS DOUBLE) AS x, CAST(l_suppkey AS DOUBLE) AS y, CAST(l_partkey % 97 AS DOUBLE) AS w, CAST(l_discount * 100 AS DOUBLE) AS h, CAST(l_partkey % 90 AS DOUBLE) AS g FROM lineitem"""


@query(
    """WITH b AS (SELECT *, least(x, w) AS l, least(y, h) AS t, greatest(x, w) AS r, greatest(y, h) AS b FROM s)
    SELECT k, n, x, y, w, h, g, l, t, r, b, (l < 40 AND 10 < r AND t < 60 AND 5 < b) AS meets, least(greatest(g + 2, t), b) AS strip_top, least(400, r) AS column_right,
      coalesce(list_min(list_filter([l - 40, 10 - r, t - 60, 5 - b], lambda d: d > 0)), 0) AS gap, least(l, 10) AS union_left, greatest(b, 60) AS union_bottom,
      x + w * 2 AS canvas_right, ((g::BIGINT - (90 * (n % 4))) % 360 + 360) % 360 AS upright, greatest(4, h) AS font_size, 792 - y - greatest(4, h) * 0.8::DOUBLE AS baseline,
      least(greatest(CASE WHEN x <= 0 THEN 72 ELSE round_even(50400 / x, 0) END, 72), 300)::INT AS dpi
    FROM b""",
    s=_SHAPES,
)
def box_geometry(s: DataFrame) -> DataFrame:
    c = {name: F.col(name) for name in s.columns}
    rows = s.withColumn("box", G.box(c["x"], c["y"], c["w"], c["h"]))
    other = G.box(F.lit(40.0), F.lit(60.0), F.lit(10.0), F.lit(5.0))
    box = F.col("box")
    union = G.union_box(F.array(box, other))
    rect = F.struct(c["x"].alias("left"), c["y"].alias("top"), c["w"].alias("width"), c["h"].alias("height"), F.lit(2.0).alias("scaleX"), F.lit(None).cast("double").alias("scaleY"))
    boxes = G.header_boxes("box", "g")
    return rows.select(
        *s.columns,
        "box.*",
        G.overlaps(box, other).alias("meets"),
        F.get(boxes, 1)["t"].alias("strip_top"),
        F.get(boxes, 0)["r"].alias("column_right"),
        G.gap(box, other).alias("gap"),
        union["l"].alias("union_left"),
        union["b"].alias("union_bottom"),
        G.from_canvas(rect)["r"].alias("canvas_right"),
        G.upright(c["g"].cast("long"), 90 * (c["n"] % 4)).alias("upright"),
        G.font_size(c["h"]).alias("font_size"),
        G.baseline(F.lit(792.0), c["y"], G.font_size(c["h"])).alias("baseline"),
        G.editor_dpi("x").alias("dpi"),
    )


_WIDTHS = ", ".join(map(str, G.HELVETICA))


@query(
    f"""WITH w AS (SELECT p_partkey, list_sum(list_transform(string_split(p_name, ''), lambda c: CASE WHEN ord(c) BETWEEN 32 AND 126 THEN list_extract([{_WIDTHS}], ord(c) - 31) ELSE 556 END)) * size / 1000.0::DOUBLE AS nw, size, p_size FROM t)
    SELECT p_partkey, round(nw, 9) AS natural_width, round(least(greatest(p_size / nw, 0.05::DOUBLE), 20.0::DOUBLE), 9) AS scale FROM w""",
    t="SELECT p_partkey, p_name, CAST(4 + p_size % 9 AS DOUBLE) AS size, CAST(p_size AS DOUBLE) AS p_size FROM part",
)
def text_widths(t: DataFrame) -> DataFrame:
    rows = t.withColumn("natural", G.advance_width("p_name", "size", G.helvetica_widths()))
    return rows.select("p_partkey", F.round("natural", 9).alias("natural_width"), F.round(G.horizontal_scale("p_size", "natural"), 9).alias("scale"))


_RESOLVED = """WITH j AS (SELECT d.*, o.angle AS human, coalesce(score >= 0.6::DOUBLE AND coalesce(abs(skew), 0) <= 3, false) AS sure FROM d LEFT JOIN o ON d.file_id = o.file_id AND d.page_idx = o.page_idx),
a AS (SELECT *, CASE WHEN human IS NOT NULL THEN human WHEN sure AND angle = 0 THEN 0 END AS applied FROM j)
"""


@query(
    _RESOLVED
    + """SELECT file_id, page_idx, sure AS confident, applied AS applied_angle, CASE WHEN human IS NOT NULL THEN 'human' WHEN sure AND angle = 0 THEN 'auto' ELSE 'none' END AS source,
      (human IS NULL AND sure AND angle <> 0) AS needs_confirmation, applied IS NOT NULL AS resolved, coalesce(applied <> 0, false) AS rotated FROM a""",
    d=I.DETECTIONS,
    o=I.ORIENTATION_OVERRIDES,
)
def orientation_resolve(d: DataFrame, o: DataFrame) -> DataFrame:
    return R.resolve(d, o).drop("angle", "score", "skew")


@query(
    _RESOLVED + "SELECT file_id, page_idx, angle, CASE WHEN human IS NULL AND sure AND angle <> 0 THEN 'pending' ELSE 'unresolved' END AS status FROM a WHERE applied IS NULL",
    d=I.DETECTIONS,
    o=I.ORIENTATION_OVERRIDES,
)
def orientation_flags(d: DataFrame, o: DataFrame) -> DataFrame:
    return R.flags(R.resolve(d, o))


@query("SELECT file_id, sha1(string_agg(e, ',' ORDER BY e)) AS fingerprint FROM (SELECT file_id, printf('%d:%d', page_idx, angle) AS e FROM o) GROUP BY file_id", o=I.ORIENTATION_OVERRIDES)
def overrides_fingerprint(o: DataFrame) -> DataFrame:
    return R.overrides_fingerprint(o)


@query(
    "SELECT d.file_id, d.page_idx, coalesce(o.angle, -1) AS found FROM d LEFT JOIN o ON d.file_id = o.file_id AND d.page_idx = o.page_idx",
    d=I.DETECTIONS,
    o=I.ORIENTATION_OVERRIDES,
)
def cache_get_or_compute(d: DataFrame, o: DataFrame) -> DataFrame:
    """Cached rows where there are some; only the misses are computed (here to -1)."""
    keys = ["file_id", "page_idx"]
    found, _ = R.cached(d.select(*keys), o.select(*keys, "angle"), lambda misses: misses.select(*keys, F.lit(-1).alias("angle")), keys)
    return found.select(*keys, F.col("angle").alias("found"))
