"""Queries over pages, packets, header fields and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.operators import rounds as D
from sheafwork.operators import segmentation as S
from sheafwork.queries import inputs as I
from sheafwork.queries.registry import query

#: The packet fold as a recursive query: s holds, for each page, the packet it went to and the state before and after.
_FOLD = """WITH RECURSIVE s AS (
  SELECT file_id, page_idx, 1 AS packet, 1 AS n, CASE WHEN readable THEN page_total END AS total, true AS opened FROM p WHERE page_idx = 0
  UNION ALL
  SELECT file_id, page_idx, CASE WHEN cont THEN packet ELSE packet + 1 END, CASE WHEN cont THEN n + 1 ELSE 1 END, CASE WHEN cont THEN total WHEN readable THEN page_total END, NOT cont
  FROM (SELECT p.file_id, p.page_idx, s.packet, s.n, s.total, p.readable, p.page_total,
      NOT p.is_header AND NOT coalesce(s.total <= s.n, false) AND NOT coalesce(p.readable AND p.page_num <> s.n + 1, false) AS cont
    FROM s JOIN p ON p.file_id = s.file_id AND p.page_idx = s.page_idx + 1)
), a AS (SELECT s.packet, s.n, s.total, s.opened, p.* FROM s JOIN p ON s.file_id = p.file_id AND s.page_idx = p.page_idx),
k AS (SELECT file_id, packet AS packet_index, min(page_idx)::INT AS first_page, count(*)::INT AS n_pages, max(total)::INT AS declared_total, NOT bool_or(opened AND is_header) AS is_orphan,
  max(CASE WHEN opened AND is_header THEN worksheet_type END) AS worksheet_type, max(CASE WHEN opened AND is_header THEN page_idx END)::INT AS header_page,
  coalesce(count(*) <> max(total), false) AS page_count_mismatch FROM a GROUP BY ALL),
i AS (SELECT file_id, packet AS packet_index, page_idx AS page, unnest(list_filter([
    CASE WHEN opened AND is_header AND NOT readable THEN 'footer_unreadable' END, CASE WHEN opened AND is_header AND readable AND page_num <> 1 THEN 'header_not_first' END,
    CASE WHEN opened AND is_header AND worksheet_type IS NULL THEN 'type_unreadable' END, CASE WHEN opened AND NOT is_header THEN 'no_header' END,
    CASE WHEN opened AND NOT is_header AND NOT readable THEN 'footer_unreadable' END, CASE WHEN NOT opened AND NOT readable THEN 'sequence_unreadable' END,
    CASE WHEN NOT opened AND readable AND page_total <> total THEN 'total_differs' END], lambda x: x IS NOT NULL)) AS code FROM a
  UNION ALL SELECT file_id, packet_index, NULL, 'total_mismatch' FROM k WHERE page_count_mismatch)
"""


def _packets(p: DataFrame) -> DataFrame:
    return S.with_tags(S.segment_packets(p))


@query(
    _FOLD + "SELECT file_id, packet_index, printf('%s_p%03d', file_id, first_page) AS tag, first_page, n_pages, declared_total, is_orphan, worksheet_type, header_page, page_count_mismatch FROM k",
    p=I.PAGE_STREAM,
)
def segment_packets(p: DataFrame) -> DataFrame:
    return _packets(p).select("file_id", "packet_index", "tag", F.get("page_indices", 0).alias("first_page"), "n_pages", "declared_total", "is_orphan", "worksheet_type", "header_page", "page_count_mismatch")


@query(_FOLD + "SELECT file_id, packet_index, page, code FROM i", p=I.PAGE_STREAM)
def segment_issues(p: DataFrame) -> DataFrame:
    return S.segment_packets(p).select("file_id", "packet_index", F.explode("issues").alias("i")).select("file_id", "packet_index", "i.page", "i.code")


@query(
    _FOLD + "SELECT file_id, packet_index, bool_and(code IN ('total_mismatch', 'footer_unreadable', 'sequence_unreadable', 'out_of_sequence', 'total_differs')) AS confirmable FROM i GROUP BY ALL",
    p=I.PAGE_STREAM,
)
def issues_confirmable(p: DataFrame) -> DataFrame:
    return S.segment_packets(p).where(F.size("issues") > 0).select("file_id", "packet_index", S.issues_confirmable("issues").alias("confirmable"))


@query(
    _FOLD
    + """SELECT o.file_id, o.first_page AS continuation_page, h.header_page, o.declared_total FROM k o JOIN k h ON o.file_id = h.file_id AND h.header_page = o.first_page + 1 AND h.declared_total = o.declared_total
    WHERE o.is_orphan AND o.n_pages = 1""",
    p=I.PAGE_STREAM,
)
def reversed_pairs(p: DataFrame) -> DataFrame:
    return S.reversed_pairs(S.segment_packets(p))


@query(_FOLD + 'SELECT file_id, packet AS packet_index, page_idx, n AS "offset" FROM a', p=I.PAGE_STREAM)
def page_places(p: DataFrame) -> DataFrame:
    return S.page_places(S.segment_packets(p))


_ORDERS = "SELECT concat('s', CAST(CAST(floor(conv_id / 6) AS INT) AS STRING)) AS file_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1"


@query(
    """SELECT file_id, n, array_to_string(list_concat(range(2, least(5, n)), [1], range(least(5, n), n)), ',') AS moved, array_to_string(list_concat([0], range(2, n)), ',') AS removed,
      array_to_string(list_concat(range(1, n - 1), [0], [n - 1]), ',') AS inserted, 1 AS n_removed FROM t""",
    t=_ORDERS,
)
def page_sequence_edits(t: DataFrame) -> DataFrame:
    """Page 1 moved behind page 4 of a sequence without page 0, page 1 removed, page 0 put before the last page."""
    rows = t.withColumn("seq", F.sequence(F.lit(0), F.col("n") - 1))
    without = S.remove_page("seq", F.lit(0))
    removed = S.remove_page("seq", F.lit(1))
    return rows.select(
        "file_id",
        "n",
        F.array_join(S.move_page(without, F.lit(1), F.least(F.lit(3), F.col("n") - 2)), ",").alias("moved"),
        F.array_join(removed, ",").alias("removed"),
        F.array_join(S.insert_page("seq", F.lit(0), F.col("n") - 1), ",").alias("inserted"),
        F.size(S.removed_pages(removed, F.col("n"))).alias("n_removed"),
    )


_REVERSED = "SELECT concat('s', CAST(CAST(floor(conv_id / 6) AS INT) AS STRING)) AS file_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1"


@query(
    """SELECT p.file_id, p.page_idx, CASE WHEN n >= 40 THEN n - 1 - p.page_idx ELSE p.page_idx END AS ord FROM p JOIN t ON p.file_id = t.file_id WHERE n < 40 OR p.page_idx < n - 1""",
    p=I.PAGE_STREAM,
    t=_REVERSED,
)
def page_sequence_applied(p: DataFrame, t: DataFrame) -> DataFrame:
    """Files of 40 pages and more in reversed order without their last page; the others as they are."""
    sequences = t.where("n >= 40").select("file_id", F.concat(F.array(F.lit(-1)), F.reverse(F.sequence(F.lit(0), F.col("n") - 2))).alias("sequence"))
    return S.apply_page_sequence(p, sequences).select("file_id", "page_idx", F.col("ord").cast("long").alias("ord"))


_FEATURES = r"""WITH f AS (SELECT file_id, page_idx, bool_or(top <= 188 AND lower(trim(text)) IN ('name:', 'name')) AS h,
  coalesce(string_agg(text, ' ' ORDER BY top, x0, text) FILTER (top >= 700), '') AS foot, coalesce(string_agg(text, ' ' ORDER BY top, x0, text) FILTER (top >= 700 AND x0 < 336.5), '') AS kind FROM w GROUP BY ALL),
j AS (SELECT p.file_id, p.page_idx, p.height > 700 AS fits, coalesce(h, false) AS is_header, regexp_extract_all(coalesce(foot, ''), 'Page\s+(\d+)\s+of\s+(\d+)', 1) AS a,
  regexp_extract_all(coalesce(foot, ''), 'Page\s+(\d+)\s+of\s+(\d+)', 2) AS b, regexp_extract(coalesce(kind, ''), '(.+?)\s*\(?\d{2}[/\s]\d{4}\)?', 1) AS t
  FROM p LEFT JOIN f ON p.file_id = f.file_id AND p.page_idx = f.page_idx),
m AS (SELECT *, fits AND len(a) = 1 AND coalesce(TRY_CAST(a[1] AS INT) BETWEEN 1 AND TRY_CAST(b[1] AS INT), false) AS ok FROM j)
"""


@query(
    _FEATURES
    + """SELECT file_id, page_idx, is_header, CASE WHEN ok THEN a[1]::INT END AS page_num, CASE WHEN ok THEN b[1]::INT END AS page_total, ok AS readable,
      CASE WHEN fits THEN nullif(upper(regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), '') END AS worksheet_type FROM m""",
    p=I.PAGES,
    w=I.WORDS,
)
def page_features(p: DataFrame, w: DataFrame) -> DataFrame:
    return S.page_features(p, w)


_ANCHORS = """WITH g AS (SELECT file_id, page_idx, min(CASE WHEN lower(trim(text)) IN ('name:', 'name') THEN top END) AS n, min(CASE WHEN lower(trim(text)) IN ('teacher:', 'teacher') THEN top END) AS t,
  min(CASE WHEN lower(trim(text)) = 'group' THEN top END) AS g FROM w WHERE top <= 188 GROUP BY ALL),
a AS (SELECT file_id, page_idx, coalesce(n, 68) AS name_top, coalesce(t, 87) AS teacher_top, coalesce(g, 111) AS group_top, n IS NOT NULL AS name_found, t IS NOT NULL AS teacher_found, g IS NOT NULL AS group_found FROM g),
h AS (SELECT *, CASE WHEN group_top > teacher_top THEN group_top - teacher_top WHEN teacher_top > name_top THEN teacher_top - name_top ELSE 24 END AS row_height FROM a),
r AS (SELECT w.*, CASE WHEN abs(top - name_top) <= abs(top - teacher_top) AND abs(top - name_top) <= abs(top - group_top) THEN 'name' WHEN abs(top - teacher_top) <= abs(top - group_top) THEN 'teacher' ELSE 'group' END AS row
  FROM w JOIN h ON w.file_id = h.file_id AND w.page_idx = h.page_idx WHERE top <= 188 AND top >= least(name_top, teacher_top, group_top) - 20 AND top <= least(188, group_top + row_height + 10))
"""


@query(_ANCHORS + "SELECT * FROM h", w=I.WORDS)
def header_anchors(w: DataFrame) -> DataFrame:
    return S.header_anchors(w)


@query(_ANCHORS + 'SELECT file_id, page_idx, word_seq, "row" FROM r', w=I.WORDS)
def nearest_rows(w: DataFrame) -> DataFrame:
    return S.row_words(w, S.header_anchors(w)).select("file_id", "page_idx", "word_seq", "row")


@query(
    _ANCHORS
    + """, l AS (SELECT *, lower(trim(text)) AS low FROM r),
    c AS (SELECT file_id, page_idx, string_agg(text, ' ' ORDER BY x0, text) FILTER (row = 'name' AND low NOT IN ('name:', 'name', 'date:', 'date') AND x0 < 400) AS name_text,
      string_agg(text, ' ' ORDER BY x0, text) FILTER (row = 'teacher' AND low NOT IN ('teacher:', 'teacher', 'period:', 'period') AND x0 < 400) AS teacher_text,
      string_agg(text, ' ' ORDER BY x0, text) FILTER (row = 'group' AND low NOT IN ('group', 'members,', 'members', 'if', 'any:', 'any')) AS group_text,
      string_agg(text, ' ' ORDER BY x0, text) FILTER (row = 'name' AND low NOT IN ('name:', 'name', 'date:', 'date') AND x0 >= 400) AS date_text,
      string_agg(text, ' ' ORDER BY x0, text) FILTER (row = 'teacher' AND low NOT IN ('teacher:', 'teacher', 'period:', 'period') AND x0 >= 400) AS period_text FROM l GROUP BY ALL)
    SELECT h.file_id, h.page_idx, coalesce(name_text, '') AS name_text, coalesce(teacher_text, '') AS teacher_text, coalesce(group_text, '') AS group_text, coalesce(date_text, '') AS date_text, coalesce(period_text, '') AS period_text
    FROM h LEFT JOIN c ON h.file_id = c.file_id AND h.page_idx = c.page_idx""",
    w=I.WORDS,
)
def header_fields(w: DataFrame) -> DataFrame:
    return S.header_fields(w).select("file_id", "page_idx", "name_text", "teacher_text", "group_text", "date_text", "period_text")


#: The rule of rounds as a recursive query over the dated packets, one at a time.
_ROUNDS = r"""WITH RECURSIVE l AS (SELECT *, CASE WHEN regexp_matches(trim(date_text), '^\d{1,2}/\d{1,2}/\d{4}$')
    THEN printf('%04d-%02d', regexp_extract(trim(date_text), '(\d{4})$', 1)::INT, regexp_extract(trim(date_text), '^(\d+)/', 1)::INT) END AS own FROM d),
x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS k, lead(own) OVER (PARTITION BY file_id ORDER BY ord) AS nxt FROM l WHERE own IS NOT NULL),
s AS (SELECT file_id, k, own AS anchor, 0 AS grp FROM x WHERE k = 1
  UNION ALL SELECT x.file_id, x.k, CASE WHEN x.own <> s.anchor AND (x.nxt IS NULL OR x.nxt <> s.anchor) THEN x.own ELSE s.anchor END,
    CASE WHEN x.own <> s.anchor AND (x.nxt IS NULL OR x.nxt <> s.anchor) THEN s.grp + 1 ELSE s.grp END FROM s JOIN x ON x.file_id = s.file_id AND x.k = s.k + 1),
g AS (SELECT l.*, coalesce(last_value(s.grp IGNORE NULLS) OVER (PARTITION BY l.file_id ORDER BY l.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS group_id
  FROM l LEFT JOIN x ON l.file_id = x.file_id AND l.ord = x.ord LEFT JOIN s ON x.file_id = s.file_id AND x.k = s.k),
v AS (SELECT file_id, group_id, own, count(*) AS n, min(ord) AS seen FROM g WHERE own IS NOT NULL GROUP BY ALL),
b AS (SELECT file_id, group_id, arg_max(own, n * 1000000 - seen) AS label FROM v GROUP BY ALL),
r AS (SELECT g.*, coalesce(label, 'undated') AS label FROM g LEFT JOIN b ON g.file_id = b.file_id AND g.group_id = b.group_id),
u AS (SELECT file_id, group_id::BIGINT AS group_id, any_value(label) AS label, count(*) AS n_packets, min(first_page) + 1 AS first_page, max(last_page) + 1 AS last_page, count(*) FILTER (own <> label) AS n_disagreeing FROM r GROUP BY ALL)
"""


@query(_ROUNDS + "SELECT file_id, tag, own AS own_label, group_id::BIGINT AS group_id, label FROM r", d=I.DATED)
def round_groups(d: DataFrame) -> DataFrame:
    return D.round_groups(d).select("file_id", "tag", "own_label", "group_id", "label")


@query(_ROUNDS + "SELECT * FROM u", d=I.DATED)
def round_summary(d: DataFrame) -> DataFrame:
    return D.round_summary(D.round_groups(d))


@query(_ROUNDS + "SELECT file_id, tag FROM r WHERE own <> label", d=I.DATED)
def round_disagreeing(d: DataFrame) -> DataFrame:
    return D.round_groups(d).where(D.disagrees()).select("file_id", "tag")


@query(_ROUNDS + "SELECT file_id, label, count(*) AS n_rounds FROM u WHERE label <> 'undated' GROUP BY ALL HAVING count(*) > 1", d=I.DATED)
def duplicate_round_labels(d: DataFrame) -> DataFrame:
    return D.duplicate_round_labels(D.round_summary(D.round_groups(d)))


@query(_ROUNDS + "SELECT file_id, tag FROM r WHERE label = '2031-02'", d=I.DATED)
def round_filter(d: DataFrame) -> DataFrame:
    return D.in_round(d, D.round_groups(d), "2031-02").select("file_id", "tag")


_MONTHS = r"""WITH m AS (SELECT file_id, ord, tag, TRY_CAST(regexp_extract(date_text, '^(\d+)/', 1) AS INT) AS month FROM d),
c AS (SELECT file_id, month, count(*) AS n, min(ord) AS seen FROM m WHERE month IS NOT NULL GROUP BY ALL),
t AS (SELECT file_id, count(*) AS n_total, count(month) AS n_parsed FROM m GROUP BY ALL),
b AS (SELECT file_id, arg_max(month, n * 1000000 - seen) AS best, max(n) AS n FROM c GROUP BY ALL),
j AS (SELECT t.*, CASE WHEN n_parsed >= 3 THEN best END AS majority_month, CASE WHEN n_parsed >= 3 THEN n / n_parsed END AS confidence FROM t LEFT JOIN b ON t.file_id = b.file_id),
k AS (SELECT month, list_sort(list(lpad(block, 2, '0'))) AS blocks FROM blocks WHERE class_period = 1 GROUP BY ALL),
r AS (SELECT j.*, blocks, CASE WHEN n_parsed < 3 THEN 'too_few_dates' WHEN confidence < 0.6::DOUBLE THEN 'no_majority' WHEN blocks IS NULL THEN 'no_block' WHEN len(blocks) > 1 THEN 'ambiguous_blocks' END AS reason
  FROM j LEFT JOIN k ON j.majority_month = k.month)
"""


@query(_MONTHS + "SELECT file_id, month, n FROM c", d=I.DATED_MONTHS, blocks=I.BLOCKS)
def month_histogram(d: DataFrame, blocks: DataFrame) -> DataFrame:
    return D.month_histogram(d)


@query(
    _MONTHS + "SELECT file_id, 1 AS class_period, CASE WHEN reason IS NULL THEN blocks[1] END AS block, n_parsed, n_total, majority_month, round(confidence, 9) AS confidence, reason FROM r",
    d=I.DATED_MONTHS,
    blocks=I.BLOCKS,
)
def resolve_block(d: DataFrame, blocks: DataFrame) -> DataFrame:
    return D.resolve_block(d, blocks, 1).drop("month_histogram").withColumn("confidence", F.round("confidence", 9))


@query(
    _MONTHS + "SELECT m.file_id, tag, month, majority_month FROM m JOIN r ON m.file_id = r.file_id WHERE month IS NOT NULL AND month <> majority_month",
    d=I.DATED_MONTHS,
    blocks=I.BLOCKS,
)
def disagreeing_packets(d: DataFrame, blocks: DataFrame) -> DataFrame:
    return D.disagreeing_packets(d, D.resolve_block(d, blocks, 1))
